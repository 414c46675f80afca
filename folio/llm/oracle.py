"""SQL for the operators that SQL can express, for DuckDB."""

from __future__ import annotations

from collections import Counter

from folio.llm import license_scan as L
from folio.llm import near_dup as N

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_dup_sql() -> str:
    k, t = N.WORDS, N.PERCENT
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: hash(array_to_string(w[i:i + {k - 1}], ' ')))) WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= {t} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {t} * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.c = p.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m USING (doc_id)"""


def linked_vectors_sql(threshold: float = 0.95) -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {threshold}),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.c = p.a),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept FROM m LEFT JOIN n USING (vec_id)"""


def _strings(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def license_sql() -> str:
    index, needed = L.postings(), L._needed()
    total = Counter(k for _, k, _ in index)
    mandatory = sorted({p for _, _, ps in L.TEMPLATES for p in ps})
    gates = sorted({max((w for p in ps for w in p.split()), key=lambda w: (len(w), w)) for _, _, ps in L.TEMPLATES})
    postings = ", ".join(f"('{w}', {k}, {p}, {needed[k]}, '{L.TEMPLATES[k][0]}', {_strings(L.TEMPLATES[k][2])}, {total[k]})" for w, k, p in index)
    base = []
    for phrase, label in L.PHRASES.items():
        parts = phrase.split()
        test = " AND ".join(f"w[i + {j}] = '{x}'" if j else f"w[i] = '{x}'" for j, x in enumerate(parts))
        base.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: coalesce({test}, FALSE)), lambda i: {{'s': i - 1, 'l': '{label}'}})")
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, '{L.WORD}') AS w FROM documents),
f AS (SELECT *, {' || '.join(base)} AS b FROM d),
t(word, template, tpos, needed, label, mandatory, total) AS (VALUES {postings}),
g AS (SELECT rid, w, list_filter({_strings(mandatory)}, lambda p: contains(' ' || array_to_string(w, ' ') || ' ', ' ' || p || ' ')) AS held FROM f WHERE list_has_any(w, {_strings(gates)})),
h AS (SELECT rid, held, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM g),
j AS (SELECT h.rid, h.word, pos - tpos AS start, t.* EXCLUDE (word, tpos) FROM h JOIN t USING (word) WHERE list_has_all(held, mandatory)),
k AS (SELECT *, count(DISTINCT word) OVER (PARTITION BY rid, template ORDER BY start RANGE BETWEEN CURRENT ROW AND {L.SLACK} FOLLOWING) AS n FROM j),
p AS (SELECT rid, template, start, label, max(n / total) AS share FROM k WHERE n >= needed GROUP BY ALL),
q AS (SELECT *, start - lag(start) OVER (PARTITION BY rid, template ORDER BY start) AS gap FROM p),
o AS (SELECT rid, list(DISTINCT {{'label': label, 'at': greatest(start, 0)}}) FILTER (gap IS NULL OR gap > {L.SLACK}) AS finds, max(share) AS share FROM q GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(b) AS BIGINT) AS n_base, CAST(list_min(list_transform(b, lambda y: y.s)) AS BIGINT) AS first_word, CAST(list_max(list_transform(b, lambda y: y.s)) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(b, lambda y: y.l))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_transform(b, lambda y: y.l) || coalesce(list_transform(finds, lambda y: y.label), []))), ',') AS labels,
  CASE WHEN len(b) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score, CAST(coalesce(len(finds), 0) AS BIGINT) AS n_finds FROM f LEFT JOIN o USING (rid)"""
