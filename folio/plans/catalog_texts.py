"""Registered queries on texts and files: their inputs are built from the supplied tables, whole tables at a time."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions import versions as V
from folio.functions.stemming import RETRIEVAL_STOP_WORDS
from folio.operators import filters, joins, ordering, reports, retrieval
from folio.plans.catalog import query, table


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(words)))


def _lines(*parts: str) -> str:
    """DuckDB: the parts, which are expressions, with line feeds between them."""
    return " || chr(10) || ".join(parts)


def _body(spark, d, name: str, key: str, expression: str) -> DataFrame:
    """(id, body): a text made of each row of a table."""
    return table(spark, d, name).select(F.col(key).alias("id"), F.expr(expression).alias("body"))


# Text functions


@query("""WITH c AS (SELECT p_partkey, '#' || left(md5(p_name || p_partkey), CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 6 END) AS colour FROM part),
h AS (SELECT *, CASE WHEN length(colour) = 4 THEN colour[2] || colour[2] || colour[3] || colour[3] || colour[4] || colour[4] ELSE colour[2:] END AS f FROM c),
v AS (SELECT *, CAST('0x' || f[1:2] AS INT) AS r, CAST('0x' || f[3:4] AS INT) AS g, CAST('0x' || f[5:6] AS INT) AS b FROM h)
SELECT p_partkey, colour, CASE WHEN (r * 299 + g * 587 + b * 114) // 1000 < 125 AND r + g + b < 500 THEN '#fff' ELSE '#000' END AS contrast FROM v""")
def fn_text_colour(spark, d):
    at = table(spark, d, "part").select("p_partkey", F.expr("concat('#', left(md5(concat(p_name, p_partkey)), IF(p_partkey % 2 = 0, 3, 6)))").alias("colour"))
    return at.withColumn("contrast", T.text_colour(F.col("colour")))


_SYNONYMS = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(x) for x in v)}]" for k, v in T.SYNONYMS.items()) + "}"


def _terms_sql(rows: str) -> str:
    """p (all columns of rows, terms) and q (also synonyms) of rows (..., q)."""
    return f"""w AS (SELECT *, list_filter(regexp_split_to_array(lower(q), '\\W+'), lambda x: length(x) > 2 AND x NOT IN ({_list(RETRIEVAL_STOP_WORDS)})) AS w FROM {rows}),
p AS (SELECT * EXCLUDE (w), list_filter(w, lambda x, i: list_position(w, x) = i) AS terms FROM w),
q AS (SELECT *, list_filter(list_sort(list_distinct(flatten(list_transform(terms, lambda x: coalesce({_SYNONYMS}[x], {_SYNONYMS}[regexp_replace(x, 's$', '')], []))))), lambda x: NOT list_contains(terms, x)) AS synonyms FROM p)"""


@query(f"WITH b AS (SELECT item_id, text || ' Which features, plugins and modules?' AS q FROM benchmark), {_terms_sql('b')} SELECT item_id, array_to_string(terms, ',') AS terms, array_to_string(synonyms, ',') AS synonyms FROM q")
def fn_query_terms(spark, d):
    primary, synonyms = T.query_terms(F.concat("text", F.lit(" Which features, plugins and modules?")))
    return table(spark, d, "benchmark").select("item_id", F.array_join(primary, ",").alias("terms"), F.array_join(F.array_sort(synonyms), ",").alias("synonyms"))


@query("""WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE CAST(floor(o_totalprice * 1000) AS BIGINT) END AS ms FROM orders),
p AS (SELECT o_orderkey, ms, ms // 3600000 AS h, ms // 60000 % 60 AS m, ms // 60000 % 60 AS s, ms // 60000 % 1000 AS r FROM m)
SELECT o_orderkey, CASE WHEN h + m + s + r = 0 THEN '0' ELSE concat_ws(' ', CASE WHEN h > 0 THEN h || 'h' END, CASE WHEN m > 0 THEN m || 'mn' END, CASE WHEN s > 0 THEN s || 's' END, CASE WHEN r > 0 THEN r || 'ms' END) END AS shown FROM p""")
def fn_human_duration(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.human_duration(F.expr("IF(o_orderkey % 50 = 0, 0, floor(o_totalprice * 1000))")).alias("shown"))


@query("""WITH l AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || ' <' || lower(c_mktsegment) || '@x.org>, Al <al@x.org>' WHEN 1 THEN c_name ELSE ' ' || c_name || '<a@b.c> , ,' END AS line FROM customer),
p AS (SELECT c_custkey, list_filter(list_transform(string_split(line, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM l)
SELECT c_custkey, array_to_string(list_transform(p, lambda x: trim(regexp_extract(x, '^([^<]*)', 1))), ';') AS names, array_to_string(list_transform(p, lambda x: regexp_extract(x, '<([^>]*)>', 1)), ';') AS mails FROM p""")
def fn_authors(spark, d):
    line = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat(c_name, ' <', lower(c_mktsegment), '@x.org>, Al <al@x.org>') WHEN 1 THEN c_name ELSE concat(' ', c_name, '<a@b.c> , ,') END")
    a = T.authors(line)
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(a, lambda x: x["name"]), ";").alias("names"), F.array_join(F.transform(a, lambda x: x["mail"]), ";").alias("mails"))


@query(r"""WITH c AS (SELECT p_partkey, p_name || ' <' || p_size || '>' || chr(10) || p_brand || '; <' || (p_size + 1) || '> <x>' AS code FROM part)
SELECT p_partkey, regexp_replace(code, '<(\d+)>', '(\1)', 'g') AS shown, array_to_string(regexp_extract_all(code, '<(\d+)>', 1), ',') AS numbers FROM c""")
def fn_callouts(spark, d):
    shown, numbers = T.callouts(F.expr(r"concat(p_name, ' <', p_size, '>\n', p_brand, '; <', p_size + 1, '> <x>')"))
    return table(spark, d, "part").select("p_partkey", shown.alias("shown"), F.array_join(numbers.cast("array<string>"), ",").alias("numbers"))


@query(r"""WITH b AS (SELECT c_custkey, string_split(replace('Home[/] > ' || c_mktsegment || '[' || lower(c_mktsegment) || '.html] &gt; ' || c_name, '&gt;', '>'), '>') AS p FROM customer),
e AS (SELECT c_custkey, generate_subscripts(p, 1) AS pos, trim(unnest(p)) AS x, len(p) AS n FROM b)
SELECT c_custkey, CAST(pos - 1 AS INTEGER) AS pos, trim(regexp_extract(x, '^([^\[]*)', 1)) AS label, nullif(trim(regexp_extract(x, '\[([^\]]*)\]', 1)), '') AS href, pos = n AS active FROM e""")
def fn_breadcrumb(spark, d):
    from folio.functions import markup

    value = F.expr("concat('Home[/] > ', c_mktsegment, '[', lower(c_mktsegment), '.html] &gt; ', c_name)")
    return table(spark, d, "customer").select("c_custkey", F.posexplode(markup.breadcrumb_items(value)).alias("pos", "x")).select("c_custkey", "pos", "x.*")


@query(r"""WITH t AS (SELECT doc_id, source, lang, string_split(regexp_replace(text, '[^A-Za-z0-9 .&<>\n]', '', 'g'), chr(10)) AS l FROM documents)
SELECT doc_id, md5(array_to_string(['<h2>' || source || ' &amp; co</h2>'] || list_transform(list_filter(l, lambda x: trim(x) <> ''), lambda x: '<p>' || replace(replace(replace(rtrim(x), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>')
  || ['<ul>', '<li><strong>' || lang || '</strong> is <code>' || source || '</code></li>', '<li>see <a href="/' || doc_id || '" target="_blank" rel="noopener">' || lang || '</a> and <em>more</em></li>', '</ul>'], chr(10))) AS html FROM t""")
def fn_markdown(spark, d):
    from folio.functions import markup

    text = F.regexp_replace("text", r"[^A-Za-z0-9 .&<>\n]", "")
    answer = F.concat(F.lit("## "), "source", F.lit(" & co\n\n"), text, F.expr(r"concat('\n- **', lang, '** is `', source, '`\n* see [', lang, '](/', doc_id, ') and *more*\n')"))
    return table(spark, d, "documents").select("doc_id", F.md5(markup.markdown(answer).cast("binary")).alias("html"))


@query(r"""SELECT p_partkey, 'category-' || replace(lower(left(p_type, 1)) || lower(regexp_replace(regexp_replace(substr(p_type, 2), '[^\p{L}\p{N}_$]', '-', 'g'), '([A-Z])', '-\1', 'g')), '--', '-') AS class,
  replace('io.x.' || p_brand, '.', '_') AS anchor, p_size + 1 AS next, 'Fixes' || chr(10) || '** ' || p_name AS body, 1.0::DOUBLE AS length FROM part""")
def fn_small(spark, d):
    unit = T.unit_vector(F.expr("array(CAST(p_size + 1 AS DOUBLE), p_retailprice)"))
    length = F.round(F.sqrt(F.aggregate(unit.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)), 5)
    body = T.release_body(F.expr(r"concat('Release ', p_size, ' Fixes\n* ', p_name)"), F.col("p_size").cast("string"))
    mark = F.expr("""concat('<select data-version-iteration="', p_size, '">')""")
    return table(spark, d, "part").select("p_partkey", T.category_class(F.expr("concat(p_type, ', simple')")).alias("class"), T.schema_anchor(F.expr("concat('#/schemas/io.x.', p_brand)")).alias("anchor"), T.next_version(mark).alias("next"), body.alias("body"), length.alias("length"))


@query("""SELECT p_partkey, '=== ' || p_name || chr(10) || 'text' AS deeper, '  ' || p_name || chr(10) || '    ' || p_brand AS indented, CAST(p_size AS VARCHAR) AS number, '2024-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS date, p_type AS remark FROM part""")
def fn_document_lines(spark, d):
    r = T.revision(F.expr("concat('v', p_size, ', 2024-01-', lpad(p_size % 28 + 1, 2, '0'), ': ', p_type)"))
    code = F.expr(r"concat(repeat(' ', p_size % 4 + 1), p_name, '\n', repeat(' ', p_size % 4 + 3), p_brand)")
    return table(spark, d, "part").select("p_partkey", T.level_offset(F.expr(r"concat('= ', p_name, '\ntext')"), 2).alias("deeper"), T.indented(code, 2).alias("indented"), r["number"].alias("number"), r["date"].alias("date"), r["remark"].alias("remark"))


@query("SELECT p_partkey, p_brand || chr(10) || p_size AS tagged, p_name || chr(10) || p_type || chr(10) || p_size AS without FROM part")
def set_tagged_lines(spark, d):
    text = F.expr(r"concat(p_name, '\n# tag::x[]\n', p_brand, '\n# end::x[]\n', p_type, '\n# tag::y[]\n', p_size, '\n# end::y[]')")
    return table(spark, d, "part").select("p_partkey", T.tagged_lines(text, "*").alias("tagged"), T.tagged_lines(text, "**,!x").alias("without"))


#: A vocabulary by rule: letters a to v, as beginnings and continuations, and common pieces.
_PIECES = ["[PAD]", "[CLS]", "[SEP]", "[UNK]", *"abcdefghijklmnopqrstuv", *[f"##{c}" for c in "abcdefghijklmnopqrstuv"], "th", "the", "and", "re", "##er", "##ion", "##tion", "##th", "##nd", "##ou"]


@query(f"""WITH RECURSIVE v AS (SELECT replace(p, '##', '') AS piece, starts_with(p, '##') AS inner_, i - 1 AS id FROM (SELECT unnest([{', '.join(repr(p) for p in _PIECES)}]) AS p, unnest(range(1, {len(_PIECES) + 1})) AS i) WHERE NOT starts_with(p, '[')),
t AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), '[a-z]+') AS w FROM benchmark),
u AS (SELECT DISTINCT unnest(w) AS word FROM t),
b AS (SELECT word, pos, max_by(id, length(piece)) AS id, max(length(piece)) AS n FROM (SELECT word, unnest(range(1, length(word) + 1)) AS pos FROM u) JOIN v ON starts_with(substr(word, pos), piece) AND inner_ = (pos > 1) GROUP BY ALL),
s AS (SELECT word, CAST(1 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS ids FROM u UNION ALL SELECT s.word, CAST(s.pos + b.n AS BIGINT), list_append(s.ids, b.id) FROM s JOIN b ON b.word = s.word AND b.pos = s.pos),
f AS (SELECT u.word, coalesce(s.ids, [3]) AS ids FROM u LEFT JOIN s ON s.word = u.word AND s.pos = length(u.word) + 1)
SELECT item_id, array_to_string(([1] || flatten(list(f.ids ORDER BY k)))[1:127] || [2], ',') AS ids FROM (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM t) JOIN f USING (word) GROUP BY item_id""")
def fn_wordpiece(spark, d):
    from folio.functions import wordpiece

    ids = wordpiece.encoded(F.regexp_replace("text", "[^A-Za-z ]", " "), {p: i for i, p in enumerate(_PIECES)})
    return table(spark, d, "benchmark").select("item_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query("""WITH v AS (SELECT DISTINCT (c_custkey % 3) || '.' || (c_custkey % 17) AS folder FROM customer),
s AS (SELECT '<!-- VERSIONS START --><select>' || string_agg('<option value="' || folder || '"' || CASE WHEN folder = '1.2' THEN ' selected' ELSE '' END || '>' || folder || '</option>', '' ORDER BY list_transform(string_split(folder, '.'), lambda x: x::BIGINT) DESC) || '</select><!-- VERSIONS END -->' AS s FROM v)
SELECT page_id, md5(replace(html, '<body>', '<body>' || s)) AS html FROM pages, s""")
def fn_version_select(spark, d):
    from folio.functions import markup

    folders = table(spark, d, "customer").select(F.expr("concat(c_custkey % 3, '.', c_custkey % 17)").alias("folder")).distinct()
    select = markup.version_select(folders, V.folder_key(F.col("folder")), "1.2")
    page = table(spark, d, "pages").crossJoin(F.broadcast(select))  # one row
    once = page.withColumn("html", markup.with_select(F.col("html"), F.col("select"), "<body>"))
    return once.select("page_id", F.md5(markup.with_select(F.col("html"), F.col("select"), "<body>").cast("binary")).alias("html"))


# Filters, joins, orders


_PATH = "CASE page_id % 5 WHEN 0 THEN '/d' || page_id || '/index.html' WHEN 1 THEN '/404.html' WHEN 2 THEN '/page-' || page_id || '.html' WHEN 3 THEN '/a' || page_id || '.html' ELSE '/b/page-' || page_id || '.html' END"


@query(f"WITH p AS (SELECT page_id, {_PATH} AS p FROM pages), f AS (SELECT *, regexp_extract(p, '[^/]*$') AS file FROM p) SELECT page_id, p FROM f WHERE file <> '404.html' AND NOT starts_with(file, 'page-') AND (file <> 'index.html' OR page_id % 10 = 0)")
def flt_embeddable(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.expr(_PATH).alias("p"))
    sources = pages.where("page_id % 10 = 0").select(F.regexp_replace("p", r"\.html$", ".adoc").alias("s")).distinct()
    known = pages.join(sources, F.regexp_replace("p", r"\.html$", ".adoc") == F.col("s"), "left")
    return known.where(filters.embeddable(F.col("p"), F.col("s").isNotNull())).select("page_id", "p")


@query("""WITH i AS (SELECT 'en' AS c, 'flag' AS icon UNION ALL SELECT 'top-news', 'star' UNION ALL SELECT DISTINCT source, upper(source) FROM documents WHERE right(source, 1) IN ('0', '2', '4')),
c AS (SELECT doc_id, unnest([lang, source, 'Top News']) AS c, unnest([0, 1, 2]) AS pos FROM documents)
SELECT doc_id AS post, min_by(icon, pos) AS icon FROM c JOIN i ON i.c = c.c OR i.c = replace(lower(c.c), ' ', '-') GROUP BY ALL""")
def jn_first_icon(spark, d):
    docs = table(spark, d, "documents")
    posts = docs.select(F.col("doc_id").alias("post"), F.posexplode(F.array("lang", "source", F.lit("Top News"))).alias("pos", "category"))
    some = docs.where("right(source, 1) IN ('0', '2', '4')").select(F.col("source").alias("category"), F.upper("source").alias("icon")).distinct()
    icons = spark.createDataFrame([("top-news", "star"), ("en", "flag")], "category string, icon string").unionByName(some)
    return joins.first_icon(posts, icons, "post", "pos", "category", lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("-")))


@query("""WITH s AS (SELECT DISTINCT user_id, k AS shape, user_id % 7 AS x0, user_id % 7 + 10 + 5 * k AS x1, 3 * k AS y0, 20 + k AS y1 FROM events, (SELECT unnest([1, 2]) AS k)),
p AS (SELECT user_id, event_id AS point, CAST(floor(value) AS INT) AS x, CAST(event_id % 50 AS INT) AS y FROM events)
SELECT point, shape FROM p JOIN s USING (user_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1""")
def jn_inside(spark, d):
    at = table(spark, d, "events")
    points = at.select("user_id", F.col("event_id").alias("point"), F.floor("value").cast("int").alias("x"), (F.col("event_id") % 50).cast("int").alias("y"))
    corners = "x0, y0; x1, y0; x1, y1; x0, y1"
    polygon = F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (c.strip().split(", ") for c in corners.split(";"))])
    boxes = at.select("user_id").distinct().withColumn("shape", F.explode(F.array(F.lit(1), F.lit(2)))).selectExpr("user_id", "shape", "CAST(user_id % 7 AS INT) AS x0", "CAST(user_id % 7 + 10 + 5 * shape AS INT) AS x1", "3 * shape AS y0", "20 + shape AS y1")
    return joins.inside(points, boxes.select("user_id", "shape", polygon.alias("polygon")), "x", "y", "polygon").select("point", "shape")


_FOLDER = "(c_custkey % 4) || '.' || (c_custkey % 13) || CASE WHEN c_custkey % 3 = 0 THEN '.' || (c_custkey % 11) ELSE '' END"


@query(f"SELECT folder, row_number() OVER (ORDER BY list_transform(string_split(folder, '.'), lambda x: x::BIGINT), folder) AS rank FROM (SELECT DISTINCT {_FOLDER} AS folder FROM customer)")
def ord_folders(spark, d):
    at = table(spark, d, "customer").select(F.expr(_FOLDER).alias("folder")).distinct()
    return ordering.numbered(at.withColumn("k", V.folder_key(F.col("folder"))), "k").select("rank", "folder")


_TAG = "CASE c_custkey % 4 WHEN 0 THEN 'v' || (c_custkey % 5) || '.' || (c_custkey % 12) WHEN 1 THEN 'v' || (c_custkey % 5) || '.' || (c_custkey % 12) || '.' || (c_custkey % 7) WHEN 2 THEN 'latest-' || (c_custkey % 9) ELSE 'tool-' || (c_custkey % 3) || '.' || (c_custkey % 10) || '.0' END"


@query(rf"""WITH t AS (SELECT DISTINCT {_TAG} AS tag FROM customer), n AS (SELECT tag, regexp_extract(tag, '(\d+)\.(\d+)(?:\.(\d+))?', ['a', 'b', 'c']) AS x FROM t)
SELECT row_number() OVER (ORDER BY x.a = '', coalesce(try_cast(x.a AS BIGINT), 0), coalesce(try_cast(x.b AS BIGINT), 0), coalesce(try_cast(x.c AS BIGINT), -1), tag) AS rank, tag, CASE WHEN regexp_full_match(tag, 'v.+') THEN tag[2:] ELSE regexp_extract(tag, '[^-]*$') END AS version FROM n""")
def ord_tags(spark, d):
    at = table(spark, d, "customer").select(F.expr(_TAG).alias("tag")).distinct()
    ranked = ordering.numbered(at.withColumn("k", V.tag_key(F.col("tag"))), "k")
    return ranked.select("rank", "tag", V.version_of_tag(F.col("tag"), "v${version}").alias("version"))


_TOOL = "(c_custkey % 22) || '.0.' || (c_custkey % 13) || CASE c_custkey % 3 WHEN 0 THEN '-tem' WHEN 1 THEN '.r' || (c_custkey % 4) ELSE '' END"


@query(f"""SELECT version, row_number() OVER (ORDER BY list_transform(string_split(replace(version, '-', '.'), '.'), lambda x: {{'n': coalesce(try_cast(x AS BIGINT), -1), 'w': CASE WHEN try_cast(x AS BIGINT) IS NULL THEN x ELSE '' END}}), version) AS rank FROM (SELECT DISTINCT {_TOOL} AS version FROM customer)""")
def ord_tools(spark, d):
    at = table(spark, d, "customer").select(F.expr(_TOOL).alias("version")).distinct()
    return ordering.numbered(at.withColumn("k", V.tool_key(F.col("version"))), "k").select("rank", "version")


_PROVIDER = "CASE s_suppkey WHEN 0 THEN 'sdkman' WHEN 1 THEN 'central' ELSE s_name END"


@query(f"SELECT provider, row_number() OVER (ORDER BY CASE provider WHEN 'central' THEN 0 WHEN 'sdkman' THEN 2 ELSE 1 END, provider) AS rank FROM (SELECT {_PROVIDER} AS provider FROM supplier)")
def ord_providers(spark, d):
    at = table(spark, d, "supplier").select(F.expr(_PROVIDER).alias("provider"))
    first = F.when(F.col("provider") == "central", 0).when(F.col("provider") == "sdkman", 2).otherwise(1)
    return ordering.numbered(at.withColumn("o", first), "o", "provider").select("provider", "rank")


# AsciiDoc, drawings, schemas


_ADOC = r"concat('= ', p_name, '\n\n== ', p_brand, '\n\n', repeat('* item\n', p_size % 5 + 1), '\nSome *bold* and `code`, see <<_', lower(replace(p_brand, '#', '')), '>>, <<_none', p_partkey, '>> and <<_x,', p_type, '>>.\n\n----\nint a = ', p_size, ';\n----\n\nNOTE: kept ', p_type, '\n\n|===\n|h1 |h2\n\n|c1 |c2\n|===\n')"


@query("""SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(['document', 'section', 'ulist', 'item', 'bold', 'code', 'anchor', 'listing', 'admonition', 'table', 'row', 'cell']) AS kind, unnest([1, 1, 1, p_size % 5 + 1, 1, 1, 3, 1, 1, 1, 2, 4]) AS n FROM part) GROUP BY kind""")
def doc_node_counts(spark, d):
    from folio.functions import asciidoc

    tree = asciidoc.nodes(_body(spark, d, "part", "p_partkey", _ADOC), "id", "body")
    return tree.where(~F.col("kind").isin("text", "paragraph", "attribute", "set-attribute")).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS id, unnest(['_' || lower(replace(p_brand, '#', '')), '_none' || p_partkey, '_x']) AS target, unnest([p_brand, '_none' || p_partkey, p_type]) AS label FROM part""")
def doc_cross_references(spark, d):
    from folio.functions import asciidoc

    return asciidoc.cross_references(asciidoc.nodes(_body(spark, d, "part", "p_partkey", _ADOC), "id", "body", kinds=("section", "anchor")), "id").select("id", "target", "label")


_PLAIN = r"regexp_replace(regexp_replace(text, '[^A-Za-z0-9\n]+', ' ', 'g'), ' *\n *', chr(10), 'g')"


@query(f"""WITH t AS (SELECT doc_id, string_split_regex({_PLAIN}, '\\n\\n+') AS p FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(list_filter(list_transform(p, lambda x: trim(replace(trim(x, chr(10)), chr(10), ' '))), lambda x: x <> ''), lambda x: ' <div class="paragraph">' || chr(10) || ' <p>' || chr(10) || x || chr(10) || ' </p>' || chr(10) || ' </div>' || chr(10)), '')) AS html FROM t""")
def doc_html(spark, d):
    from folio.functions import asciidoc

    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"[^A-Za-z0-9\n]+", " "), r" *\n *", "\n"))
    at = table(spark, d, "documents").select("doc_id", F.concat(F.lit("= "), "source", F.lit("\n\n"), plain).alias("adoc"))
    return at.select("doc_id", F.md5(asciidoc.html(F.col("adoc")).cast("binary")).alias("html"))


@query("""SELECT p_partkey AS id, unnest(['T' || p_partkey, 'T' || p_partkey, 'T' || p_partkey, 'B']) AS parent, unnest([split_part(p_name, ' ', 1), 'p_more', 'p_size', split_part(p_name, ' ', 2)]) AS name, unnest(['string', 'array', 'object', 'integer']) AS kind, unnest([NULL, 'B', 'B', NULL]) AS target FROM part""")
def doc_schema_properties(spark, d):
    from folio.operators import schemas

    body = """concat('{"title":"T', p_partkey, '","properties":{"', split_part(p_name, ' ', 1), '":{"type":"string"},"p_size":{"$ref":"#/definitions/B"},"p_more":{"type":"array","items":{"$ref":"#/definitions/B"}}},"definitions":{"B":{"properties":{"', split_part(p_name, ' ', 2), '":{"type":"integer"}}}}}')"""
    return schemas.properties(_body(spark, d, "part", "p_partkey", body), "id", "body").select("id", "parent", "name", "kind", "target").distinct()


_DRAWING = r"concat('+', repeat('-', length(p_brand) + 2), '+\n| ', p_brand, ' |\n+', repeat('-', length(p_brand) + 2), '+\n', p_name)"


@query("SELECT p_partkey AS id, 1 AS y, 2 AS x, p_brand AS text FROM part UNION ALL SELECT p_partkey, 3, 0, p_name FROM part")
def arr_text_runs(spark, d):
    from folio.functions import markup

    return markup.text_runs(markup.cells(_body(spark, d, "part", "p_partkey", _DRAWING), "id", "body"), "id").select("id", "y", "x", "text")


@query("SELECT p_partkey AS id, 0 AS shape, '0 0,' || (length(p_brand) + 3) || ' 0,' || (length(p_brand) + 3) || ' 2,0 2' AS corners FROM part")
def arr_shapes(spark, d):
    from folio.functions import markup

    at = markup.shapes(_body(spark, d, "part", "p_partkey", _DRAWING), "id", "body")
    return at.select("id", "shape", F.array_join(F.transform("polygon", lambda p: F.concat_ws(" ", p["x"], p["y"])), ",").alias("corners"))


_TAGGED = r"""concat('+', repeat('=', length(p_brand) + 6), '+\n| ', p_brand, ' [t] |----> ', p_type, '\n+', repeat('=', length(p_brand) + 6), '+\n\n[t]: {"fill":"#', left(md5(p_name), 6), '"}')"""


@query("""SELECT p_partkey AS id, unnest([0, 1, 2, 3]) AS seq, unnest(['closed', 'open', 'text', 'text']) AS kind, unnest([true, false, false, false]) AS dashed, unnest([false, true, false, false]) AS tip, unnest(['', '', p_brand || ' [t]', p_type]) AS text, unnest(['t', '', 't', '']) AS tag,
unnest(['0 0,' || (length(p_brand) + 7) || ' 0,' || (length(p_brand) + 7) || ' 2,0 2', (length(p_brand) + 8) || ' 1,' || (length(p_brand) + 12) || ' 1', '2 1', (length(p_brand) + 14) || ' 1']) AS corners FROM part""")
def arr_objects(spark, d):
    """Dashed tagged boxes with an arrow to a word."""
    from folio.functions import markup

    at = markup.objects(_body(spark, d, "part", "p_partkey", _TAGGED), "id", "body")
    return at.select("id", "seq", "kind", "dashed", F.col("end").alias("tip"), "text", "tag", F.array_join(F.transform("corners", lambda p: F.concat_ws(" ", p["x"], p["y"])), ",").alias("corners"))


@query("""WITH c AS (SELECT p_partkey, p_brand, p_type, left(md5(p_name), 6) AS h, length(p_brand) AS n FROM part),
v AS (SELECT *, CAST('0x' || h[1:2] AS INT) AS r, CAST('0x' || h[3:4] AS INT) AS g, CAST('0x' || h[5:6] AS INT) AS b FROM c)
SELECT p_partkey AS id, '<path d="M 4 8 L ' || (n * 9 + 67) || ' 8 L ' || (n * 9 + 67) || ' 40 L 4 40 Z" stroke="#000" stroke-dasharray="5 5" fill="#' || h || '"/>' AS box,
  '<text x="22" y="24" fill="' || CASE WHEN (r * 299 + g * 587 + b * 114) // 1000 < 125 AND r + g + b < 500 THEN '#fff' ELSE '#000' END || '" font-family="monospace">' || p_brand || ' [t]</text>' AS label FROM v""")
def arr_svg(spark, d):
    from folio.functions import markup

    lines = F.split("svg", "\n")
    return markup.svg(_body(spark, d, "part", "p_partkey", _TAGGED), "id", "body").select("id", F.get(lines, F.lit(2)).alias("box"), F.get(lines, F.lit(4)).alias("label"))


# Sinks


_POSTS = "SELECT '/' || source || CASE WHEN doc_id % 9 = 0 THEN '/page-' ELSE '/p' END || doc_id || '.html' AS path, source || ' & ' || lang AS title, DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER) AS day, CASE WHEN doc_id % 2 = 0 THEN lang || ' <x>' END AS summary FROM documents"
_WHEN = "'%a, %-d %b %Y 00:00:00 GMT'"


@query(f"""WITH p AS ({_POSTS}), k AS (SELECT * FROM p WHERE NOT regexp_matches(path, '/page-[^/]*$')),
i AS (SELECT row_number() OVER (ORDER BY day DESC, path) AS seq, '<item><title>' || replace(title, '&', '&#x26;') || '</title><link>http://s' || path || '</link><pubDate>' || strftime(day, {_WHEN}) || '</pubDate><description>' || coalesce(replace(replace(summary, '<', '&#x3C;'), '>', '&#x3E;'), '') || '</description></item>' AS line FROM k)
SELECT * FROM i UNION ALL SELECT 0, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<rss version="2.0"><channel><title>T</title><link>http://s</link><lastBuildDate>' || strftime(max(day), {_WHEN}) || '</lastBuildDate>' FROM k UNION ALL SELECT count(*) + 1, '</channel></rss>' FROM k""")
def snk_rss(spark, d):
    posts = table(spark, d, "documents").select(F.expr("concat('/', source, IF(doc_id % 9 = 0, '/page-', '/p'), doc_id, '.html')").alias("path"), F.expr("concat(source, ' & ', lang)").alias("title"), F.expr("CAST(date_add(DATE '2024-01-01', CAST(doc_id % 300 AS INT)) AS TIMESTAMP)").alias("published"), F.expr("IF(doc_id % 2 = 0, concat(lang, ' <x>'), NULL)").alias("summary"))
    return reports.rss_lines(posts, "http://s", "T")


@query("SELECT p_partkey AS id, '# ' || p_name || chr(10) || 'a = ' || p_size || chr(10) || chr(10) || p_brand || ':' || p_type AS text FROM part")
def snk_properties(spark, d):
    from folio.sources import text_formats

    read = text_formats.properties(_body(spark, d, "part", "p_partkey", r"concat('# ', p_name, '\na = ', p_size, '\n\n', p_brand, ':', p_type)"), "id", "body")
    return text_formats.properties_text(read.withColumn("name", F.when(F.col("name") == "a", "a ").otherwise(F.col("name"))), "id")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_orderdate, md5(CAST(o_orderkey AS VARCHAR)) AS sha, o_orderpriority AS message FROM orders)
SELECT 'c' || o_custkey AS key, '=== C' || o_custkey || ' (#' || count(*) || ')' || chr(10) || chr(10) || string_agg('* ' || left(sha, 7) || ' ' || message, chr(10) ORDER BY o_orderdate DESC, sha) AS section FROM c GROUP BY o_custkey""")
def snk_git_report(spark, d):
    at = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("sha"), F.expr("concat('C', o_custkey)").alias("name"), F.expr("concat('c', o_custkey, '@x.org')").alias("email"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.concat("o_orderpriority", F.lit("\n\nbody")).alias("message"))
    return reports.git_sections(at)


# Sources


_METRICS = r"""concat('# HELP g_seconds A summary of ', s_name, '.\n# TYPE g_seconds summary\ng_seconds{quantile="0"} ', s_suppkey, '.5\ng_seconds_sum ', s_nationkey, '\n# HELP go Number.\n# TYPE go gauge\ngo ', s_suppkey, '\n\nk{partition="', s_nationkey, '",topic="a",topic="b"} 2.7e+07\n')"""


@query("""SELECT s_suppkey AS id, unnest(['g_seconds', 'g_seconds', 'go', 'k']) AS name, unnest(['summary', 'summary', 'gauge', NULL]) AS type, unnest([0, 1, 0, 0]) AS pos, unnest(['quantile=0', '_type_=sum', '', 'partition=' || s_nationkey || ';topic=a,b']) AS tags, unnest([s_suppkey + 0.5, s_nationkey, s_suppkey, 2.7e7]) AS value FROM supplier""")
def src_open_metrics(spark, d):
    from folio.sources import text_formats

    at = text_formats.open_metrics(_body(spark, d, "supplier", "s_suppkey", _METRICS), "id", "body")
    return at.select("id", "name", "type", F.explode("values").alias("v")).select("id", "name", "type", F.col("v.pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.map_entries("v.tags")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("tags"), F.col("v.value").alias("value"))


@query(r"""SELECT s_suppkey AS id, array_to_string(['', '==  g_seconds', '', 'A summary of ' || s_name || '.', '', '[cols="2a,6", options="header"]', '.g_seconds', '|===', '| Tag(s) | Value', '| ', '[stripes=none,cols="a,m"]', '!===', '! quantile ! 0', '!===', '| ' || s_suppkey || '.5', '',
 '| ', '[stripes=none,cols="a,m"]', '!===', '! _type_ ! sum', '!===', '| ' || s_nationkey || '.0', '|===', '', '==  go', '', 'Number.', '', 'Value: `' || s_suppkey || '.0`.', '', '', '==  k', '', '', '', '[cols="2a,6", options="header"]', '.k', '|===', '| Tag(s) | Value', '| ', '[stripes=none,cols="a,m"]', '!===', '! partition ! ' || s_nationkey, '! topic ! a,b', '!===', '| 2.7E7', '|===', ''], chr(10)) AS document FROM supplier""")
def snk_metrics_document(spark, d):
    from folio.sources import text_formats

    return reports.metrics_document(text_formats.open_metrics(_body(spark, d, "supplier", "s_suppkey", _METRICS), "id", "body"), group=["id"])


@query("""SELECT p_partkey AS id, unnest([0, 1, 2, 3]) AS ord, unnest(['# ' || p_name, '', '', 'junk ' || p_size]) AS comment, unnest(['a', NULL, p_brand, NULL]) AS name, unnest(['=', NULL, ':', NULL]) AS sep, unnest([' ' || p_size, NULL, p_type || chr(92) || chr(10) || 'y', NULL]) AS value FROM part""")
def src_properties(spark, d):
    from folio.sources import text_formats

    body = r"concat('# ', p_name, '\na = ', p_size, '\n\n', p_brand, ':', p_type, '\\\ny\njunk ', p_size)"
    return text_formats.properties(_body(spark, d, "part", "p_partkey", body), "id", "body")


_RULE, _DASH = "=" * 80, "-" * 80


@query("""SELECT s_nationkey AS id, 'V' || (s_suppkey // 40) AS vendor, (s_suppkey % 30) || '.' || s_suppkey AS version, 'd' || (s_suppkey % 3) AS dist, 'i' || s_suppkey AS identifier FROM supplier""")
def src_tool_versions(spark, d):
    from folio.sources import text_formats

    rows = table(spark, d, "supplier")
    first = F.expr("lag(s_suppkey div 40) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)")
    vendor = F.when(first.eqNullSafe(F.expr("s_suppkey div 40")), " ").otherwise(F.expr("concat('V', s_suppkey div 40)"))
    line = F.concat(F.lit(" "), vendor, F.expr("concat('    |     | ', s_suppkey % 30, '.', s_suppkey, ' | d', s_suppkey % 3, ' |   | i', s_suppkey)"))
    bodies = reports.joined(rows.withColumn("line", line), ["s_nationkey"], F.col("line"), ["s_suppkey"], "\n", "lines")
    body = F.concat(F.lit(f"{_RULE}\nAvailable\n{_RULE}\n Vendor | Use | Version | Dist | Status | Identifier\n{_DASH}\n"), "lines", F.lit(f"\n{_RULE}\nOmit"))
    return text_formats.tool_versions(bodies.select(F.col("s_nationkey").alias("id"), body.alias("body")), "id", "body").drop("pos")


@query("SELECT p_partkey AS id, unnest([p_size || '.9', p_size || '.8', p_size || '.10']) AS version FROM part")
def src_old_tool_versions(spark, d):
    from folio.sources import text_formats

    body = rf"concat('{_RULE}\nAvailable Versions\n{_RULE}\n     ', p_size, '.9     ', p_size, '.8 \n  ', p_size, '.10\n\n{_RULE}\n+ local')"
    return text_formats.old_tool_versions(_body(spark, d, "part", "p_partkey", body), "id", "body")


@query("SELECT p_partkey AS id, 't' || p_partkey AS tool, p_name AS name, p_size || '.0.2-tem' AS version, 'https://x.org/' || p_partkey AS url, p_type || ' ' || p_brand || '.' AS description FROM part")
def src_tool_list(spark, d):
    from folio.sources import text_formats

    body = rf"concat('{_RULE}\nAvailable\n{_DASH}\n', p_name, ' (', p_size, '.0.2-tem)        https://x.org/', p_partkey, '\n\n', p_type, '\n', p_brand, '.\n\n     $ sdk install t', p_partkey, '\n{_DASH}\n')"
    return text_formats.tool_list(_body(spark, d, "part", "p_partkey", body), "id", "body")


@query("SELECT c_nationkey AS id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS pos, '1.' || c_custkey AS version FROM customer")
def src_maven_versions(spark, d):
    from folio.sources import text_formats

    bodies = reports.joined(table(spark, d, "customer"), ["c_nationkey"], F.expr("concat('<version>1.', c_custkey, '</version>')"), ["c_custkey"], "\n", "lines")
    return text_formats.maven_versions(bodies.select(F.col("c_nationkey").alias("id"), F.concat(F.lit("<metadata><versions>"), "lines", F.lit("</versions></metadata>")).alias("body")), "id", "body")


_FILE = "'zulu' || p_size || CASE p_partkey % 3 WHEN 0 THEN '-jdk' WHEN 1 THEN '-jre' ELSE '-ca' END || p_size || '.0.' || p_partkey || '-linux_x64.zip'"


@query(rf"SELECT p_partkey AS id, file, p_size || '.0.' || p_partkey AS version, CASE p_partkey % 3 WHEN 0 THEN 'jdk' ELSE 'jre' END AS kind FROM (SELECT *, {_FILE} AS file FROM part) WHERE p_partkey % 3 < 2")
def src_archive_links(spark, d):
    from folio.sources import text_formats

    body = rf"""concat('<a href="/zulu/bin/', {_FILE}, '">x</a>\n<a href="', {_FILE}, '">x</a><a href="zulu21-jre21-win.msi">y</a>')"""
    return text_formats.archive_links(_body(spark, d, "part", "p_partkey", body), "id", "body", "linux_x64.zip")


@query("SELECT p_size || '.' || p_partkey AS version FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 = 0")
def src_release_assets(spark, d):
    from folio.sources import text_formats

    at = table(spark, d, "part").select(F.expr("concat(IF(p_partkey % 4 = 0, 'beta', 'v'), p_size, '.', p_partkey)").alias("name"), F.expr("array(named_struct('name', IF(p_partkey % 3 = 0, 'linux', 'mac')), named_struct('name', 'doc'))").alias("assets"))
    return text_formats.release_versions(at, "linux")


@query("SELECT p_partkey AS id, 'g' || p_size AS goal, p_name || ' ' || p_brand AS description, 'a:' || p_type || ':' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END AS parameters FROM part")
def src_plugin_goals(spark, d):
    from folio.sources import text_formats

    body = r"concat('<plugin><mojos><mojo><goal>g', p_size, '</goal><description>', p_name, '\n ', p_brand, '</description><parameters><parameter><name>a</name><type>', p_type, '</type><required>', p_size % 2 = 0, '</required></parameter></parameters></mojo></mojos></plugin>')"
    at = text_formats.plugin_goals(_body(spark, d, "part", "p_partkey", body), "id", "body")
    return at.select("id", "goal", "description", F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["name"], p["type"], p["required"].cast("string"))), ";").alias("parameters"))


@query("""WITH s AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'click' THEN 'passed' ELSE 'undefined' END AS status, CASE WHEN event_type IN ('error', 'click') THEN 10 + event_id % 7 ELSE 0 END AS nanos FROM events)
SELECT user_id AS feature, count(*) AS executed, CAST(sum((status = 'passed')::INT) AS BIGINT) AS passed, CAST(sum((status = 'failed')::INT) AS BIGINT) AS failed, round(sum((status = 'passed')::INT) / count(*), 6) AS passed_share, CAST(sum(nanos) AS BIGINT) AS nanos FROM s GROUP BY user_id""")
def src_cucumber(spark, d):
    from folio.functions.text import wrapped_json

    step = """CASE event_type WHEN 'error' THEN concat('[{"result":{"status":"passed","duration":', event_id % 7, '}},{"result":{"status":"FAILED","duration":10}}]') WHEN 'click' THEN concat('[{"result":{"status":"passed","duration":', 10 + event_id % 7, '}}]') ELSE '[]' END"""
    scenario = F.expr(f"""concat('{{"name":"s', event_id, '","start_timestamp":"2024-01-02T00:00:00.000Z","steps":', {step}, '}}')""")
    bodies = reports.joined(table(spark, d, "events"), ["user_id"], scenario, ["event_id"], ",", "lines")
    value = wrapped_json(F.concat(F.lit('[{"name":"'), F.col("user_id").cast("string"), F.lit('","elements":['), "lines", F.lit("]}]")))
    fields = re.sub(r"(^|, )(\w+) ", r"\1\2:", reports.CUCUMBER)
    at = bodies.select(F.explode(F.from_json(value, f"value array<struct<{fields}>>")["value"]).alias("f")).select("f.*")
    out = reports.run_summary(reports.scenario_results(at), ["feature"]).drop("first_start")
    return out.withColumn("feature", F.col("feature").cast("long")).withColumn("passed_share", F.round("passed_share", 6))


@query("SELECT o_custkey AS project, o_orderpriority AS branch, string_agg('o' || o_orderkey, ',' ORDER BY o_orderkey) AS titles FROM orders GROUP BY ALL")
def src_commits_by_branch(spark, d):
    from folio.sources import remote

    at = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("branch"), F.col("o_orderkey").alias("seq"), F.expr("concat('o', o_orderkey)").alias("title"))
    return remote.commits_by_branch(at).select("project", F.explode("branches").alias("branch", "t")).select("project", "branch", F.array_join("t", ",").alias("titles"))


def _zipped(entries: dict[str, str]) -> bytes:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return raw.getvalue()


def _workbook(cells: str) -> bytes:
    """A workbook whose first sheet has a row for each "name,number" of cells, numbers as cells, names as shared strings."""
    rows = [x.split(",") for x in cells.split(";")]
    strings = "".join(f"<si><t>{a}</t></si>" for a, _ in rows)
    lines = "".join(f'<row r="{k + 1}"><c r="A{k + 1}" t="s"><v>{k}</v></c><c r="C{k + 1}"><f>1+1</f><v>{b}</v></c></row>' for k, (_, b) in enumerate(rows))
    return _zipped({"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst>{strings}</sst>", "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{lines}</sheetData></worksheet>"})


@query("SELECT s_nationkey AS id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS row, s_name || ';;' || s_suppkey AS line FROM supplier")
def src_sheet(spark, d):
    from folio.sources import files

    @F.pandas_udf("binary")
    def books(cells: pd.Series) -> pd.Series:
        return cells.map(_workbook)

    cells = reports.joined(table(spark, d, "supplier"), ["s_nationkey"], F.expr("concat(s_name, ',', s_suppkey)"), ["s_suppkey"], ";", "cells")
    at = cells.select(F.col("s_nationkey").alias("id"), books("cells").alias("content"))
    return files.sheet_rows(at, "id", "content").select("id", "row", T.separated(F.col("cells")).alias("line"))


@query("SELECT s_suppkey AS id, unnest(['a.txt', 'b/c.txt']) AS name, unnest([s_name, CAST(s_nationkey AS VARCHAR)]) AS text FROM supplier")
def src_archive_entries(spark, d):
    from folio.sources import files

    @F.pandas_udf("binary")
    def archives(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_zipped({"top/a.txt": x, "top/b/c.txt": y, "else.txt": "3"}) for x, y in zip(a, b, strict=True)])

    at = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), archives("s_name", F.col("s_nationkey").cast("string")).alias("content"))
    return files.archive_entries(at, "id", "content", "top/").select("id", "name", F.decode("data", "UTF-8").alias("text"))


_ADOC_PATH = "CASE doc_id % 4 WHEN 0 THEN '_partials/' ELSE source || '/' END || 'p' || doc_id || CASE doc_id % 4 WHEN 1 THEN '.txt' ELSE '.adoc' END"


@query(f"SELECT path, lang || ' ' || doc_id AS title, CASE WHEN doc_id % 4 = 2 THEN 'out' || doc_id || '.html' ELSE replace(path, '.adoc', '.html') END AS output FROM (SELECT *, {_ADOC_PATH} AS path FROM documents) WHERE doc_id % 4 IN (2, 3)")
def src_markup_pages(spark, d):
    from folio.sources import files

    head = F.expr(r"concat('= ', lang, ' ', doc_id, IF(doc_id % 4 = 2, concat('\n:path: out', doc_id, '.html'), ''), '\n\n')")
    at = table(spark, d, "documents").select(F.expr(_ADOC_PATH).alias("path"), F.concat(head, "text").alias("text"))
    return files.markup_pages(at, "path", "text").select("path", "title", "output")


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN 'apache-' || p_type ELSE p_type END AS tool, p_size || '.' || p_partkey AS version FROM part WHERE p_partkey % 3 < 2")
def src_local_installs(spark, d):
    from folio.sources import files

    path = "concat('/h/', CASE p_partkey % 3 WHEN 0 THEN concat('apache-', p_type, '-', p_size, '.', p_partkey, '-bin.tar.gz_exploded') WHEN 1 THEN concat(p_type, '-', p_size, '.', p_partkey, '_exploded') ELSE concat(p_type, '-', p_size) END)"
    return files.local_installs(table(spark, d, "part").select(F.expr(path).alias("p")), "p")


@query("SELECT p_size || '.' || p_partkey AS folder FROM part WHERE p_partkey % 3 > 0 AND p_size || '.' || p_partkey <> '9.9'")
def src_version_folders(spark, d):
    from folio.sources import files

    at = table(spark, d, "part").select(F.expr("concat('/v/', IF(p_partkey % 3 = 0, 'css', ''), p_size, '.', p_partkey)").alias("p"))
    return files.version_folders(at, "p", ["9.9"], r"\d+(\.\d+)+")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image/svg+xml' WHEN 1 THEN 'image/webp' WHEN 2 THEN 'image/png' WHEN 3 THEN 'application/pdf' ELSE 'image/jpeg' END AS mime FROM part")
def src_mime(spark, d):
    from folio.sources import files

    path = F.expr("concat(p_name, CASE p_partkey % 5 WHEN 0 THEN '.SVG' WHEN 1 THEN '.webp' ELSE '' END)")
    content = F.expr("concat(CASE p_partkey % 5 WHEN 2 THEN X'89504E470D' WHEN 3 THEN X'25504446' WHEN 4 THEN X'FFD8FFE0' ELSE X'3C' END, CAST(p_name AS BINARY))")
    return table(spark, d, "part").select("p_partkey", files.mime_type(path, content).alias("mime"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN p_type ELSE p_type || '.version' END AS name, CAST(p_size AS VARCHAR) AS value FROM part")
def src_tool_settings(spark, d):
    from folio.sources import files

    at = table(spark, d, "part").select("p_partkey", F.expr("concat('/home/', p_partkey, IF(p_partkey % 2 = 0, '/.sdkmanrc', '/.yemrc'))").alias("file"), F.expr("IF(p_partkey % 4 IN (1, 2), concat(p_type, '.version'), p_type)").alias("name"), F.expr("CAST(p_size AS STRING)").alias("value"))
    return files.tool_settings(at, "file").select("p_partkey", "name", "value")


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || '.1' END AS java, CASE p_partkey % 3 WHEN 0 THEN '3.' || p_size END AS maven FROM part")
def src_pom_versions(spark, d):
    from folio.sources import files

    body = "CASE p_partkey % 3 WHEN 0 THEN concat('<rules><requireMavenVersion><version>[3.', p_size, ',)</version></requireMavenVersion><requireJavaVersion><version>[', p_size, ',</version></requireJavaVersion></rules>') WHEN 1 THEN concat('<maven.compiler.release> ', p_size, '.1 </maven.compiler.release>') ELSE '<project/>' END"
    return files.pom_versions(_body(spark, d, "part", "p_partkey", body), "id", "body")
