"""The queries of this subpackage, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import oracle
from folio.llm.common import modest_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import quality
    from folio.llm.common import fold

    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import secret_scan

    return secret_scan.digests(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm.piece_codec import digests, encode_decode

    return digests(encode_decode(_table(spark, sf_dir, "documents"), read_bytes(tokenizer_path("piece_bpe_32k.model"))))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import license_scan

    return license_scan.digests(license_scan.scan(_table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import toxicity
    from folio.llm.common import fold

    docs = _table(spark, sf_dir, "documents")
    net = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    limit = toxicity.threshold(net, F.col("lang"))
    return toxicity.score(docs, net).select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), limit.alias("lang_threshold"), (F.col("score") >= limit).alias("flagged"))


def op4_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import ann_tree

    return ann_tree.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import near_dup

    return near_dup.components(_table(spark, sf_dir, "documents"))


def op8_token_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole text, and after an edit of its kept tree: the middle character becomes EDIT."""
    import public_tokenizers

    from folio.llm import token_tree
    from folio.llm.common import stored

    ranks, pattern = read_bytes(tokenizer_path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    trees = stored(token_tree.built(_table(spark, sf_dir, "documents"), ranks, pattern), "trees")
    middle = (F.col("n_chars") / 2).cast("int")
    edit = F.array(F.struct(middle.alias("start"), (middle + 1).alias("stop"), F.lit(EDIT).alias("text")))
    return token_tree.edited(trees, edit, ranks, pattern, keep=False).select("doc_id", *[F.col(f"{c}_before").alias(c) for c in ("n_chars", "n_pretokens", "n_tokens")], F.col("n_tokens").alias("n_tokens_edited"), "n_reencoded", "n_touched")


#: What op8_token_tree puts into the middle of each text.
EDIT = " (edited 2024) "
#: Parameters of op10_mixing: weights by level (others weigh 10), share of all tokens, epochs at most.
MIX_WEIGHTS = {"domain": {"d0": 20}, "lang": {"en": 40, "de": 25, "fr": 20, "es": 15}}
MIX_SHARE, MIX_EPOCHS = 0.75, 4


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import mixing

    docs = _table(spark, sf_dir, "documents")
    return mixing.mixed(docs, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS).where("copies > 0").drop("row")


def op9_pivot_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.llm import pivot_dup

    return pivot_dup.linked(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_secret_scan": op3_secret_scan,
    "op4_ann_tree": op4_ann_tree,
    "op5_near_dup": op5_near_dup,
    "op6_piece_codec": op6_piece_codec,
    "op7_license_scan": op7_license_scan,
    "op8_token_tree": op8_token_tree,
    "op9_pivot_dup": op9_pivot_dup,
    "op10_mixing": op10_mixing,
}


def _mixing_sql() -> str:
    levels = [(level, MIX_WEIGHTS.get(level, {})) for level in ("domain", "lang", "source")]
    sql = rf"""WITH d AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
    'd' || (ascii(right(coalesce(source, 'unknown'), 1)) % 4) AS domain,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {MIX_EPOCHS})::BIGINT AS cap FROM d GROUP BY ALL),
t0 AS (SELECT *, floor(sum(tokens) OVER () * {MIX_SHARE})::BIGINT AS budget FROM leaves)"""
    for i, (name, weights) in enumerate(levels):
        path = [x for x, _ in levels[: i + 1]]
        group = f"PARTITION BY {', '.join(path[:-1])}" if i else ""
        weight = "CASE" + "".join(f" WHEN {name} = '{k}' THEN {v}" for k, v in sorted(weights.items())) + " ELSE 10 END" if weights else "10"
        sql += f""",
n{i} AS (SELECT {', '.join(path)}, sum(cap)::BIGINT AS cap, first(budget) AS budget, {weight} AS w FROM t{i} GROUP BY {', '.join(path)}),
a{i} AS (SELECT *, coalesce(sum(cap) OVER ({group} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  sum(w) OVER ({group} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM n{i}),
b{i} AS (SELECT *, cap::HUGEINT * open_w <= w::HUGEINT * (budget - filled) AS filled_up FROM a{i}),
c{i} AS (SELECT *, greatest(0, budget - sum(CASE WHEN filled_up THEN cap ELSE 0 END) OVER ({group})) AS rest,
  sum(CASE WHEN filled_up THEN 0 ELSE w END) OVER ({group}) AS rest_w FROM b{i}),
e{i} AS (SELECT *, CASE WHEN filled_up THEN cap WHEN rest_w > 0 THEN (w::HUGEINT * rest) // rest_w ELSE 0 END AS part FROM c{i}),
f{i} AS (SELECT *, rest - sum(CASE WHEN filled_up THEN 0 ELSE part END) OVER ({group}) AS spare,
  row_number() OVER ({group + ' ' if group else ''}ORDER BY CASE WHEN filled_up THEN 1 ELSE 0 END, {name}) AS turn FROM e{i}),
g{i} AS (SELECT {', '.join(path)}, (part + CASE WHEN NOT filled_up AND turn <= spare THEN 1 ELSE 0 END)::BIGINT AS budget FROM f{i}),
t{i + 1} AS (SELECT t.* EXCLUDE (budget), g.budget FROM t{i} t JOIN g{i} g USING ({', '.join(path)}))"""
    return sql + """,
p AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM t3),
r AS (SELECT d.*, p.epochs, p.tokens, p.budget - p.epochs * p.tokens AS rest, md5('17|' || p.epochs || '|' || d.doc_id) AS turn FROM d JOIN p USING (domain, lang, source)),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY turn) AS upto FROM r),
o AS (SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN upto <= rest AND (rest > 0 OR tokens = 0) THEN 1 ELSE 0 END)::BIGINT AS copies FROM s)
SELECT * FROM o WHERE copies > 0"""


ORACLE_SQL: dict[str, str] = {"op5_near_dup": oracle.near_dup_sql(), "op7_license_scan": oracle.license_sql(), "op9_pivot_dup": oracle.linked_vectors_sql(), "op10_mixing": _mixing_sql()}
