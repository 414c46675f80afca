"""A training corpus from raw documents: quality, near-duplicates, secrets, mixture, tokens.

Null texts count as empty: they get a score like any other, link with nothing, hold no secrets, have no tokens and no
ids. Rows with a null id are never removed as copies. Null languages and sources are the group "unknown" of the mixture.
Of rows with one id and equal texts one stays; several texts of an id are documents each. Ties of scores all pass; of a
group of near copies the smallest id stays, of its texts the one with the smallest hash. Empty tables give empty tables.
All stages but the last keep all columns of the documents, whatever their names; rows that the mixture takes several
times are repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import mixing, near_dup, piece_codec, quality, secret_scan
from folio.llm.common import modest_batches, stored
from folio.llm.queries import read_bytes, tokenizer_path

#: Score below which a document is rejected.
LEAST_QUALITY = 0.3
#: Weights within a level of the mixture; names that aren't listed weigh 10.
WEIGHTS = {"lang": {"en": 60, "de": 15, "fr": 15, "es": 10}}
#: Tokens of the mixture as a share of those available, and how often a row is taken at most.
BUDGET_SHARE, MAX_EPOCHS = 1.0, 2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality is at least LEAST_QUALITY."""
    modest_batches(spark)
    return quality.keep_scored(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), LEAST_QUALITY)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    modest_batches(spark)
    return near_dup.keep_first(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mask."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.repeated(mixing.mixed(docs, WEIGHTS, BUDGET_SHARE, MAX_EPOCHS), docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and digests of the ids and of the decoded text."""
    modest_batches(spark)
    encoded = piece_codec.encode_decode(docs, read_bytes(tokenizer_path("piece_bpe_32k.model")))
    return encoded.select("doc_id", "ids", *piece_codec.digest_columns())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encode_stage),
]

#: The classifier, Jaccard components on the text and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else stored(docs, f"stage{k}"), sf_dir)
    return docs
