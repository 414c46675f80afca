"""Registered queries on files, schemas, tokens and sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.plans.catalog import query, table


@query("SELECT event_id, rtrim(replace(replace(base64(encode(event_type || '?' || event_id)), '+', '-'), '/', '_'), '=') AS key, event_id % 100 < 50 AS expired FROM events")
def src_cache(spark, d):
    from folio.sources import files

    at = table(spark, d, "events").select("event_id", files.cache_key(F.concat("event_type", F.lit("?"), F.col("event_id").cast("string"))).alias("key"), (F.col("event_id") % 100).alias("valid_until"))
    return files.cached(at, F.lit(50)).select("event_id", "key", "expired")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'old' || s_suppkey ELSE 'new' || s_suppkey END AS cipher FROM supplier")
def jn_cipher_reuse(spark, d):
    from folio.functions import codecs

    key = F.col("s_suppkey").cast("string")
    old = F.concat(F.lit("old"), key)
    return table(spark, d, "supplier").select("s_suppkey", codecs.reused(F.col("s_name"), old, F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("else"), F.concat(F.lit("new"), key)).alias("cipher"))


@query("SELECT page_id, upper(left(md5(url), 4)) AS short FROM pages")
def udf_registry(spark, d):
    """A scalar plug-in by name: registered once, used from SQL."""
    spark.udf.register("folio_short", lambda s: None if s is None else s[:4].upper(), "string")
    return table(spark, d, "pages").select("page_id", F.expr("folio_short(md5(CAST(url AS BINARY)))").alias("short"))
