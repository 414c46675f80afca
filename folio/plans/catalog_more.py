"""Registered queries on the remaining sources, filters and small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import filters, joins, ordering, reports, retrieval
from folio.plans.catalog import query, table


@query("SELECT c_custkey, n_name, CASE WHEN s_suppkey IS NOT NULL THEN s_name END AS detail FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_suppkey = c_custkey")
def src_environments(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select("c_custkey", "n_name")
    return joins.with_detail(rows, table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("detail")), ["c_custkey"])


@query("SELECT c_custkey AS id, c_name AS name, o.n AS contributions FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE trim(CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END) <> ''")
def src_contributors(spark, d):
    users = table(spark, d, "customer").withColumn("url", F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_name")))
    made = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("contributions"))
    return users.where(F.trim("url") != "").join(made, "c_custkey").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "contributions")


@query("SELECT doc_id FROM documents WHERE lang IN ('fr', 'de') OR source = 'src1'")
def src_topics(spark, d):
    topics = F.array("lang", "source")
    return table(spark, d, "documents").where(F.arrays_overlap(topics, F.array(*[F.lit(x) for x in ("fr", "de", "src1")]))).select("doc_id")


@query("SELECT user_id, max(ts) AS ts FROM events WHERE event_id % 3 <> 0 GROUP BY user_id")
def agg_last_updated(spark, d):
    from folio.sources import files

    at = table(spark, d, "events").withColumn("path", F.concat(F.when(F.col("event_id") % 3 == 0, "a/target/").otherwise("a/src/"), F.col("event_id").cast("string")))
    return files.last_updated(at, "path", "ts", "user_id")


@query("SELECT page_id FROM pages WHERE NOT (page_id % 4 = 0)")
def flt_listing_pages(spark, d):
    path = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/blog/page-"), F.col("page_id").cast("string"), F.lit(".html"))).otherwise(F.col("url"))
    return table(spark, d, "pages").where(~filters.listing_page(path)).select("page_id")


@query("SELECT p_partkey, p_size AS position FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0")
def flt_attributes(spark, d):
    attrs = F.map_filter(F.create_map(F.lit("skip"), F.when(F.col("p_partkey") % 3 == 0, "x"), F.lit("index"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string"))), lambda k, v: v.isNotNull())
    at = table(spark, d, "part").withColumn("a", attrs)
    return at.where(~filters.skip_attribute(F.col("a")) & F.map_contains_key("a", "index")).select("p_partkey", F.element_at("a", "index").cast("int").alias("position"))


@query("SELECT s_suppkey FROM supplier WHERE s_name IN ('Supplier#000000001', 'Supplier#000000002')")
def flt_names(spark, d):
    return table(spark, d, "supplier").where(filters.named(F.col("s_name"), "Supplier#000000001, Supplier#000000002")).select("s_suppkey")


@query("SELECT p_partkey, p_brand AS a, '' AS b, 'f' AS c FROM part")
def prj_interpolation(spark, d):
    attrs = F.create_map(F.lit("brand"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", T.interpolated(attrs, "brand").alias("a"), T.interpolated(attrs, "none?emptyIfMissing=true").alias("b"), T.interpolated(attrs, "none?ignoreErrors=true", F.lit("f")).alias("c"))


@query("SELECT s_suppkey, '{\"provider\":\"' || s_name || '\",\"tool\":' || s_nationkey || '}' AS model FROM supplier")
def prj_tool_model(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_name").alias("provider"), F.col("s_nationkey").alias("tool"))).alias("model"))


@query("SELECT n_name, row_number() OVER (ORDER BY CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey ELSE -1 END, n_name) AS rank FROM nation")
def ord_categories(spark, d):
    at = table(spark, d, "nation").select("n_name", F.coalesce(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey")), F.lit(-1)).alias("o"))
    return ordering.numbered(at, "o", "n_name").select("n_name", "rank")


@query("SELECT p_partkey, 'a=' || p_brand || ';b=' || p_size AS sorted FROM part")
def ord_properties(spark, d):
    entries = F.array_sort(F.map_entries(F.create_map(F.lit("b"), F.col("p_size").cast("string"), F.lit("a"), F.col("p_brand"))))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("sorted"))


@query("SELECT '{\"model\":\"m\",\"dimension\":64,\"files\":[\"chunk-0001.json\"],\"totalChunks\":' || count(*) || '}' AS value FROM embeddings")
def snk_manifest(spark, d):
    return retrieval.manifest(table(spark, d, "embeddings"), "m", 64)


@query("SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS label FROM embeddings")
def snk_upsert(spark, d):
    at = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return retrieval.upserted(at, at.where("id % 10 = 0").withColumn("label", F.lit(-1)))


@query("SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, chr(10) ORDER BY l_linenumber, l_returnflag) AS text FROM lineitem GROUP BY 1")
def snk_joined_text(spark, d):
    return reports.joined(table(spark, d, "lineitem"), ["l_orderkey"], F.concat("l_returnflag", F.col("l_linenumber").cast("string")), ["l_linenumber", "l_returnflag"], "\n", "text")
