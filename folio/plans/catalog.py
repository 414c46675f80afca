"""Registered queries on the supplied tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions import versions as V
from folio.functions.stemming import STOP_WORDS
from folio.operators import filters, joins, ordering, reports, retrieval
from folio.operators import index as search_index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_NORM = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
_FOLD = r"regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g')"
_WORDS = f"list_filter(regexp_split_to_array({_FOLD}, '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ({_STOPS}))"


# Text functions


@query(f"SELECT item_id, {_NORM} AS normalized FROM benchmark")
def fn_normalize_query(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.normalize_query(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, md5({_FOLD}) AS digest FROM documents")
def fn_normalize_index(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_index(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT item_id, CAST(unnest(range(1, len(w) + 1)) AS BIGINT) AS ord, unnest(w) AS word FROM (SELECT item_id, list_filter(string_split({_NORM}, ' '), lambda x: x <> '' AND x NOT IN ({_STOPS})) AS w FROM benchmark)")
def fn_tokenize_query(spark, d):
    at = table(spark, d, "benchmark").select("item_id", F.posexplode(T.words(T.normalize_query(F.col("text")))).alias("ord", "word"))
    return at.select("item_id", (F.col("ord") + 1).cast("long").alias("ord"), "word")


@query(f"SELECT DISTINCT unnest({_WORDS}) AS raw FROM documents")
def agg_vocabulary(spark, d):
    return table(spark, d, "documents").select(F.explode(F.array_distinct(T.words(T.normalize_index(F.col("text"))))).alias("raw")).distinct()


@query(f"SELECT item_id, w AS word, count(*) AS n FROM (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark) GROUP BY ALL")
def agg_postings_raw(spark, d):
    at = table(spark, d, "benchmark").select("item_id", F.explode(T.word_positions(T.normalize_index(F.col("text")))).alias("w"))
    return at.groupBy("item_id", F.col("w.raw").alias("word")).agg(F.size(F.sort_array(F.collect_list("w.pos"))).cast("long").alias("n"))


@query("""SELECT doc_id, s AS seconds, CASE WHEN s // 60 > 0 THEN (s // 60) || ' min ' || CASE WHEN s % 60 > 0 THEN 'and ' || (s % 60) || ' sec ' ELSE '' END || 'read' WHEN s = 0 THEN 'quick read' ELSE s || ' sec read' END AS reading_time
FROM (SELECT doc_id, CAST(floor(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) / 3.5) AS INTEGER) AS s FROM documents)""")
def fn_reading_time(spark, d):
    return table(spark, d, "documents").select("doc_id", T.seconds_to_read(F.col("text")).alias("seconds"), T.reading_time(F.col("text")).alias("reading_time"))


@query(r"""SELECT p_partkey, replace(lower(left(p_name, 1)) || lower(regexp_replace(regexp_replace(substr(p_name, 2), '[^\p{L}\p{N}_$]', '-', 'g'), '([A-Z])', '-\1', 'g')), '--', '-') AS slug,
upper(left(p_type, 1)) || substr(regexp_replace(p_type, '([\p{Ll}\p{N}_$])([A-Z])', '\1 \2', 'g'), 2) AS human, '_' || regexp_replace(replace(lower(p_name), ' ', '_'), '[^\w]', '', 'g') AS title_id, regexp_replace(p_name, '[^A-Za-z0-9_-]', '_', 'g') AS id FROM part""")
def fn_names(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.human_name(F.col("p_type")).alias("human"), T.title_id(F.col("p_name")).alias("title_id"), T.identifier(F.col("p_name")).alias("id"))


@query("SELECT p_partkey, lower(p_name) AS low, upper(p_name) AS up, CASE WHEN length(p_name) > 9 THEN left(p_name, 6) || '...' ELSE p_name END AS cut FROM part")
def fn_case_truncate(spark, d):
    return table(spark, d, "part").select("p_partkey", T.lowercase(F.col("p_name")).alias("low"), T.uppercase(F.col("p_name")).alias("up"), T.truncate(F.col("p_name"), 9).alias("cut"))


def _entities(text: str) -> str:
    """Nested replacements of all named characters, the ampersand first."""
    from html.entities import codepoint2name

    for code in sorted(codepoint2name, key=lambda c: (c != 38, c)):
        text = f"replace({text}, chr({code}), '&{codepoint2name[code]};')"
    return text


@query(f"SELECT page_id, md5(replace(replace(replace(html, '&', '&#x26;'), '<', '&#x3C;'), '>', '&#x3E;')) AS xml, md5({_entities('html')}) AS html FROM pages")
def fn_escape(spark, d):
    digest = lambda c: F.md5(c.cast("binary"))
    return table(spark, d, "pages").select("page_id", digest(T.xml_escape(F.col("html"))).alias("xml"), digest(T.html_escape(F.col("html"))).alias("html"))


@query("SELECT doc_id, v AS category FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(lang || ' , ' || source || ',,', ','), lambda x: trim(x)), lambda x: x <> '')) AS v FROM documents)")
def agg_posts_by_category(spark, d):
    return reports.posts_by(table(spark, d, "documents"), F.concat("lang", F.lit(" , "), "source", F.lit(",,")), "category").select("doc_id", "category")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN date_trunc('day', o_orderdate) WHEN o_orderkey % 3 = 1 THEN date_trunc('second', o_orderdate) ELSE TIMESTAMP '2030-01-01 00:00:00' END AS published FROM orders""")
def fn_published(spark, d):
    at = table(spark, d, "orders")
    given = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(" ")
    return at.select("o_orderkey", T.published(given, F.lit("2030-01-01 00:00:00").cast("timestamp")).cast("timestamp_ntz").alias("published"))


@query("SELECT c_custkey, 'https://www.gravatar.com/avatar/' || md5(c_name || '@example.com') || '?d=identicon&size=64' AS url, sha256(c_name || '|' || c_mktsegment) AS id FROM customer")
def fn_digests(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.gravatar(F.concat("c_name", F.lit("@example.com"))).alias("url"), T.chunk_id(F.col("c_name"), F.col("c_mktsegment")).alias("id"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def fn_json_pointer(spark, d):
    return table(spark, d, "events").select("event_id", T.json_pointer(F.col("props"), "/k").alias("k"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:2] || string_split(text, chr(10))[2:] || string_split(text, chr(10))[1:1], chr(10)) AS lines FROM documents")
def fn_line_ranges(spark, d):
    return table(spark, d, "documents").select("doc_id", T.line_ranges(F.col("text"), "1..2;2..-1,1").alias("lines"))


@query("SELECT doc_id, round(((CASE WHEN contains(t, 'release') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'licenses') OR contains(t, 'license') THEN 1 ELSE 0 END)) / 2 + 0.3 * 0, 6) AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def fn_lexical_score(spark, d):
    primary, synonyms = T.query_terms(F.lit("release licenses"))
    return table(spark, d, "documents").select("doc_id", F.round(T.lexical_score(primary, synonyms, F.col("text")), 6).alias("score"))


@query("SELECT p_partkey, replace(regexp_replace(p_name, '[aeiou]+', '~', 'g'), ' ', '_') AS r FROM part")
def fn_replace(spark, d):
    return table(spark, d, "part").select("p_partkey", T.replaced(T.replaced(F.col("p_name"), "regex{[aeiou]+}", "~"), " ", "_").alias("r"))


@query("SELECT p_partkey, replace(replace('{brand} of {size} {none}', '{brand}', p_brand), '{size}', CAST(p_size AS VARCHAR)) AS filled FROM part")
def fn_attributes(spark, d):
    values = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", T.attributes_replaced(F.lit("{brand} of {size} {none}"), values).alias("filled"))


@query("SELECT c_custkey, c_name AS clear FROM customer")
def fn_codecs(spark, d):
    from folio.functions import codecs

    salt, iv, short = (F.unhex(F.lit(x)) for x in ("00" * 16, "01" * 12, "02" * 8))
    sealed = codecs.gcm_encrypt(codecs.cbc_encrypt(F.col("c_name"), "pass", short), "pass", salt, iv)
    return table(spark, d, "customer").select("c_custkey", codecs.cbc_decrypt(codecs.gcm_decrypt(sealed, "pass"), "pass").alias("clear"))


@query("SELECT p_partkey, 'Hello ' || p_brand || ', size ' || p_size || ' none {{{gone}}}' AS text FROM part")
def fn_template(spark, d):
    from folio.functions import markup

    values = F.create_map(F.lit("who"), F.lit("{{{brand}}}"), F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", markup.template(F.lit("Hello {{{who}}}, size {{{size:-0}}} {{{no:-none}}} ${{{gone}}}"), values).alias("text"))


# Filters and projections


@query("SELECT page_id FROM pages WHERE regexp_full_match(url, '.*[02468]') OR starts_with(url, 'https://site1') OR url IN ('x')")
def flt_rules(spark, d):
    return table(spark, d, "pages").where(filters.matches_any(F.col("url"), ["regex:.*[02468]", "prefix:https://site1", "x"])).select("page_id")


@query("SELECT p_partkey FROM part WHERE (regexp_full_match(p_brand, 'Brand#[1-3].*') OR lower(p_brand) = 'brand#44') AND NOT p_brand = 'Brand#11'")
def flt_include_exclude(spark, d):
    return table(spark, d, "part").where(filters.included(F.col("p_brand"), ["r:Brand#[1-3].*", "i:BRAND#44"], ["Brand#11"])).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE NOT list_contains(string_split(CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || ':index-skip: true' ELSE text END, chr(10)), ':index-skip: true')")
def flt_skip_mark(spark, d):
    at = table(spark, d, "documents").withColumn("page", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\n:index-skip: true"))).otherwise(F.col("text")))
    return at.where(~filters.skipped(F.col("page"))).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END, TIMESTAMP '1996-01-01') < TIMESTAMP '1996-01-01'")
def flt_visible(spark, d):
    given = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    return table(spark, d, "orders").where(filters.visible(given, F.lit("1996-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CASE l_linenumber % 6 WHEN 0 THEN 'compile' WHEN 1 THEN 'runtime' WHEN 2 THEN 'test' WHEN 3 THEN 'provided' WHEN 4 THEN 'system' ELSE 'import' END IN ('compile', 'runtime') AND l_returnflag = 'A'")
def flt_scope_group(spark, d):
    scope = F.element_at(F.array(*[F.lit(s) for s in ("compile", "runtime", "test", "provided", "system", "import")]), F.col("l_linenumber") % 6 + 1)
    return table(spark, d, "lineitem").where(filters.in_scope(scope, "runtime") & filters.in_group(F.col("l_returnflag"), "A")).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1996-03-01' AND regexp_full_match(o_orderpriority, '[12].*')")
def flt_commits(spark, d):
    return table(spark, d, "orders").where(filters.commit_in(F.to_utc_timestamp("o_orderdate", F.current_timezone()), F.current_timezone(), F.col("o_orderpriority"), "1995-03-01", "1996-03-01", "[12].*")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01' AND CAST(o_orderdate AS DATE) > DATE '1995-02-01' AND CAST(o_orderdate AS DATE) < DATE '1995-11-01'")
def flt_release_windows(spark, d):
    at = table(spark, d, "orders")
    return at.where(filters.released_between(F.col("o_orderdate").cast("timestamp"), "1995-01-01", None) & filters.released_within(F.to_date("o_orderdate"), "01/02/1995", "01/11/1995")).select("o_orderkey")


@query("SELECT c_custkey FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '[maven-release-plugin] prepare' WHEN 1 THEN 'Merge pull request #1' ELSE c_name END AS m FROM customer) WHERE NOT (starts_with(m, '[maven-release-plugin]') OR starts_with(m, 'skip changelog') OR starts_with(m, 'Merge pull request #'))")
def flt_noise(spark, d):
    m = F.when(F.col("c_custkey") % 4 == 0, "[maven-release-plugin] prepare").when(F.col("c_custkey") % 4 == 1, "Merge pull request #1").otherwise(F.col("c_name"))
    return table(spark, d, "customer").where(~filters.is_noise(m)).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' OR p_type = 'Brand#12' OR starts_with(p_brand, 'Brand#12')")
def flt_version_match(spark, d):
    return table(spark, d, "part").where(filters.version_matches(F.lit("Brand#12"), F.col("p_brand"), F.col("p_type"), F.lit(True))).select("p_partkey")


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN 'big' WHEN p_brand = 'Brand#11' THEN 'eleven' ELSE 'other' END AS branch FROM part")
def flt_conditions(spark, d):
    attrs = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    branches = [(filters.condition(attrs, "ifeval", "{size} > 20"), F.lit("big")), (filters.condition(attrs, "ifeval", '"{brand}" == "Brand#11"') & filters.condition(attrs, "ifdef", "brand"), F.lit("eleven"))]
    return table(spark, d, "part").select("p_partkey", filters.first_branch(branches, F.lit("other")).alias("branch"))


@query("WITH s AS (SELECT c_nationkey, c_custkey, c_acctbal / 10000 AS score FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_custkey) AS rank FROM s) SELECT c_nationkey, c_custkey, rank FROM r WHERE rank <= 4 AND (score >= 0.95 OR rank = 1)")
def flt_best_with_fallback(spark, d):
    at = table(spark, d, "customer").withColumn("score", F.col("c_acctbal") / 10000)
    return ordering.best_with_fallback(at, "c_nationkey", "score", 0.95, 4, "c_custkey").select("c_nationkey", "c_custkey", F.col("rank").cast("long"))


@query("SELECT o_orderkey, '* ' || left(md5(CAST(o_orderkey AS VARCHAR)), 7) || ' ' || o_orderpriority AS line FROM orders")
def prj_commit_line(spark, d):
    at = table(spark, d, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("sha"), F.lit("n").alias("name"), F.lit("m").alias("email"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("message"))
    return at.select("o_orderkey", reports.commit_line(["star", "short_sha", "space", "first_line"]).alias("line"))


# Joins and lookups


@query("SELECT DISTINCT a.w AS wanted, b.w AS raw, CAST(levenshtein(b.w, a.w) AS INTEGER) AS distance FROM (SELECT unnest(['blak', 'gren', 'stel', 'brush']) AS w) a, (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part) b WHERE levenshtein(b.w, a.w) BETWEEN 1 AND 2")
def jn_fuzzy_terms(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("raw")).distinct()
    wanted = spark.createDataFrame([("blak",), ("gren",), ("stel",), ("brush",)], "wanted string")
    return joins.fuzzy(words, wanted, "raw", "wanted").select("wanted", "raw", "distance")


@query("SELECT q.vec_id AS query_id, v.vec_id AS id, v.rank, v.cos FROM (SELECT a.vec_id AS q, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) v JOIN embeddings q ON q.vec_id = v.q WHERE v.rank <= 15")
def jn_vector_top_k(spark, d):
    at = table(spark, d, "embeddings")
    asked = at.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.similar(asked, at.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 15).select("query_id", "id", F.col("rank").cast("long"), "cos")


@query("SELECT request_id, s_suppkey FROM (SELECT c_custkey AS request_id, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY s_suppkey % 3, s_suppkey % 2 = 0, s_suppkey) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_acctbal > c_acctbal) WHERE n = 1")
def jn_resolution(spark, d):
    requests = table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_nationkey").alias("tool"), "c_acctbal")
    versions = table(spark, d, "supplier").select(F.col("s_nationkey").alias("tool"), "s_suppkey", "s_acctbal", (F.col("s_suppkey") % 3).alias("provider_rank"), (F.col("s_suppkey") % 2 == 0).alias("is_remote"), F.col("s_suppkey").alias("pos"))
    return joins.resolved_above(requests, versions, "c_acctbal", "s_acctbal").select("request_id", "s_suppkey")


@query("SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY r) AS n FROM (SELECT s_nationkey AS k, s_name AS v, s_suppkey AS r FROM supplier UNION ALL SELECT c_nationkey, c_name, 1000000 + c_custkey FROM customer)) WHERE n = 1")
def jn_overrides(spark, d):
    first = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("v"), F.col("s_suppkey").cast("long").alias("r"))
    second = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("v"), (F.col("c_custkey") + 1_000_000).alias("r"))
    return joins.overridden(first.unionByName(second), "k", "r").select("k", "v")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'create' WHEN c_custkey % 2 = 0 THEN 'unchanged' ELSE 'update' END AS action FROM customer")
def jn_update_plan(spark, d):
    wanted = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("content"))
    existing = wanted.where("c_custkey % 3 <> 0").withColumn("content", F.when(F.col("c_custkey") % 2 == 0, F.col("content")).otherwise("old"))
    return joins.update_plan(wanted, existing, "c_custkey", "content")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jn_missing(spark, d):
    return joins.missing(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def jn_authored(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("WITH t AS (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders) SELECT t.o_orderkey, count(*) AS n FROM t JOIN (SELECT o_custkey, o_orderdate AS ts FROM orders) c ON c.o_custkey = t.o_custkey AND (t.previous IS NULL OR c.ts > t.previous) AND c.ts <= t.o_orderdate GROUP BY ALL")
def jn_between_tags(spark, d):
    tags = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("until"))
    bounds = joins.with_previous(tags, "o_custkey", F.struct("until", "o_orderkey"), "until").withColumnRenamed("previous", "since")
    commits = tags.select("o_custkey", F.col("until").alias("ts"))
    return joins.between_tags(commits, bounds, "ts", "since", "until", "o_custkey").groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, replace(replace('see ' || c_mktsegment, 'BUILDING', '/b'), 'MACHINERY', '/m') AS content FROM customer")
def jn_links(spark, d):
    pages = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("see "), "c_mktsegment").alias("content"))
    rules = spark.createDataFrame([(1, "BUILDING", "/b"), (2, "MACHINERY", "/m")], "seq int, regex string, url string")
    return joins.links_rewritten(pages, rules, "content")


@query("SELECT c_custkey, n_name, coalesce(s_name, 'none') AS s_name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_suppkey = c_custkey")
def jn_lookups(spark, d):
    at = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return at.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left").select("c_custkey", "n_name", F.coalesce("s_name", F.lit("none")).alias("s_name"))


# Aggregations


@query("SELECT lower(c_mktsegment) AS key, min_by(c_mktsegment, c_custkey) AS name, count(*) AS commits FROM customer GROUP BY ALL")
def agg_commits_by_author(spark, d):
    at = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.concat(F.lower("c_mktsegment"), F.lit("@x.org")).alias("email"), F.col("c_custkey").alias("seq"))
    return reports.commits_by_author(at)


@query("SELECT user_id % 10 AS suite, count(*) AS executed, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed, round(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) / count(*), 6) AS passed_share, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS nanos, min(ts) AS first_start FROM events GROUP BY ALL")
def agg_run_summary(spark, d):
    at = table(spark, d, "events").select((F.col("user_id") % 10).alias("suite"), F.when(F.col("event_type") == "click", "passed").when(F.col("event_type") == "error", "failed").otherwise("undefined").alias("status"), F.floor(F.col("value") * 100).alias("nanos"), F.col("ts").alias("start"))
    return reports.run_summary(at, ["suite"]).withColumn("passed_share", F.round("passed_share", 6))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY ALL")
def agg_status_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings), m AS (SELECT label, i, avg(v::DOUBLE) AS m FROM e GROUP BY ALL) SELECT label, CAST(i AS BIGINT) AS i, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 5) AS v FROM m")
def agg_mean_pooling(spark, d):
    at = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "value")).withColumn("value", F.col("value").cast("double")).withColumn("mask", F.lit(1))
    out = retrieval.pooled(at, "label", "i", "value", "mask").select("label", F.posexplode("v").alias("i", "v"))
    return out.select("label", (F.col("i") + 1).cast("long").alias("i"), F.round(F.col("v").cast("double"), 5).alias("v"))


@query("SELECT 'Title: Overview' || chr(10) || 'Content:' || chr(10) || 'This documentation covers the following topics, modules and features: ' || string_agg(source, ', ' ORDER BY s, source) || '.' AS text FROM (SELECT source, min(doc_id) AS s FROM documents GROUP BY source)")
def agg_overview(spark, d):
    return retrieval.overview(table(spark, d, "documents"), "source", "doc_id").select("text")


@query("SELECT l_orderkey, string_agg(l_shipmode, ',' ORDER BY l_linenumber, l_shipmode) AS tags FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY ALL")
def agg_joined_tags(spark, d):
    return reports.joined(table(spark, d, "lineitem"), ["l_orderkey"], F.concat("l_returnflag", "l_linestatus"), ["l_linenumber", F.concat("l_returnflag", "l_linestatus")], ",", "tags")


@query("SELECT p_brand, array_to_string(list_sort(coalesce(list(DISTINCT p_type) FILTER (p_size < 10), [])), ',') AS primitives, array_to_string(list_sort(coalesce(list(DISTINCT p_type) FILTER (p_size BETWEEN 10 AND 30), [])), ',') AS objects FROM part GROUP BY ALL")
def agg_by_kind(spark, d):
    kind = F.when(F.col("p_size") < 10, "string").when(F.col("p_size") <= 30, "object").otherwise("array")
    at = table(spark, d, "part").select("p_brand", "p_type", kind.alias("kind")).distinct()
    return reports.by_kind(at, "p_brand", "p_type", "kind").select("p_brand", F.array_join("primitives", ",").alias("primitives"), F.array_join("objects", ",").alias("objects"))


@query("SELECT tool, string_agg(version, ', ' ORDER BY v DESC) AS versions FROM (SELECT DISTINCT c_nationkey AS tool, CAST(c_custkey % 20 AS VARCHAR) || '.1' AS version, c_custkey % 20 AS v FROM customer) GROUP BY ALL")
def agg_versions_by_tool(spark, d):
    at = table(spark, d, "customer").select(F.col("c_nationkey").alias("tool"), F.concat((F.col("c_custkey") % 20).cast("string"), F.lit(".1")).alias("version"))
    return reports.versions_by_tool(at, V.tool_key(F.col("version")))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS number FROM lineitem")
def agg_counters(spark, d):
    return reports.running_number(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", F.col("number").cast("long"))


@query("SELECT lang, string_agg(source, chr(10) ORDER BY source) AS text FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY ALL")
def agg_distinct_concat(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), "\n").alias("text"))


# Positions


_BLOG = "row_number() OVER (ORDER BY o_orderdate, o_orderkey)"


@query(f"SELECT o_orderkey, {_BLOG} AS rank, lag(o_orderkey) OVER (ORDER BY o_orderdate, o_orderkey) AS previous, lead(o_orderkey) OVER (ORDER BY o_orderdate, o_orderkey) AS next FROM orders")
def win_neighbours(spark, d):
    ranked = ordering.numbered(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")
    return ordering.neighbours(ranked, "o_orderkey").select("o_orderkey", "rank", "previous", "next")


@query(f"SELECT o_orderkey, CAST(({_BLOG} - 1) // 10 + 1 AS BIGINT) AS page, CAST(ceil(count(*) OVER () / 10) AS BIGINT) AS pages FROM orders")
def win_pages(spark, d):
    at = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return ordering.paged(ordering.numbered(at, "o_orderdate", "o_orderkey"), 0, at.count()).select("o_orderkey", "page", "pages")


@query("SELECT doc_id, source, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 7 + 1 AS BIGINT) AS page, CAST(ceil(count(*) OVER (PARTITION BY source) / 7) AS BIGINT) AS pages FROM documents")
def win_pages_by_category(spark, d):
    return ordering.paged_within(table(spark, d, "documents").select("doc_id", "source"), "source", 7, "doc_id")


@query("SELECT page_id, CAST(row_number() OVER (ORDER BY url, page_id) - 1 AS BIGINT) AS doc_idx FROM pages")
def win_ordinal(spark, d):
    return ordering.numbered(table(spark, d, "pages").select("page_id", "url"), "url", "page_id").select("page_id", (F.col("rank") - 1).alias("doc_idx"))


@query("SELECT l_orderkey, l_linenumber, last_value(nullif(v, '') IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vendor FROM (SELECT *, CASE WHEN l_linenumber % 3 = 1 THEN l_returnflag ELSE '' END AS v FROM lineitem)")
def win_fill_down(spark, d):
    at = table(spark, d, "lineitem").withColumn("vendor", F.when(F.col("l_linenumber") % 3 == 1, F.col("l_returnflag")).otherwise(" "))
    return ordering.filled_down(at, "l_orderkey", "vendor", "l_linenumber", "l_partkey", "l_extendedprice").select("l_orderkey", "l_linenumber", "vendor")


@query("SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS previous FROM orders")
def win_previous_version(spark, d):
    return joins.with_previous(table(spark, d, "orders"), "o_custkey", F.struct("o_totalprice", "o_orderkey"), "o_orderkey").select("o_orderkey", "previous")


@query("""WITH s AS (SELECT user_id, greatest(0, p - 55) AS a, p + 55 AS b FROM (SELECT user_id, CAST(floor(value * 100) AS BIGINT) AS p FROM events)),
h AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM s),
i AS (SELECT *, sum(CASE WHEN a <= high THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM h)
SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS n FROM i GROUP BY user_id, island""")
def win_merged_intervals(spark, d):
    p = F.floor(F.col("value") * 100)
    at = table(spark, d, "events").select("user_id", F.greatest(F.lit(0), p - 55).alias("a"), (p + 55).alias("b"))
    return ordering.merged_intervals(at, "user_id", "a", "b")


@query("WITH u AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), c AS (SELECT *, max(CASE WHEN used > 1500 AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS cut FROM u) SELECT conv_id, turn FROM c WHERE cut = 0")
def win_context_budget(spark, d):
    at = table(spark, d, "conversations").withColumn("size", F.length("text"))
    return ordering.within_budget(at, "conv_id", "size", 1500, "turn").select("conv_id", "turn")


# Orders, sets, sinks


@query("SELECT c_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) JOIN customer ON o_custkey = c_custkey WHERE n <= 3")
def ord_top_k(spark, d):
    top = ordering.best_with_fallback(table(spark, d, "orders"), "o_custkey", "o_totalprice", float("-inf"), 3, "o_orderkey")
    return top.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


@query("SELECT p_type, min_by(p_name, p_retailprice * 1000000 + p_partkey) AS first FROM part GROUP BY ALL")
def ord_first_match(spark, d):
    return ordering.first_of(table(spark, d, "part"), ["p_type"], F.col("p_retailprice") * 1000000 + F.col("p_partkey")).select("p_type", F.col("p_name").alias("first"))


@query("SELECT 1 AS section, n_name AS name FROM nation UNION ALL SELECT 2, r_name FROM region UNION ALL SELECT 3, s_name FROM supplier")
def set_sections(spark, d):
    part = lambda k, t, c: table(spark, d, t).select(F.lit(k).alias("section"), F.col(c).alias("name"))
    return part(1, "nation", "n_name").unionByName(part(2, "region", "r_name")).unionByName(part(3, "supplier", "s_name"))


@query("SELECT DISTINCT lang, source FROM documents EXCEPT SELECT 'en', source FROM documents WHERE doc_id % 2 = 0")
def set_distinct_except(spark, d):
    at = table(spark, d, "documents")
    return joins.missing(at.select("lang", "source").distinct(), at.where("doc_id % 2 = 0").select(F.lit("en").alias("lang"), "source"), ["lang", "source"])


@query("SELECT p_partkey, p_brand AS a, 'x' AS b, CAST(p_size AS VARCHAR) AS c FROM part")
def set_map_union(spark, d):
    late = F.create_map(F.lit("a"), F.col("p_brand"), F.lit("c"), F.col("p_size").cast("string"))
    early = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("x"))
    merged = F.map_from_entries(F.concat(F.filter(F.map_entries(early), lambda e: ~F.map_contains_key(late, e["key"])), F.map_entries(late)))
    return table(spark, d, "part").select("p_partkey", *[F.element_at(merged, k).alias(k) for k in "abc"])


@query("SELECT coalesce(CASE WHEN page_id % 5 <> 0 THEN url END, '') AS title, url AS path, CASE WHEN page_id % 2 = 0 THEN DATE '2024-01-01' ELSE DATE '2025-05-05' END AS lastmod FROM pages")
def snk_sitemap(spark, d):
    at = table(spark, d, "pages").select(F.when(F.col("page_id") % 5 != 0, F.col("url")).alias("t"), "url", F.when(F.col("page_id") % 2 == 0, F.lit("2024-01-01").cast("date")).alias("m"))
    return reports.sitemap(at, "t", "url", "m", F.lit("2025-05-05").cast("date"))


@query("SELECT '# llms' || chr(10) || string_agg(url, chr(10) ORDER BY url) AS value FROM pages")
def snk_llms_text(spark, d):
    return reports.joined(table(spark, d, "pages"), [], F.col("url"), ["url"], "\n", "v").select(F.concat(F.lit("# llms\n"), "v").alias("value"))


@query("SELECT s_suppkey, '{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\"}' AS value FROM supplier")
def snk_json(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.to_json(F.struct("s_suppkey", "s_name")).alias("value"))


# Sources on fixtures


@query("SELECT o_custkey AS project, o_orderpriority AS name, min_by(o_orderkey, (o_orderkey % 4) * 100000000 + o_orderkey) AS id FROM orders GROUP BY ALL")
def src_releases_by_name(spark, d):
    from folio.sources import text_formats

    at = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("page"))
    return text_formats.releases_by_name(at, ["project", "name"]).select("project", "name", "id")


# Search, documents and drawings


@query()
def search_pages(spark, d):
    """The best pages for each text of benchmark, with their snippets."""
    index = search_index.build(table(spark, d, "pages").select("url", "html"), body="article")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = search_index.search(index, asked)
    return search_index.snippets(hits, index.docs, ["home", "license"]).join(index.docs.select("doc_idx", "url", "title"), "doc_idx").drop("positions")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def str_windows(spark, d):
    from folio.streaming import watch

    at = watch.windowed(table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")), "at", "event_type")
    return at.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
