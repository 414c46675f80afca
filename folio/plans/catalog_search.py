"""Registered queries on chunks, retrieval, indexes and sites, on services' pages, and plain table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions.stemming import STOP_WORDS
from folio.operators import index, retrieval
from folio.plans.catalog import query, table
from folio.plans.catalog_texts import _list, _terms_sql


@query(r"""WITH RECURSIVE b AS (SELECT doc_id, source, regexp_replace(text, '\s+', ' ', 'g') AS body FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
s(doc_id, seq, a) AS (SELECT doc_id, 0, CAST(0 AS BIGINT) FROM b UNION ALL
  SELECT doc_id, seq + 1, CASE WHEN e - 120 > a THEN e - 120 ELSE e END FROM (
    SELECT doc_id, seq, a, n, CASE WHEN raw < n AND k > 0 AND raw + 1 - k > a + 200 THEN raw + 2 - k ELSE raw END AS e FROM (
      SELECT s.doc_id, seq, a, length(body) AS n, least(a + 800, length(body)) AS raw, strpos(reverse(substr(body, a + 1, least(a + 800, length(body)) + 1 - a)), '.') AS k FROM s JOIN b USING (doc_id))) WHERE e < n),
w AS (SELECT doc_id, seq, source, a, body, CASE WHEN raw < length(body) AND k > 0 AND raw + 1 - k > a + 200 THEN raw + 2 - k ELSE raw END AS e FROM (
  SELECT s.doc_id, seq, a, source, body, least(a + 800, length(body)) AS raw, strpos(reverse(substr(body, a + 1, least(a + 800, length(body)) + 1 - a)), '.') AS k FROM s JOIN b USING (doc_id))),
t AS (SELECT '/' || doc_id || '.html#' || seq AS url, source AS title, seq, regexp_replace('Title: ' || source || chr(10) || 'Content:' || chr(10) || substr(body, a + 1, e - a), '^\s+|\s+$', '', 'g') AS text FROM w)
SELECT sha256(text || '|' || url) AS id, text, url, title, seq FROM t""")
def win_chunks(spark, d):
    at = table(spark, d, "documents")
    return retrieval.chunks(at, F.col("source"), F.regexp_replace("text", r"\s+", " "), F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".html")))


_ASKED = "What features and extensions are released?"


def _share(terms: str) -> str:
    return f"CASE WHEN len({terms}) = 0 THEN 0 ELSE len(list_filter({terms}, lambda x: contains(low, x) OR contains(low, regexp_replace(x, 's$', '')))) / len({terms}) END"


@query(f"""WITH a AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, '{_ASKED}' AS q FROM embeddings WHERE vec_id % 100 = 0), {_terms_sql('a')},
b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS w, source AS title, text, '/' || doc_id AS url, lower(source || chr(10) || text) AS low FROM embeddings JOIN documents ON doc_id = vec_id),
s AS (SELECT query_id, id, title, text, url, round(list_cosine_similarity(v, w) + 0.5 * ({_share('terms')} + 0.3 * {_share('synonyms')}), 6) AS score FROM q, b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
k AS (SELECT query_id, rank, 'From [' || title || '](' || url || '):' || chr(10) || substr(text, 1, 700) AS block FROM r WHERE rank <= 4 AND (score >= 0.15 OR rank = 1)),
u AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM k)
SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM u WHERE used <= 1500 OR rank = 1 GROUP BY query_id""")
def search_retrieval(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text", F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("url"))
    asked = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.lit(_ASKED).alias("question"), F.col("v").alias("q"))
    return retrieval.contexts(retrieval.with_texts(retrieval.hybrid(asked, texts, vectors, 4), texts))


def _pages(spark, d) -> DataFrame:
    """Pages made of the documents, so that SQL knows their fields."""
    html = F.concat(F.expr("""concat('<html><head><title>', source, '</title><meta name="description" content="', lang, '"></head><body><article><h1>', source, ' ', lang, '</h1><p>')"""), T.xml_escape(F.col("text")), F.lit("</p></article></body></html>"))
    return table(spark, d, "documents").select(F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("url"), html.alias("html"))


_SEARCHABLE = r"lang || chr(10) || source || ' ' || lang || chr(10) || chr(10) || chr(10) || substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 800)"
_FOLDED = r"regexp_replace(strip_accents(lower(searchable)), '[^\x00-\x7F]', '', 'g')"


@query(f"""WITH s AS (SELECT '/' || doc_id AS url, {_SEARCHABLE} AS searchable FROM documents), f AS (SELECT url, {_FOLDED} AS f FROM s),
p AS (SELECT url, unnest(regexp_extract_all(f, '[a-z0-9]+')) AS word, unnest(list_transform(string_split_regex(f, '[a-z0-9]+')[1:len(regexp_extract_all(f, '[a-z0-9]+'))], lambda x: length(x))) AS gap, generate_subscripts(regexp_extract_all(f, '[a-z0-9]+'), 1) AS k FROM f),
q AS (SELECT url, word, sum(gap + length(word)) OVER (PARTITION BY url ORDER BY k) - length(word) AS pos FROM p)
SELECT url, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places, CAST(max(pos) AS BIGINT) AS last FROM q WHERE word NOT IN ({_list(STOP_WORDS)}) GROUP BY url""")
def search_index_postings(spark, d):
    """Words and their places in the postings of each page."""
    made = index.build(_pages(spark, d), body="article")
    each = made.postings.select("doc_idx", F.explode("positions").alias("pos")).join(made.docs.select("doc_idx", "url"), "doc_idx")
    return each.groupBy("url").agg(F.count("*").alias("n"), F.sum("pos").alias("places"), F.max("pos").cast("long").alias("last"))


@query(f"""WITH s AS (SELECT '/' || doc_id AS url, source, lang, {_SEARCHABLE} AS searchable FROM documents), n AS (SELECT *, row_number() OVER (ORDER BY url) - 1 AS i FROM s)
SELECT 'd' AS section, CAST(i AS VARCHAR) AS key, md5(to_json({{'u': url, 't': source, 'm': lang, 'x': searchable}})) AS digest FROM n
UNION ALL SELECT DISTINCT 't', w, md5('"' || w || '"') FROM (SELECT unnest(list_filter(regexp_split_to_array({_FOLDED}, '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ({_list(STOP_WORDS)}))) AS w FROM s)
UNION ALL SELECT 'v', '', md5('1') UNION ALL SELECT 's', w, md5('"' || w || '"') FROM (SELECT unnest([{_list(STOP_WORDS)}]) AS w)""")
def snk_index_document(spark, d):
    """All parts of the index document but the postings, which search_index_postings has."""
    parts = index.document_parts(index.build(_pages(spark, d), body="article"), STOP_WORDS)
    return parts.where("section <> 'i'").select("section", "key", F.md5(F.col("value").cast("binary")).alias("digest"))


@query("""WITH p AS (SELECT '/blog/p' || doc_id || '.html' AS path, source AS title, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 28 AS INTEGER)) AS published FROM documents WHERE doc_id % 3 = 0)
SELECT path, title, published, CAST(NULL AS VARCHAR) AS summary, row_number() OVER w AS rank, lag(path) OVER w AS previous, lead(path) OVER w AS next, CAST((row_number() OVER w - 1) // 10 + 1 AS BIGINT) AS page, CAST(ceil(count(*) OVER () / 10) AS BIGINT) AS pages FROM p WINDOW w AS (ORDER BY published DESC, path)""")
def site_pages(spark, d):
    from folio.plans import site

    docs = table(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 3 == 0, "blog/").otherwise(""), F.lit("p"), F.col("doc_id").cast("string"), F.lit(".adoc")).alias("path"), F.concat(F.lit("= "), "source", F.lit("\n:published-date: 2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("\n\n"), "text").alias("text"))
    return site.built(docs, F.lit("2030-01-01").cast("timestamp")).blog.withColumn("published", F.col("published").cast("timestamp_ntz"))


# Services and JSON


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"value":[' || user_id || ']}' WHEN event_id % 3 = 1 THEN '{"value":' || user_id || '}' ELSE props END AS body FROM events""")
def src_json(spark, d):
    given = F.expr("CASE event_id % 3 WHEN 0 THEN concat('[', user_id, ']') WHEN 1 THEN concat(' ', user_id) ELSE concat(' ', props, ' ') END")
    return table(spark, d, "events").select("event_id", T.wrapped_json(given).alias("body"))


@query("SELECT 'https://s/c' || o_custkey AS url, CAST(o_orderkey % 3 + 1 AS INTEGER) AS page, o_orderkey AS id, o_orderpriority AS title FROM orders")
def src_service_pages(spark, d):
    from folio.sources import remote

    rows = table(spark, d, "orders").select(F.expr("concat('https://s/c', o_custkey)").alias("url"), F.expr("CAST(o_orderkey % 3 + 1 AS INT)").alias("page"), F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit("x").alias("more")).alias("x"))
    pages = rows.groupBy("url", "page").agg(F.to_json(F.collect_list("x")).alias("body"))
    return remote.items(pages, "id:bigint,title:string")


@query("""SELECT CASE WHEN c_custkey % 4 = 0 THEN 'own' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS key, CAST(c_custkey AS VARCHAR) AS id, c_name AS title, c_nationkey::BIGINT AS version, '/w/' || c_custkey AS link FROM customer WHERE c_custkey % 3 <> 0""")
def src_wiki_pages(spark, d):
    from folio.sources import remote

    content = F.expr("concat(IF(c_custkey % 3 = 0, '<p>', '<div made>'), IF(c_custkey % 4 = 0, concat('key=own', c_custkey, ';'), ''), c_mktsegment)")
    page = F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.struct(F.struct(content.alias("value")).alias("storage")).alias("body"), F.struct(F.col("c_nationkey").alias("number")).alias("version"), F.struct(F.expr("concat('/w/', c_custkey)").alias("webui")).alias("_links"))
    answers = table(spark, d, "customer").groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list(page).alias("results"))).alias("body"))
    return remote.wiki_pages(answers, ["<div made>"], "key=([^;]+);").select("key", "id", "title", "version", "link")


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'POST' ELSE 'PUT' END AS method, CASE WHEN c_custkey % 3 = 0 THEN '/content' ELSE '/content/i' || c_custkey END AS path,
  CASE WHEN c_custkey % 3 = 0 THEN '{' ELSE '{"id":"i' || c_custkey || '",' END || '"type":"page","title":"' || c_name || '",' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '"version":{"number":' || (c_nationkey + 1) || '},' END || '"body":{"storage":{"value":"' || c_mktsegment || '","representation":"storage"}}}' AS body FROM customer WHERE c_custkey % 3 <> 1""")
def snk_wiki_requests(spark, d):
    from folio.sources import remote

    customers = table(spark, d, "customer")
    wanted = customers.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("content"))
    existing = customers.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.expr("concat('i', c_custkey)").alias("id"), F.col("c_nationkey").alias("version"), F.expr("IF(c_custkey % 3 = 1, c_mktsegment, 'old')").alias("content"))
    return remote.wiki_requests(wanted, existing)


@query("""WITH t AS (SELECT s_nationkey AS id, 'tool-' || s_suppkey AS tool, '/opt/' || s_suppkey AS home FROM supplier)
SELECT id, string_agg('export ' || replace(upper(tool), '-', '_') || '_HOME="' || home || '";', chr(10) ORDER BY tool) || chr(10) || 'export PATH="' || string_agg(home || '/bin', ':' ORDER BY tool) || ':$PATH";' AS script FROM t GROUP BY id""")
def src_environment_scripts(spark, d):
    from folio.sources import files

    at = table(spark, d, "supplier").select(F.col("s_nationkey").alias("id"), F.expr("concat('tool-', s_suppkey)").alias("tool"), F.expr("concat('/opt/', s_suppkey)").alias("home"))
    return files.export_lines(at, "id", "tool", "home")


# Table operators


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("quantity"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def agg_grouping_sets(spark, d):
    at = table(spark, d, "documents")
    return at.groupingSets([[F.col("lang")], [F.col("source")], []], "lang", "source").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def agg_pivot(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""SELECT o_orderkey, rank() OVER w AS place, dense_rank() OVER w AS dense, ntile(4) OVER v AS quarter, count(*) OVER f AS around, first_value(o_orderkey) OVER v AS first
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), f AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def win_ranks(spark, d):
    mine = Window.partitionBy("o_custkey")
    w, v = mine.orderBy("o_orderpriority"), mine.orderBy("o_orderdate", "o_orderkey")
    at = {"place": F.rank().over(w), "dense": F.dense_rank().over(w), "quarter": F.ntile(4).over(v), "around": F.count("*").over(v.rowsBetween(-1, 1)), "first": F.first("o_orderkey").over(v)}
    return table(spark, d, "orders").select("o_orderkey", *[c.cast("long").alias(n) for n, c in at.items()])


@query("SELECT source, lang FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT source, lang FROM documents WHERE doc_id % 3 = 0")
def set_intersect(spark, d):
    at = table(spark, d, "documents")
    return at.where("doc_id % 2 = 0").select("source", "lang").intersect(at.where("doc_id % 3 = 0").select("source", "lang"))


@query(r"""SELECT conv_id, count(*) AS n, md5('<p>' || string_agg(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'), 'x' ORDER BY turn) || 'x</p>') AS html FROM conversations GROUP BY conv_id""")
def str_answers(spark, d):
    from folio.streaming import watch

    deltas = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.regexp_replace("text", "[^A-Za-z0-9]+", " "), F.lit("x")).alias("delta"))
    return watch.rendered(deltas, "conv_id", "turn", "delta").select("conv_id", "n", F.md5(F.col("html").cast("binary")).alias("html"))


@query("SELECT p_partkey AS id, '<section class=\"slide cover\"><h1>' || p_name || '</h1>' || chr(10) || '</section>' || chr(10) || '<section class=\"slide\" id=\"_' || lower(replace(p_brand, '#', '')) || '\"><h2>' || p_brand || '</h2>' || chr(10) || ' <div class=\"paragraph\">' || chr(10) || ' <p>' || chr(10) || p_type || chr(10) || ' </p>' || chr(10) || ' </div>' || chr(10) || '</section>' AS deck FROM part")
def doc_slides(spark, d):
    from folio.functions import asciidoc

    text = F.expr(r"concat('= ', p_name, '\n\n== ', p_brand, '\n\n', p_type)")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), asciidoc.decks(text).alias("deck"))


@query("SELECT unnest(['p_brand', 'p_name', 'p_partkey', 'p_retailprice', 'p_size', 'p_type']) AS name, unnest(['string', 'string', 'integer', 'number', 'integer', 'string']) AS kind")
def doc_schema_of_table(spark, d):
    """The JSON Schema of a table, read as any other."""
    import json

    from folio.operators import schemas

    body = json.dumps(schemas.json_schema(table(spark, d, "part").schema, "part"))
    return schemas.properties(spark.createDataFrame([(1, body)], "id int, body string"), "id", "body").select("name", "kind")


@query("SELECT '/' || doc_id AS url, source AS title, lang AS description, source || ' ' || lang AS h1, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text, md5(trim(regexp_replace(source || ' ' || lang || ' ' || text, '\\s+', ' ', 'g'))) AS body FROM documents")
def src_page_fields(spark, d):
    """Title, metas, headings and texts of pages, read from their HTML."""
    from folio.operators.index import fields_of

    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return fields_of(_pages(spark, d), "article", "content").select("url", "title", "description", "h1", digest("text"), digest("body"))


_BOOK = r"concat('= ', p_name, '\n\n== ', p_brand, '\n\nA *', p_type, '* of `', p_size, '` parts.\n\n=== Size ', p_size, '\n\nend\n\n== Last\n')"


@query("SELECT p_partkey AS id, '* ' || p_brand || chr(10) || '  * Size ' || p_size || chr(10) || '* Last' AS toc FROM part")
def doc_contents(spark, d):
    from folio.functions import asciidoc

    return asciidoc.contents(asciidoc.nodes(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_BOOK).alias("body")), "id", "body"), "id")


@query("SELECT p_partkey AS id, 'A ' || p_type || ' of ' || p_size || ' parts.end' AS text FROM part")
def doc_plain_text(spark, d):
    from folio.functions import asciidoc

    return asciidoc.plain_text(asciidoc.nodes(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_BOOK).alias("body")), "id", "body"), "id")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM b GROUP BY user_id, burst""")
def str_bursts(spark, d):
    """Events of a key with less than six hours between them as one."""
    from folio.streaming import watch

    at = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = watch.settled(at, "user_id", "at", "6 hours")
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "last")], "n")
