"""Index, search and streams on small inputs."""

import os
import time

from pyspark.sql import functions as F

from folio.operators import index as I
from folio.sources import html, remote
from folio.streaming import watch

PAGE = '<html><head><title>{t}</title><meta name="description" value="some desc"><meta name="keywords" content="k1"></head><body><div class="page-content-body"><h1>{h}</h1><p>{p}</p></div></body></html>'


def pages(spark):
    rows = [("/b.html", PAGE.format(t="Reliable HTTP", h="Client", p="A reliable client for clients.")), ("/a.html", PAGE.format(t="JSON", h="Mapper", p="Maps json quickly")), ("/c.html", PAGE.format(t="X", h="X", p="client\n") + "\n:index-skip: true")]
    return spark.createDataFrame(rows, "url string, html string")


def test_index(spark):
    index = I.build(pages(spark), meta_attribute="value")
    docs = {r.url: r for r in index.docs.collect()}
    assert sorted(docs) == ["/a.html", "/b.html"] and docs["/a.html"].doc_idx == 0 and docs["/b.html"].title == "Reliable HTTP"
    assert docs["/b.html"].searchable_text == "some desc\nClient\n\n\nA reliable client for clients."
    got = {(r.stem, r.doc_idx): (r.score, list(r.positions)) for r in index.postings.collect()}
    assert got["client", 1] == (5.0, [10, 30, 41]) and got["reliab", 1] == (11.0, [21]) and got["desc", 0] == (5.0, [5])
    assert "http" not in {k for k, _ in got}  # only searchable text has postings; titles only add to scores


def test_search(spark):
    index = I.build(pages(spark), meta_attribute="value")
    ask = lambda q, **k: [(r.doc_idx, r.score, r.n, r.exact) for r in I.search(index, spark.createDataFrame([(1, q)], "query_id int, query string"), **k).orderBy("rank").collect()]
    assert ask("client") == [(1, 5.0, 1, True)]
    assert ask("client client") == [(1, 10.0, 2, True)]
    assert ask("cliemt") == [(1, 8.0, 2, False)]  # two words of the vocabulary are near, and both stem to client
    assert ask("reliable") == [] and ask("reliable", consistent=True) == [(1, 11.0, 1, True)]
    assert ask("the of") == [] and ask("") == []
    hits = I.search(index, spark.createDataFrame([(1, "client")], "query_id int, query string"))
    assert "<b>client</b>" in I.snippets(hits, index.docs, ["client"]).first().snippet


def test_html_tree(spark, tmp_path):
    os.makedirs(tmp_path / "site" / "sub")
    (tmp_path / "site" / "sub" / "x.html").write_text("<p>é</p>", encoding="utf-8")
    (tmp_path / "site" / "y.txt").write_text("no")
    assert [tuple(r) for r in html.read_tree(spark, str(tmp_path / "site"), site="/base").collect()] == [("/base/sub/x.html", "<p>é</p>")]


def test_file_changes(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    query = watch.each_batch(watch.changes(spark, str(source), "*.adoc"), lambda df: seen.extend(r.path.rsplit("/", 1)[1] for r in df.select("path").collect()), str(tmp_path / "check"), "0 seconds")
    try:
        for name in ("a.adoc", "b.txt", "c.adoc"):
            (source / name).write_text("x")
        until = time.time() + 60
        while len(seen) < 2 and time.time() < until:
            time.sleep(0.2)
        assert sorted(seen) == ["a.adoc", "c.adoc"]
    finally:
        query.stop()


def test_bursts_of_events(spark):
    rows = [("p", 0.0), ("p", 0.5), ("p", 5.0), ("q", 1.0)]
    events = spark.createDataFrame(rows, "key string, s double").select("key", F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("at"))
    got = sorted((r.key, r.n) for r in watch.settled(events, "key", "at").collect())
    assert got == [("p", 1), ("p", 2), ("q", 1)]


def test_remote_pages(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    calls = []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            calls.append(self.path)
            if calls == ["/p1"]:
                self.send_response(429)
                self.send_header("RateLimit-Reset", "0")
                self.end_headers()
                return
            body = b'[{"id": 1}, {"id": 2}]' if self.path == "/p1" else b'[{"id": 3}]'
            self.send_response(200)
            if self.path == "/p1":
                self.send_header("Link", f'<http://127.0.0.1:{self.server.server_port}/p2>; rel="next"')
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = remote.items(remote.http(spark, [f"http://127.0.0.1:{server.server_port}/p1"]), "id: int").collect()
        assert [(r.page, r.id) for r in got] == [(1, 1), (1, 2), (2, 3)]
    finally:
        server.shutdown()


def test_json_source(tmp_path):
    (tmp_path / "x.json").write_text("[1]")
    assert remote.load_json(f"file:{tmp_path}/x.json") == '{"value": [1]}' and remote.load_json('{"a": 1}') == '{"a": 1}'


def test_rising_times(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k, rows in enumerate([[("a", 1), ("a", 3), ("b", 5)], [("a", 2), ("a", 4), ("b", 5)]]):
        (source / f"{k}.json").write_text("\n".join('{"key": "%s", "s": %d}' % r for r in rows))
        os.utime(source / f"{k}.json", (1_000 + k, 1_000 + k))
    stream = spark.readStream.schema("key string, s long").option("maxFilesPerTrigger", 1).json(str(source)).select("key", F.timestamp_seconds("s").alias("at"))
    query = watch.rising(stream, "key", "at").writeStream.format("memory").queryName("rising").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.key, r.at // 1_000_000) for r in spark.table("rising").collect()) == [("a", 1), ("a", 3), ("a", 4), ("b", 5)]


def test_contents_and_plain_text(spark):
    from folio.functions import asciidoc

    tree = asciidoc.nodes(spark.createDataFrame([(1, "= T\n\n== A\n\nsome *bold* text\n\n=== B\n\n== C\n")], "id int, t string"), "id", "t")
    assert asciidoc.contents(tree, "id").first().toc == "* A\n  * B\n* C"
    assert asciidoc.plain_text(tree, "id").first().text == "some bold text"


def test_contributors():
    import pytest

    from folio.operators import joins

    assert joins.contributed({"a": 1}, [("a", "x"), ("noop", "y")]) == {"x": 1}
    for wrong in ([("b", "x")], [("a", "x"), ("a", "x")]):
        with pytest.raises(ValueError, match="unknown|taken"):
            joins.contributed({"a": 1}, wrong)


def test_near_words_equal_all_pairs(spark):
    import random

    from folio.operators import joins

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    left, right = words[::2], words[1::2] + words[:5]
    got = {(r.a, r.b): r.distance for r in joins.near_words(spark.createDataFrame([(w,) for w in left], "a string"), spark.createDataFrame([(w,) for w in right], "b string")).collect()}
    assert got == {(a, b): d for a in left for b in set(right) if 1 <= (d := distance(a, b)) <= 2}


def test_hot_groups_equal_windows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from folio.operators import ordering

    df = spark.range(3000).select((F.col("id") * 7 % 11).alias("x"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"), "id", (F.col("id") * 37 % 2000).alias("a")).withColumn("b", F.col("a") + F.col("x")).withColumn("v", F.when(F.col("id") % 5 == 0, F.col("id").cast("string")).otherwise(" "))
    jobs = [lambda: ordering.paged_within(df, "g", 7, "a", "id"), lambda: ordering.filled_down(df, "g", "v", "a", "id"), lambda: ordering.merged_intervals(df, "g", "a", "b"), lambda: ordering.within_budget(df, "g", "x", 300, "a", "id")]
    want = [sorted(map(tuple, j().collect()), key=str) for j in jobs]
    monkeypatch.setattr(ordering, "HOT", 50)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = [sorted(map(tuple, j().collect()), key=str) for j in jobs]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [len(x) for x in want] == [len(x) for x in got] and want == got


def test_queries_in_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from folio.operators import retrieval

    at = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = at.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    vectors = at.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    want = sorted(map(tuple, retrieval.similar(asked, vectors, 5).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 6)
    assert sorted(map(tuple, retrieval.similar(asked, vectors, 5).collect())) == want and len(want) == 5 * asked.count()


def test_saved_index(spark, tmp_path):
    from folio.operators import index

    pages = spark.createDataFrame([("/a", "<html><head><title>Lamp oil</title></head><body><article><p>burning lamp</p></article></body></html>")], "url string, html string")
    index.saved(index.build(pages, body="article"), str(tmp_path))
    asked = spark.createDataFrame([(1, "lamps"), (2, "burnin")], "query_id int, query string")
    assert {r.query_id for r in index.search(index.opened(spark, str(tmp_path)), asked).collect()} == {1, 2}


def test_first_version_above(spark, monkeypatch):
    """Without pairs, as over all pairs: equal, missing and odd values, repeated requests, groups of any size."""
    from folio.operators import joins, ordering

    nan = float("nan")
    asked = [(k // 2 if k % 40 == 1 else k, None if k % 31 == 0 else k % 3, nan if k % 37 == 0 else None if k % 41 == 0 else float(k * 7 % 50)) for k in range(300)]
    given = [(None if k % 29 == 0 else k % 3, k % 4, k % 2 == 0, k, nan if k % 67 == 5 else None if k % 43 == 0 else -0.0 if k % 23 == 0 else float(k * 11 % 50)) for k in range(200)]
    requests = spark.createDataFrame(asked, "request_id int, tool int, low double")
    versions = spark.createDataFrame(given, "tool int, provider_rank int, is_remote boolean, pos int, high double")
    ask = lambda: sorted((r.request_id, r.pos) for r in joins.resolved_above(requests, versions, "low", "high").collect())
    want = sorted((r.request_id, r.pos) for r in joins.resolved(requests, versions, F.col("high") > F.col("low")).collect())
    plan = joins.resolved_above(requests, versions, "low", "high")._jdf.queryExecution().optimizedPlan().toString()
    assert ask() == want and len(want) > 200 and "Join" not in plan
    monkeypatch.setattr(ordering, "HOT", 20)
    assert ask() == want


def test_cross_references_parse_once(spark):
    """Each document is parsed once, by as many tasks as there are cores, for the nodes that references need."""
    from folio.functions import asciidoc

    text = "= T\n\n== A b\n\nsee <<_a_b>>, <<_no>>, <<x,y>> and *bold*.\n\n[[x]]\n=== C\n\n== A b\n"
    docs = spark.createDataFrame([(k if k else None, text) for k in range(40)], "id int, t string").coalesce(1)
    whole = sorted(map(tuple, asciidoc.cross_references(asciidoc.nodes(docs, "id", "t"), "id").fillna(-1).collect()))
    tree = asciidoc.nodes(docs, "id", "t", kinds=("section", "anchor"))
    got = sorted(map(tuple, asciidoc.cross_references(tree, "id").fillna(-1).collect()))
    assert got == whole and len(got) == 120 and {r[2:] for r in got if r[0] == 7} == {("_a_b", "A b"), ("_no", "_no"), ("x", "y")}
    assert {r[2:] for r in got if r[0] == -1} == {("_a_b", "_a_b"), ("_no", "_no"), ("x", "y")}
    assert tree.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and {r.kind for r in tree.collect()} == {"section", "anchor"}
    plan = asciidoc.cross_references(tree, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_hybrid_without_pairs(spark):
    """As over all pairs: ties, odd vectors, missing texts and questions, several questions."""
    from folio.operators import ordering, retrieval

    nan, inf = float("nan"), float("inf")
    odd = {3: None, 7: [nan, 1.0, 0.0], 11: [1.0, None, 2.0], 13: [0.0, 0.0, 0.0], 17: [1.0], 19: [], 23: [inf, 0.0, 1.0], 29: [1e200, 1.0, 0.0]}
    vector = lambda n: odd.get(n, [float(n % 5), float(n % 3), float(n % 7 - 3)])
    words = ["modules", "a plugin", "release", "nothing", "Feature set"]
    texts = spark.createDataFrame([(n, None if n == 41 else f"T{n % 2}", words[n % 5]) for n in range(150)], "id int, title string, text string").repartition(5)
    vectors = spark.createDataFrame([(n, vector(n)) for n in range(140)], "id int, v array<double>").repartition(3)
    asked = ["Which features?", "What modules are released?", "the", "Which features?"]
    first = spark.createDataFrame([(n, asked[n % 4], vector(n)) for n in range(0, 60, 2)], "query_id int, question string, q array<double>")
    rest = spark.createDataFrame([(100, None, [1.0, 0.0, 0.0]), (101, "features", [nan, 0.0, 0.0]), (102, "plugins", None), (103, "plugins", [1.0]), (104, "plugins", [0.0, 0.0, 0.0])], first.schema)

    def want(queries, k):
        primary, synonyms = retrieval.T.query_terms(F.col("question"))
        q = queries.select("query_id", "q", retrieval.T.norm(F.col("q")).alias("q_norm"), primary.alias("p"), synonyms.alias("s"))
        low = F.lower(F.concat("title", F.lit("\n"), "text"))
        each = texts.join(vectors, "id").select("id", "v", retrieval.T.norm(F.col("v")).alias("v_norm"), low.alias("low"))
        total = retrieval._cosine() + 0.5 * (retrieval.T.term_fraction(F.col("p"), F.col("low")) + 0.3 * retrieval.T.term_fraction(F.col("s"), F.col("low")))
        return ordering.best_with_fallback(each.crossJoin(q).select("query_id", "id", F.round(total, 6).alias("score")), "query_id", "score", 0.15, k, "id").select("query_id", "rank", "id", "score")

    for queries in (first, first.unionByName(rest), rest.where("query_id < 103")):
        for k in (1, 6):
            got = retrieval.hybrid(queries, texts, vectors, k)
            assert got.columns == ["query_id", "rank", "id", "score"] and got.schema["id"].dataType.typeName() == "integer"
            assert sorted(map(str, got.collect())) == sorted(map(str, want(queries, k).collect()))
    named = vectors.withColumn("id", F.col("id").cast("string"))
    by_name = retrieval.hybrid(first, texts.withColumn("id", F.col("id").cast("string")), named, 3)
    assert by_name.count() > 30


def test_texts_are_scored_once(spark):
    """A text meets each distinct question once, not each query."""
    from folio.operators import retrieval

    vectors = spark.range(20).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    texts = vectors.select("id", F.lit("t").alias("title"), F.lit("modules").alias("text"))
    queries = vectors.select(F.col("id").alias("query_id"), F.lit("Which modules?").alias("question"), F.col("v").alias("q"))
    plan = retrieval.hybrid(queries, texts, vectors, 2)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains" not in plan and "mapinarrow" in plan


def test_merged_intervals_of_equal_rows(spark):
    """Intervals that many rows share stay one interval, whose rows are all counted."""
    from folio.operators import ordering

    rows = [("u", a, a + 110) for a in (0, 111, 200, 500, 611) for _ in range(60)]
    got = sorted(map(tuple, ordering.merged_intervals(spark.createDataFrame(rows, "g string, a long, b long").repartition(7), "g", "a", "b").collect()))
    assert got == [("u", 0, 110, 60), ("u", 111, 310, 120), ("u", 500, 610, 60), ("u", 611, 721, 60)]
