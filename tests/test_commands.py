"""Commands, single flights, archives, schemas and answers."""

import io
import os
import tarfile
import threading
import time
import urllib.request
import zipfile

import pytest

from folio import __main__ as commands
from folio.operators import schemas
from folio.sources import files, remote


def test_calls_at_the_same_time_are_one():
    flights, calls, running, most = remote.Flights(2), [], [], []

    def slow(key):
        running.append(key)
        most.append(len(running))
        time.sleep(0.1)
        running.remove(key)
        calls.append(key)
        return key * 2

    got = []
    threads = [threading.Thread(target=lambda k=k: got.append(flights.call(k, lambda: slow(k)))) for k in (1, 1, 1, 2, 3, 4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == [2, 2, 2, 4, 6, 8] and sorted(calls) == [1, 2, 3, 4] and max(most) <= 2
    with pytest.raises(ZeroDivisionError):
        flights.call(9, lambda: 1 // 0)
    assert flights.call(9, lambda: 5) == 5


def test_archives_are_unpacked(tmp_path):
    plain, packed = tmp_path / "a.zip", tmp_path / "b.tar.gz"
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("x/one.txt", "1")
    with tarfile.open(packed, "w:gz") as t:
        for name, mode in (("bin/run", 0o755), ("doc/read", 0o644)):
            info = tarfile.TarInfo(name)
            info.mode, info.size = mode, 2
            t.addfile(info, io.BytesIO(b"ok"))
    assert files.unpacked(str(plain), str(tmp_path / "out")) == 1 and (tmp_path / "out/x/one.txt").read_text() == "1"
    commands.main(["unpack", str(packed), str(tmp_path / "out")])
    assert os.access(tmp_path / "out/bin/run", os.X_OK) and not os.access(tmp_path / "out/doc/read", os.X_OK)
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("../evil", "1")
    with pytest.raises(ValueError, match="leads out"):
        files.unpacked(str(plain), str(tmp_path / "out"))


def test_schemas_of_tables(spark):
    df = spark.createDataFrame([], "a long NOT NULL, b array<struct<c:double>>, m map<string,date>, d binary")
    assert schemas.json_schema(df.schema, "T") == {"title": "T", "type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "object", "properties": {"c": {"type": "number"}}}}, "m": {"type": "object", "additionalProperties": {"type": "string", "format": "date"}}, "d": {"type": "string", "contentEncoding": "base64"}}, "required": ["a"]}


def test_commands(spark, tmp_path, capsys):
    drawing = tmp_path / "d.txt"
    drawing.write_text("+--+\n|a |\n+--+")
    commands.main(["svg", str(drawing)])
    assert "<svg" in capsys.readouterr().out
    talk = tmp_path / "t.adoc"
    talk.write_text("= Tide\n\nhello\n\n[.wide]\n== One\n\nx\n\n== Two\n")
    commands.main(["slides", str(talk)])
    out = capsys.readouterr().out
    assert out.count("<section") == 4 and 'class="slide wide" id="_one"' in out and "<h1>Tide</h1>" in out
    commands.main(["crypt", "boat", "key"])
    sealed = capsys.readouterr().out.strip()
    commands.main(["decrypt", sealed, "key"])
    assert capsys.readouterr().out.strip() == "boat"
    commands.main(["query", "agg_status_counts", "/root/testdata/sf0.001", "--out", str(tmp_path / "out"), "--format", "json"])
    assert spark.read.json(str(tmp_path / "out")).count() > 0
    for folder in ("1.2", "1.10"):
        (tmp_path / "v" / folder).mkdir(parents=True)
        (tmp_path / "v" / folder / "i.html").write_text("<body></body>")
    commands.main(["versions", str(tmp_path / "v"), "1.2"])
    assert '<option value="1.10">1.10</option><option value="1.2" selected>' in (tmp_path / "v/1.2/i.html").read_text()


def test_server(tmp_path):
    (tmp_path / "p.html").write_text("tide")
    with commands.server(str(tmp_path), 0) as s:
        thread = threading.Thread(target=s.serve_forever)
        thread.start()
        try:
            assert urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}/p.html").read() == b"tide"
        finally:
            s.shutdown()
            thread.join()


def test_answers_of_a_stream(spark, tmp_path):
    from folio.streaming import watch

    for k, rows in enumerate(([(1, 0, "**ti"), (1, 1, "de**")], [(1, 2, " now"), (2, 0, "# sea")])):
        spark.createDataFrame(rows, "chat int, seq int, delta string").coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("chat int, seq int, delta string").option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    q = watch.rendered(stream, "chat", "seq", "delta").writeStream.format("memory").queryName("answers").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.chat: r.html for r in spark.table("answers").collect()} == {1: "<p><strong>tide</strong> now</p>", 2: "<h1>sea</h1>"}


def test_pages_whose_answers_name_the_next(spark):
    import http.server
    import json

    class Wiki(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            n = int(self.path.rsplit("=", 1)[-1])
            result = {"id": str(n), "title": f"t{n}", "body": {"storage": {"value": "<div made>" if n != 2 else "by hand"}}, "version": {"number": n}, "_links": {"webui": f"/w{n}"}}
            links = {"base": f"http://127.0.0.1:{self.server.server_port}", "next": f"/search?n={n + 1}"} if n < 3 else {}
            body = json.dumps({"results": [result], "_links": links}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Wiki) as s:
        thread = threading.Thread(target=s.serve_forever)
        thread.start()
        try:
            pages = remote.http(spark, [f"http://127.0.0.1:{s.server_port}/search?n=1"], next="body")
            got = remote.wiki_pages(pages, ["<div made>"]).collect()
        finally:
            s.shutdown()
            thread.join()
    assert sorted((r.key, r.version, r.link) for r in got) == [("1", 1, "/w1"), ("3", 3, "/w3")]
