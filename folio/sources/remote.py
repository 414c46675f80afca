"""Paged JSON services as a data source: one partition for each first page, retries on rate limits, fixtures offline."""

from __future__ import annotations

import functools
import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIES = 5


class Flights:
    """Calls by key: those that run at the same time with one key are one call, and at most limit calls run at once."""

    def __init__(self, limit: int = 8):
        self._permits, self._lock, self._running = threading.Semaphore(limit), threading.Lock(), {}

    def call(self, key: object, run: Callable[[], object]) -> object:
        with self._lock:
            mine = key not in self._running
            future = self._running.setdefault(key, Future())
        if mine:
            try:
                with self._permits:
                    future.set_result(run())
            except BaseException as e:  # all who wait get it
                future.set_exception(e)
            finally:
                with self._lock:
                    del self._running[key]
        return future.result()


#: Of this process.
_flights = Flights()


class _Page(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        return [_Page(u) for u in dict.fromkeys(self.options["urls"].split(" ")) if u]

    def read(self, partition: _Page) -> Iterator[tuple]:
        url: str | None = partition.url
        page = 0
        while url:
            page += 1
            status, body, headers = _flights.call((url, str(sorted(self.options.items()))), functools.partial(self._get, url))
            if status not in {int(s) for s in self.options.get("expectedStatus", "200").split(",")}:
                raise ValueError(f"{url}: unexpected status {status}")
            yield (partition.url, page, status, body)
            following = _next_in_body(body) if self.options.get("next", "header") == "body" else _next(headers.get("Link", ""))
            url = following if self.options.get("paged", "true") == "true" else None

    def _get(self, url: str) -> tuple[int, str, dict]:
        headers = {k[7:]: v for k, v in self.options.items() if k.startswith("header.")}
        for attempt in range(RETRIES + 1):
            request = urllib.request.Request(url, headers=headers, method=self.options.get("method", "GET").upper(), data=self.options["payload"].encode() if "payload" in self.options else None)
            try:
                with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", "30"))) as r:
                    return r.status, r.read().decode("utf-8"), dict(r.headers)
            except urllib.error.HTTPError as e:
                if e.code != 429 or attempt == RETRIES:
                    return e.code, e.read().decode("utf-8", "replace"), dict(e.headers)
                reset = float(e.headers.get("RateLimit-Reset", time.time() + 1))
                time.sleep(max(0.05, min(60.0, reset - time.time())))
        raise AssertionError


def _next(link: str) -> str | None:
    for part in link.split(","):
        target, _, rest = part.partition(";")
        if 'rel="next"' in rest:
            return target.strip().strip("<>")
    return None


def _next_in_body(body: str) -> str | None:
    """The address of the next page in an answer's _links, which may be relative to their base."""
    links = json.loads(body).get("_links") or {}
    return links.get("base", "") + links["next"] if links.get("next") else None


class HttpJson(DataSource):
    """Rows (url, page, status, body) of services; options urls (separated by spaces), method, payload, header.*, timeout, expectedStatus, paged, next (header or body)."""

    @classmethod
    def name(cls) -> str:
        return "folio_http"

    def schema(self) -> str:
        return "url string, page int, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def http(spark: SparkSession, urls: list[str], **options: str) -> DataFrame:
    spark.dataSource.register(HttpJson)
    reader = spark.read.format("folio_http").option("urls", " ".join(urls))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def items(pages: DataFrame, schema: str) -> DataFrame:
    """The objects of the pages' JSON arrays, with url and page, in the order of the pages."""
    return pages.select("url", "page", F.explode(F.from_json("body", f"array<struct<{schema}>>")).alias("x")).select("url", "page", "x.*")


def commits_by_branch(commits: DataFrame) -> DataFrame:
    """(project, branches): a map of branch to commit titles; commits (project, branch, seq, title)."""
    per = commits.groupBy("project", "branch").agg(F.array_sort(F.collect_list(F.struct("seq", "title"))).alias("x"))
    return per.groupBy("project").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("branch", F.transform("x", lambda c: c["title"]).alias("t"))))).alias("branches"))


WIKI = "id:string,title:string,body:struct<storage:struct<value:string>>,version:struct<number:bigint>,_links:struct<webui:string>"


def wiki_pages(pages: DataFrame, marks: list[str], id_pattern: str | None = None) -> DataFrame:
    """(key, id, title, content, version, link) of a wiki's search results (url, page, body), pages with one of the marks only.

    The key is what the pattern's group finds in the content, else the page's id.
    """
    each = pages.select(F.explode(F.from_json("body", f"results array<struct<{WIKI}>>")["results"]).alias("x")).select("x.*")
    at = each.select("id", "title", F.col("body.storage.value").alias("content"), F.col("version.number").alias("version"), F.col("_links.webui").alias("link"))
    made = functools.reduce(lambda a, b: a | b, [F.contains("content", F.lit(m)) for m in marks])
    own = F.nullif(F.regexp_extract("content", id_pattern, 1), F.lit("")) if id_pattern else F.lit(None)
    return at.where(made).select(F.coalesce(own, "id").alias("key"), "id", "title", "content", "version", "link")


def wiki_requests(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(key, method, path, body) that make a wiki's pages (key, id, version, content) those wanted (key, title, content); pages with equal content need none."""
    old = existing.select("key", "id", "version", F.col("content").alias("old"))
    at = wanted.join(old, "key", "left").where(~F.col("content").eqNullSafe(F.col("old")) | F.col("id").isNull())
    body = F.to_json(F.struct("id", F.lit("page").alias("type"), "title", F.when(F.col("id").isNotNull(), F.struct((F.col("version") + 1).alias("number"))).alias("version"), F.struct(F.struct(F.col("content").alias("value"), F.lit("storage").alias("representation")).alias("storage")).alias("body")))
    return at.select("key", F.when(F.col("id").isNull(), "POST").otherwise("PUT").alias("method"), F.concat(F.lit("/content"), F.coalesce(F.concat(F.lit("/"), "id"), F.lit(""))).alias("path"), body.alias("body"))


def load_json(content_or_path: str) -> str:
    """A JSON text, or that of file:path; anything but an object as {"value": ...}."""
    text = open(content_or_path[5:], encoding="utf-8").read() if content_or_path.startswith("file:") else content_or_path
    value = json.loads(text)
    return json.dumps(value if isinstance(value, dict) else {"value": value})


REGISTRY = {"http": http, "json": load_json}
