"""Fields of HTML pages: title, metas, headings and text of a body selector, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
FIELDS = "title string, description string, keywords string, h1 string, h2 string, h3 string, text string, body string"


class _Page(HTMLParser):
    """Collects the distinct texts of the elements that matter, once the body element is entered."""

    def __init__(self, body: str, meta_attribute: str):
        super().__init__(convert_charrefs=True)
        self.body_tag, self.body_class = (None, body[1:]) if body.startswith(".") else (body, None)
        self.meta_attribute = meta_attribute
        self.stack: list[tuple[str, list[str] | None, str | None]] = []
        self.inside = 0
        self.found: dict[str, list[str]] = {k: [] for k in ("title", "h1", "h2", "h3", "text")}
        self.metas: dict[str, str] = {}
        self.body: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and a.get("name") in ("description", "keywords"):
            value = a.get(self.meta_attribute)
            if value is not None:
                self.metas.setdefault(a["name"], value)
        if tag in _VOID:
            self.handle_data(" ")
            return
        classes = (a.get("class") or "").split()
        kind = None
        if self.inside:
            if tag in ("h1", "h2", "h3"):
                kind = tag
            elif tag == "p" or tag == "td" and "content" in classes or tag == "th" and "tableblock" in classes or tag == "span" and self.stack and self.stack[-1][0] == "code":
                kind = "text"
        if tag == "title":
            kind = "title"
        opens = tag == self.body_tag or self.body_class is not None and self.body_class in classes
        if opens:
            self.inside += 1
            self.body = [] if self.body is None else self.body
        self.stack.append((tag, [] if kind else None, kind if not opens else (kind or "body")))

    def handle_endtag(self, tag):
        if all(x[0] != tag for x in self.stack):
            return
        while self.stack:
            name, parts, kind = self.stack.pop()
            if parts is not None and kind in self.found:
                text = " ".join("".join(parts).split())
                if text and (kind != "title" or not self.found["title"]) and text not in self.found[kind]:
                    self.found[kind].append(text)
            if kind == "body" or name == self.body_tag:
                self.inside = max(0, self.inside - 1)
            if self.body is not None and name in ("p", "div", "li", "h1", "h2", "h3", "td", "th", "br"):
                self.body.append(" ")
            if name == tag:
                break

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        for _, parts, _ in self.stack:
            if parts is not None:
                parts.append(data)
        if self.inside and self.body is not None:
            self.body.append(data)


def _parse(html: str | None, body: str, attribute: str) -> tuple:
    page = _Page(body, attribute)
    page.feed(html or "")
    page.close()
    while page.stack:
        page.handle_endtag(page.stack[-1][0])
    one = lambda k: "\n".join(page.found[k]) if page.found[k] else None
    return (one("title") or "", page.metas.get("description"), page.metas.get("keywords"), one("h1"), one("h2"), one("h3"), one("text") or "", " ".join("".join(page.body).split()) if page.body is not None else None)


def page_fields(html: Column, body: str = ".page-content-body", meta_attribute: str = "content") -> Column:
    """struct of FIELDS. body: a tag or .class; meta_attribute: "value" reads metas as the original index does."""

    @F.pandas_udf(FIELDS)  # type: ignore[call-overload]
    def run(values: pd.Series) -> pd.DataFrame:
        rows = [_parse(v, body, meta_attribute) for v in values]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])

    return run(html)


def read_tree(spark: SparkSession, path: str, pattern: str = "*.html", site: str = "") -> DataFrame:
    """(url, html) of all files below path; url is site and the path relative to it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    top = path.rstrip("/").rsplit("/", 1)[-1]
    relative = F.regexp_extract("path", "/" + top + "/(.*)$", 1)
    return files.select(F.concat(F.lit(site + "/"), relative).alias("url"), F.decode("content", "UTF-8").alias("html"))
