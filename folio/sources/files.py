"""Files and folders as tables: markup pages, installs, versions, archives, caches and run-control files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

HEADER = StructType([StructField("title", StringType()), StructField("authors", StringType()), StructField("revision", StringType()), StructField("attributes", MapType(StringType(), StringType()))])


def header_of(text: Column) -> Column:
    """struct of title, authors, revision and attributes of an AsciiDoc text; only its header is looked at."""

    @F.pandas_udf(HEADER)
    def run(values: pd.Series) -> pd.DataFrame:
        from folio.functions.asciidoc import Parser

        rows = []
        for v in values:
            top = Parser().document((v or "").split("\n\n", 1)[0]).options
            rows.append((top.get("title"), top.get("authors"), top.get("revision"), {k[10:]: x for k, x in top.items() if k.startswith("attribute:")}))
        return pd.DataFrame(rows, columns=["title", "authors", "revision", "attributes"])

    return run(text)


def markup_pages(files: DataFrame, path: str, text: str, target: str = "path") -> DataFrame:
    """(path, title, attributes, output) of *.adoc files outside _partials folders; target: the attribute that names the output."""
    kept = files.where(F.endswith(path, F.lit(".adoc")) & ~F.col(path).rlike(r"(^|/)_partials"))
    at = kept.select(F.col(path).alias("path"), header_of(F.col(text)).alias("h"))
    own = F.regexp_replace("path", r"\.adoc$", ".html")
    return at.select("path", "h.title", "h.attributes", F.coalesce(F.element_at("h.attributes", target), own).alias("output"))


def local_installs(paths: DataFrame, path: str) -> DataFrame:
    """(tool, version) of folders named <tool>-<version>*_exploded."""
    name = F.substring_index(path, "/", -1)
    at = paths.where(F.endswith(name, F.lit("_exploded"))).select(F.regexp_extract(name, r"^(.+?)-(\d[\w.+-]*?)(?:[-.](?:bin|zip|tar).*)?_exploded$", 1).alias("tool"), F.regexp_extract(name, r"^(.+?)-(\d[\w.+-]*?)(?:[-.](?:bin|zip|tar).*)?_exploded$", 2).alias("version"))
    return at.where("version <> ''")


def version_folders(paths: DataFrame, path: str, ignored: list[str], pattern: str) -> DataFrame:
    name = F.substring_index(path, "/", -1)
    return paths.select(name.alias("folder")).where(~F.col("folder").isin(ignored or [""]) & F.col("folder").rlike(f"^(?:{pattern})$"))


def mime_type(path: Column, content: Column) -> Column:
    """By extension (image/<ext> for short ones that aren't text), else by the first bytes."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = {"svg": "image/svg+xml", "html": "text/html", "css": "text/css", "js": "text/javascript", "json": "application/json", "txt": "text/plain", "pdf": "application/pdf", "jpg": "image/jpeg"}
    named = F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), ext)
    start = F.hex(F.substring(content, 1, 4))
    magic = F.when(start == "89504E47", "image/png").when(F.startswith(start, F.lit("FFD8FF")), "image/jpeg").when(F.startswith(start, F.lit("474946")), "image/gif").when(start == "25504446", "application/pdf").when(start == "504B0304", "application/zip")
    return F.coalesce(named, F.when((ext != "") & (F.length(ext) < 25), F.concat(F.lit("image/"), ext)), magic)


def data_uri(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime_type(path, content), F.lit(";base64,"), F.base64(content))


def archive_entries(archives: DataFrame, key: str, content: str, below: str = "") -> DataFrame:
    """(key, name, data) of the files of zip and tar archives below a folder, that folder cut off. One archive is one task's work."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import tarfile
        import zipfile

        for frame in frames:
            for k, raw in zip(frame["key"], frame["content"], strict=True):
                if raw is None:
                    continue
                data = bytes(raw)
                if data[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        found = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and i.filename.startswith(below)]
                else:
                    with tarfile.open(fileobj=io.BytesIO(data)) as t:
                        found = [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile() and m.name.startswith(below)]
                yield pd.DataFrame([(k, n[len(below) :].lstrip("/"), d) for n, d in found], columns=["key", "name", "data"])

    kind = dict(archives.dtypes)[key]
    return archives.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInPandas(run, f"key {kind}, name string, data binary").withColumnRenamed("key", key)


def unpacked(archive: str, folder: str) -> int:
    """Writes the files of a zip or tar archive below a folder, with their executable bits; the number of files. Names that lead out of the folder are errors."""
    import os
    import tarfile
    import zipfile

    top, n = os.path.realpath(folder), 0

    def write(name: str, data: bytes, mode: int) -> None:
        path = os.path.realpath(os.path.join(top, name))
        if not path.startswith(top + os.sep):
            raise ValueError(f"{name} leads out of {folder}")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
        os.chmod(path, 0o755 if mode & 0o111 else 0o644)

    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for i in z.infolist():
                if not i.is_dir():
                    write(i.filename, z.read(i), i.external_attr >> 16)
                    n += 1
        return n
    with tarfile.open(archive) as t:
        for m in t:
            if m.isfile():
                write(m.name, t.extractfile(m).read(), m.mode)
                n += 1
    return n


def cached(entries: DataFrame, now_ms: Column) -> DataFrame:
    """entries (key, payload, valid_until) with expired; list callers keep rows that aren't."""
    return entries.withColumn("expired", F.col("valid_until") < now_ms)


def cache_key(url: Column) -> Column:
    """base64 for URLs, without padding."""
    return F.regexp_replace(F.translate(F.base64(url.cast("binary")), "+/\r\n", "-_"), "=+$", "")


def tool_settings(rows: DataFrame, source: str) -> DataFrame:
    """Run-control properties (source, name, value): keys of .sdkmanrc get the suffix ".version"."""
    plain = ~F.endswith("name", F.lit(".version"))
    return rows.withColumn("name", F.when(F.endswith(source, F.lit(".sdkmanrc")) & plain, F.concat("name", F.lit(".version"))).otherwise(F.col("name")))


def export_lines(installs: DataFrame, group: str, tool: str, home: str) -> DataFrame:
    """(group, script): shell lines that set a variable for the home of each tool of a group, and put their programs first on the path."""
    variable = F.concat(F.regexp_replace(F.upper(tool), "[^A-Z0-9]", "_"), F.lit("_HOME"))
    each = F.struct(F.col(tool).alias("t"), F.concat(F.lit("export "), variable, F.lit('="'), home, F.lit('";')).alias("l"), F.concat(home, F.lit("/bin")).alias("b"))
    listed = installs.groupBy(group).agg(F.array_sort(F.collect_list(each)).alias("x"))  # the tools of an environment
    path = F.concat(F.lit('export PATH="'), F.array_join(F.transform("x", lambda x: x["b"]), ":"), F.lit(':$PATH";'))
    return listed.select(group, F.concat(F.array_join(F.transform("x", lambda x: x["l"]), "\n"), F.lit("\n"), path).alias("script"))


def pom_versions(poms: DataFrame, key: str, body: str) -> DataFrame:
    """(key, java, maven): constraints of a pom, from compiler properties and the enforcer's rules."""
    tag = lambda *names: F.coalesce(*[F.nullif(F.trim(F.regexp_extract(body, rf"<{n}>\s*([^<$]+?)\s*</{n}>", 1)), F.lit("")) for n in names])
    rule = lambda n: F.nullif(F.regexp_extract(body, rf"(?s)<{n}>.*?<version>\s*[\[(]?\s*([0-9][^,<\])]*)", 1), F.lit(""))
    return poms.select(key, F.coalesce(rule("requireJavaVersion"), tag(r"maven\.compiler\.release", r"maven\.compiler\.target", r"maven\.compiler\.source", r"java\.version")).alias("java"), rule("requireMavenVersion").alias("maven"))


def sheet_rows(books: DataFrame, key: str, content: str, sheet: str | None = None) -> DataFrame:
    """(key, row, cells array): the shown texts of the first or named sheet of .xlsx files; formulas give their stored values."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import re
        import zipfile
        from xml.etree import ElementTree as X

        def local(e) -> str:
            return e.tag.rsplit("}", 1)[-1]

        for frame in frames:
            rows = []
            for k, raw in zip(frame["key"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = ["".join(t.text or "" for t in s.iter() if local(t) == "t") for s in X.fromstring(z.read("xl/sharedStrings.xml")) if local(s) == "si"]
                    names = [s.get("name") for s in X.fromstring(z.read("xl/workbook.xml")).iter() if local(s) == "sheet"]
                    place = names.index(sheet) if sheet else 0
                    for r in (e for e in X.fromstring(z.read(f"xl/worksheets/sheet{place + 1}.xml")).iter() if local(e) == "row"):
                        cells: list[str] = []
                        for c in r:
                            column = 0
                            for letter in re.match(r"[A-Z]*", c.get("r") or "")[0]:
                                column = column * 26 + ord(letter) - 64
                            cells += [""] * (column - 1 - len(cells))
                            value = next((v.text or "" for v in c.iter() if local(v) in ("v", "t")), "")
                            cells.append(shared[int(value)] if c.get("t") == "s" else value)
                        rows.append((k, int(r.get("r")), cells))
            yield pd.DataFrame(rows, columns=["key", "row", "cells"])

    kind = dict(books.dtypes)[key]
    return books.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInPandas(run, f"key {kind}, row int, cells array<string>").withColumnRenamed("key", key)


def last_updated(listing: DataFrame, path: str, at: str, group: str) -> DataFrame:
    """(group, at): the latest change, folders of editors and builds left out."""
    return listing.where(~F.col(path).rlike(r"(^|/)(\.idea|target|node_modules)(/|$)")).groupBy(group).agg(F.max(at).alias(at))
