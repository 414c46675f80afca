"""State-machine text formats, parsed whole text by whole text in Arrow batches, and line formats as expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _parsed(df: DataFrame, key: str, body: str, schema: str, parse: Callable[[str], list[tuple]]) -> DataFrame:
    names = [f.split()[0] for f in _fields(schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *r) for k, text in zip(frame["key"], frame["body"], strict=True) for r in parse(text or "")]
            yield pd.DataFrame(rows, columns=["key", *names])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(body).alias("body")).mapInPandas(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def _fields(schema: str) -> list[str]:
    out, depth, at = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(at.strip())
            at = ""
        else:
            at += c
    return [*out, at.strip()]


METRICS = "name string, help string, type string, seq int, values array<struct<pos:int,tags:map<string,string>,value:double>>"


def _metrics(text: str) -> list[tuple]:
    done: list[dict] = []
    current: dict | None = None

    def fresh() -> dict:
        return {"name": None, "help": None, "type": None, "values": []}

    for line in text.split("\n"):
        kind = next((k for k in ("HELP", "TYPE") if line.startswith(f"# {k} ")), None)
        if kind:
            rest = line[7:]
            if current is None or not rest.startswith(f"{current['name']} "):
                if current is not None:
                    done.append(current)
                current = fresh()
            name, _, detail = rest.partition(" ")
            current[kind.lower()] = detail.strip()
            current["name"] = current["name"] or name.strip()
        elif not line.strip() or line.startswith("# "):
            if current is not None:
                done.append(current)
                current = None
        else:
            current = current or fresh()
            space, bracket = line.find(" "), line.find("{")
            tags: dict[str, str] = {}
            if 0 < bracket and (bracket < space or space < 0):
                name = line[:bracket]
                for part in line[bracket + 1 : line.find("}", bracket)].split(","):
                    if "=" in part:
                        k, v = part.split("=", 1)
                        v = v[1:-1] if len(v) > 1 and v[0] == v[-1] == '"' else v
                        tags[k] = f"{tags[k]},{v}" if k in tags else v
            else:
                name = line[:space] if space > 0 else line
            current["name"] = current["name"] or name
            if name != current["name"] and len(current["name"]) + 1 < len(name):
                tags["_type_"] = name[len(current["name"]) + 1 :]
            current["values"].append({"pos": len(current["values"]), "tags": tags, "value": float(line.rsplit(" ", 1)[-1])})
    if current is not None:
        done.append(current)
    return [(m["name"], m["help"], m["type"], k, m["values"]) for k, m in enumerate(done)]


def open_metrics(df: DataFrame, key: str, body: str) -> DataFrame:
    """Metrics of texts in the exposition format."""
    return _parsed(df, key, body, METRICS, _metrics)


PROPERTIES = "ord int, comment string, name string, sep string, value string"


def _properties(text: str) -> list[tuple]:
    rows: list[tuple] = []
    comments: list[str] = []
    lines = iter(text.split("\n"))
    for line in lines:
        if line.startswith("#"):
            comments.append(line)
            continue
        if not line.strip():
            if comments:
                rows.append(("\n".join(comments), None, None, None))
            comments = []
            rows.append((line, None, None, None))
            continue
        at = 0
        while at < len(line) and line[at] not in ":=":
            at += 2 if line[at] == "\\" else 1
        if at >= len(line):
            rows.append((line, None, None, None))
            continue
        value = line[at + 1 :]
        while value.endswith("\\"):
            more = next(lines, None)
            if more is None:
                break
            value += "\n" + more
        rows.append(("\n".join(comments), line[:at].strip(), line[at], value))
        comments = []
    if comments:
        rows.append(("\n".join(comments), None, None, None))
    return [(k, *r) for k, r in enumerate(rows)]


def properties(df: DataFrame, key: str, body: str) -> DataFrame:
    """Lines of properties files with their comments and separators, in order; rows without a name are layout."""
    return _parsed(df, key, body, PROPERTIES, _properties)


def properties_text(rows: DataFrame, key: str) -> DataFrame:
    """(key, text): the rows of properties() as a file again."""
    line = F.concat(F.when((F.col("name").isNotNull()) & (F.col("comment") != ""), F.concat("comment", F.lit("\n"))).when(F.col("name").isNull(), F.col("comment")).otherwise(""), F.when(F.col("name").isNotNull(), F.concat("name", "sep", "value")).otherwise(""))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))).alias("x"))
    return listed.select(key, F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias("text"))


_DASHES, _EQUALS = "-" * 80, "=" * 80


def tool_versions(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, vendor, version, dist, identifier) of six-column tables; a blank vendor is the last one before it."""
    table = F.regexp_extract(body, f"(?s){_DASHES}\n(.*?)\n{_EQUALS}", 1)
    each = df.select(key, F.posexplode(F.split(table, "\n")).alias("pos", "line")).withColumn("c", F.split(F.trim("line"), r"\|", -1)).where(F.size("c") == 6)
    cell = lambda i: F.trim(F.get("c", F.lit(i)))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return each.select(key, "pos", F.last(F.nullif(cell(0), F.lit("")), ignorenulls=True).over(w).alias("vendor"), cell(2).alias("version"), cell(3).alias("dist"), cell(5).alias("identifier"))


def old_tool_versions(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, version) of the format before: words of indented lines between the second and the third double rule."""
    block = F.get(F.split(body, _EQUALS), F.lit(2))
    lines = F.filter(F.split(block, "\n"), lambda x: F.startswith(x, F.lit(" ")))
    return df.select(key, F.explode(F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, r"\s+"))), lambda v: v != "")).alias("version"))


def tool_list(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, tool, name, version, url, description) of blocks between single rules."""
    block = F.explode(F.filter(F.split(body, f"{_DASHES}\n"), lambda b: F.contains(b, F.lit("$ sdk install "))))
    at = df.select(key, block.alias("b"))
    first = F.substring_index("b", "\n", 1)
    about = F.regexp_extract("b", r"(?s)^[^\n]*\n(.*?)\n?[^\n]*\$ sdk install ", 1)
    return at.select(key, F.regexp_extract("b", r"\$ sdk install (\S+)", 1).alias("tool"), F.regexp_extract(first, r"^(.*) \(", 1).alias("name"), F.regexp_extract(first, r"\(([^()]*)\)", 1).alias("version"), F.regexp_extract(first, r"\)[^h]*(h.*)$", 1).alias("url"), F.trim(F.regexp_replace(about, r"\s+", " ")).alias("description"))


def maven_versions(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, version) of maven-metadata.xml."""
    return df.select(key, F.posexplode(F.regexp_extract_all(body, F.lit("<version>([^<]*)</version>"), F.lit(1))).alias("pos", "version"))


def archive_links(df: DataFrame, key: str, body: str, suffix: str) -> DataFrame:
    """(key, file, version, kind): distinct archives a listing links to, of one suffix, with their number and jre or jdk."""
    at = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit('<a href="[^"]*?([^"/]+)"'), F.lit(1)))).alias("file")).where(F.endswith("file", F.lit(suffix)))
    kind = F.when(F.contains("file", F.lit("-jre")), "jre").when(F.contains("file", F.lit("-jdk")), "jdk")
    return at.where(kind.isNotNull()).select(key, "file", F.regexp_extract("file", r"(?:jre|jdk)-?(\d+(?:\.\d+)*)", 1).alias("version"), kind.alias("kind"))


def release_versions(releases: DataFrame, asset: str) -> DataFrame:
    """Versions of releases (name, assets array of (name)) whose name starts with v and that have the asset."""
    return releases.where(F.startswith("name", F.lit("v")) & F.exists("assets", lambda a: a["name"] == asset)).select(F.substring("name", 2, 100).alias("version"))


def releases_by_name(releases: DataFrame, keys: list[str]) -> DataFrame:
    """One release for each key: of the first page, then the smallest id."""
    return releases.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("page", "id"))).where("__n = 1").drop("__n")


def plugin_goals(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, goal, description, parameters array of (name, type, required, description)) of plugin.xml."""
    mojos = F.explode(F.regexp_extract_all(body, F.lit(r"(?s)<mojo>(.*?)</mojo>"), F.lit(1)))
    at = df.select(key, mojos.alias("m"))
    tag = lambda c, t: F.trim(F.regexp_replace(F.regexp_extract(c, rf"(?s)<{t}>(.*?)</{t}>", 1), r"\s+", " "))
    head = F.regexp_replace("m", r"(?s)<parameters>.*?</parameters>", "")
    each = F.transform(F.regexp_extract_all("m", F.lit(r"(?s)<parameter>(.*?)</parameter>"), F.lit(1)), lambda p: F.struct(tag(p, "name").alias("name"), tag(p, "type").alias("type"), (tag(p, "required") == "true").alias("required"), tag(p, "description").alias("description")))
    return at.select(key, tag(head, "goal").alias("goal"), tag(head, "description").alias("description"), each.alias("parameters"))
