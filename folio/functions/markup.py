"""Templates, breadcrumbs and Markdown answers, one text at a time in Arrow batches; ASCII drawings as cells."""

from __future__ import annotations

import json
import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, DEFAULT = "{{{", "}}}", ":-"


def substituted(text: str, values: dict[str, str], seen: tuple[str, ...] = (), marks: str = "site") -> str:
    """{{{key:-default}}} by its value, values in turn; a $ before it leaves it; unknown keys without default stay.

    marks: the name with which ":no-interpolate:start", ":no-interpolate:end" and the bracket's place holder begin.
    """
    raw, bracket = (f"{marks}:no-interpolate:start", f"{marks}:no-interpolate:end"), "{$" + marks + ".openbracket$}"
    a, b = text.find(raw[0]), text.find(raw[1])
    if a >= 0 and b > 0:
        return text[:a] + text[a + len(raw[0]) : b] + substituted(text[b + len(raw[1]) :], values, seen, marks)
    out, at = "", 0
    while True:
        start = text.find(OPEN, at)
        stop = text.find(CLOSE, start + len(OPEN)) if start >= 0 else -1
        if stop < 0:
            return (out + text[at:]).replace(bracket, "{")
        if start > at and text[start - 1] == "$":
            out += text[at : start - 1] + text[start : stop + len(CLOSE)]
        else:
            key, has, default = text[start + len(OPEN) : stop].partition(DEFAULT)
            if key in seen:
                raise ValueError(f"{key} refers to itself: {'->'.join((*seen, key))}")
            value = values.get(key, default if has else None)
            out += text[at:start] + (text[start : stop + len(CLOSE)] if value is None else substituted(value, values, (*seen, key), marks))
        at = stop + len(CLOSE)


def template(text: Column, values: Column, marks: str = "site") -> Column:
    @F.pandas_udf("string")  # type: ignore[call-overload]
    def run(texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else substituted(t, dict(m or {}), (), marks) for t, m in zip(texts, maps, strict=True)])

    return run(text, values)


def breadcrumb_items(value: Column) -> Column:
    """array of (label, href, active) of "Home[/] > Foo[foo.html] > Page"; the last one is active."""
    parts = F.transform(F.split(F.replace(value, F.lit("&gt;"), F.lit(">")), ">"), lambda x: F.trim(x))
    return F.transform(parts, lambda p, i: F.struct(F.trim(F.regexp_extract(p, r"^([^\[]*)", 1)).alias("label"), F.nullif(F.trim(F.regexp_extract(p, r"\[([^\]]*)\]", 1)), F.lit("")).alias("href"), (i == F.size(parts) - 1).alias("active")))


#: Marks around a span, the element it becomes, and characters that may not stand between them.
_SPANS = (("`", "code", "`"), ("**", "strong", "*"), ("__", "strong", "_"), ("*", "em", "*\n"))
_LINK = re.compile(r"\[([^\]]+)\]\(([^)\s]+)\)")
_BULLET, _HEADING = re.compile(r"\s*[-*+]\s+(.*)"), re.compile(r"(#{1,4})\s+(.*)")
_ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;"}


def _span_at(text: str, at: int) -> tuple[str, int] | None:
    """The element that begins at a place, and where it ends."""
    for mark, element, barred in _SPANS:
        if text.startswith(mark, at):
            stop = text.find(mark, at + len(mark))
            body = text[at + len(mark) : stop]
            if stop > 0 and body and not set(body) & set(barred):
                return f"<{element}>{plain(body) if element == 'code' else spans(body)}</{element}>", stop + len(mark)
    link = _LINK.match(text, at)
    return (f'<a href="{plain(link[2])}" target="_blank" rel="noopener">{spans(link[1])}</a>', link.end()) if link else None


def plain(text: str) -> str:
    return "".join(_ENTITIES.get(c, c) for c in text)


def spans(text: str) -> str:
    """Code, strong and emphasised words and links, read from left to right; marks without an end stay as they are."""
    out, at = [], 0
    while at < len(text):
        found = _span_at(text, at) if text[at] in "`*_[" else None
        out.append(found[0] if found else _ENTITIES.get(text[at], text[at]))
        at = found[1] if found else at + 1
    return "".join(out)


def markdown_html(text: str) -> str:
    """Lists of bullets, headings 1 to 4, a paragraph for each other line that isn't blank; spans inside all of them."""
    out: list[str] = []
    lines = [x.rstrip() for x in text.replace("\r\n", "\n").split("\n")]
    for bullets, group in groupby(lines, lambda x: bool(_BULLET.fullmatch(x))):
        if bullets:
            out += ["<ul>", *[f"<li>{spans(_BULLET.fullmatch(x)[1])}</li>" for x in group], "</ul>"]
            continue
        for line in filter(None, group):
            head = _HEADING.fullmatch(line)
            element, body = (f"h{len(head[1])}", head[2]) if head else ("p", line)
            out.append(f"<{element}>{spans(body)}</{element}>")
    return "\n".join(out)


def markdown(text: Column) -> Column:
    @F.pandas_udf("string")  # type: ignore[call-overload]
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else markdown_html(t))

    return run(text)


def cells(drawings: DataFrame, key: str, text: str) -> DataFrame:
    """(key, y, x, ch) of the characters other than spaces."""
    lines = drawings.select(key, F.posexplode(F.split(text, "\n")).alias("y", "line"))
    return lines.select(key, "y", F.posexplode(F.split("line", "")).alias("x", "ch")).where("ch <> ' ' AND ch <> ''")


def text_runs(grid: DataFrame, key: str) -> DataFrame:
    """(key, y, x, text): runs of letters, digits and punctuation of a row; up to two spaces stay inside a run."""
    letters = grid.where(F.col("ch").rlike(r"[\p{L}\p{N},;:!?()\[\]{}@$%&='`#]"))
    row = Window.partitionBy(key, "y").orderBy("x")
    gap = F.col("x") - F.lag("x").over(row)
    island = F.sum(F.when(gap <= 3, 0).otherwise(1)).over(row.rowsBetween(Window.unboundedPreceding, 0))
    part = F.concat(F.repeat(F.lit(" "), F.when(F.col("gap").between(2, 3), F.col("gap") - 1).otherwise(0).cast("int")), "ch")
    at = letters.withColumn("gap", gap).withColumn("island", island).withColumn("part", part)
    runs = at.groupBy(key, "y", "island").agg(F.min("x").alias("x"), F.array_sort(F.collect_list(F.struct("x", "part"))).alias("p"))
    return runs.select(key, "y", "x", F.array_join(F.transform("p", lambda c: c["part"]), "").alias("text"))


def _corners(lines: list[str]) -> list[list[tuple[int, int]]]:
    """Closed paths of +, -, |, / and \\ characters, as the corners of a walk along the border, from the top left."""
    at = {(x, y): c for y, row in enumerate(lines) for x, c in enumerate(row) if c in "+-|=:.'"}
    seen: set[tuple[int, int]] = set()
    out = []
    flat, tall = "+-=.'", "+|:.'"
    for y, x in sorted((y, x) for (x, y), c in at.items() if c in "+."):
        if (x, y) in seen or at.get((x + 1, y), " ") not in flat or at.get((x, y + 1), " ") not in tall:
            continue
        path, spot, step = [(x, y)], (x, y), (1, 0)
        while True:
            turns = [step, (-step[1], step[0]), (step[1], -step[0])] if at[spot] in "+.'" else [step]
            turns = turns[1:2] + turns[:1] + turns[2:] if at[spot] in "+.'" and spot != (x, y) else turns  # clockwise
            for dx, dy in turns:
                to = (spot[0] + dx, spot[1] + dy)
                if at.get(to, " ") in (flat if dx else tall):
                    if (dx, dy) != step:
                        path.append(spot)
                    spot, step = to, (dx, dy)
                    break
            else:
                path = []
                break
            if spot == (x, y):
                break
            if len(path) > 4 * len(at):
                path = []
                break
        if path:
            seen |= set(path)
            out.append(list(dict.fromkeys(path)))
    return out


def shapes(drawings: DataFrame, key: str, text: str) -> DataFrame:
    """(key, shape, polygon array of (x, y)): closed shapes of each drawing, in reading order of their first corner."""

    @F.pandas_udf("array<array<struct<x:int,y:int>>>")  # type: ignore[call-overload]
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: [[{"x": x, "y": y} for x, y in p] for p in _corners((t or "").split("\n"))])

    return drawings.select(key, F.posexplode(run(F.col(text))).alias("shape", "polygon"))


_DEFINITION = re.compile(r"\[([^\]]+)\]:\s*(\{.*\})")
_REFERENCE = re.compile(r"\[([^\]:]+)\]")
_CORNER = re.compile(r"(\d+)\s*,\s*(\d+)")
#: Characters of lines by direction, and the ends of lines that are arrows, with the step away from the line.
_FLAT, _TALL, _JOINTS, _DASHED = "-=", "|:", "+.'", "=:"
_ARROWS = {"<": (-1, 0), ">": (1, 0), "^": (0, -1), "v": (0, 1)}


def _inside(x: int, y: int, corners: list[tuple[int, int]]) -> bool:
    """Whether an odd number of edges is crossed to the right."""
    edges = zip(corners, corners[1:] + corners[:1], strict=True)
    return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in edges) % 2 == 1


def _border(corners: list[tuple[int, int]]) -> set[tuple[int, int]]:
    out = set()
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        n = max(abs(bx - ax), abs(by - ay), 1)
        out |= {(ax + (bx - ax) * k // n, ay + (by - ay) * k // n) for k in range(n + 1)}
    return out


def _open_lines(grid: dict[tuple[int, int], str], taken: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Cells of the lines beside closed shapes, each from its first end in reading order, straight on where it can."""

    def flows(c: str, horizontal: bool) -> bool:
        return c in _JOINTS or c in (_FLAT if horizontal else _TALL) or c in _ARROWS and (_ARROWS[c][0] != 0) == horizontal

    free = {p for p, c in grid.items() if p not in taken and c in _FLAT + _TALL + "+" + "<>^v"}
    near = {}
    for x, y in free:
        steps = [(dx, dy) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (x + dx, y + dy) in free]
        near[x, y] = [s for s in steps if flows(grid[x, y], s[0] != 0) and flows(grid[x + s[0], y + s[1]], s[0] != 0)]
    out, seen = [], set()
    for start in sorted((p for p in free if len(near[p]) == 1), key=lambda p: (p[1], p[0])):
        if start in seen:
            continue
        path, step = [start], near[start][0]
        while True:
            seen.add(path[-1])
            ways = [s for s in near[path[-1]] if (path[-1][0] + s[0], path[-1][1] + s[1]) not in seen]
            if not ways:
                break
            step = step if step in ways else ways[0]
            path.append((path[-1][0] + step[0], path[-1][1] + step[1]))
        if any(grid[p] in _FLAT + _TALL for p in path):  # letters that look like arrows alone are no lines
            out.append(path)
    return out


def _turns(path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ends of a path of cells and the cells where it turns."""
    way = lambda a, b: (b[0] - a[0], b[1] - a[1])
    return [p for k, p in enumerate(path) if k in (0, len(path) - 1) or way(path[k - 1], p) != way(p, path[k + 1])]


def drawing(text: str, tab: int = 8) -> tuple[list[dict], dict[str, dict]]:
    """Objects of a drawing and the options of its tags.

    Objects are paths, then texts, each from top to bottom and left to right: kind (closed, open, text), corners, dashed,
    start and end (whether an arrow stands there), text and tag. "[tag]: {json}" alone gives the options of a tag, and
    belongs to the shape with the corner x, y if the tag reads so; "[tag]" in a shape tags the outermost one around it.
    """
    lines = [x.expandtabs(tab) for x in text.split("\n")]
    options: dict[str, dict] = {}
    for k, line in enumerate(lines):
        m = _DEFINITION.search(line)
        if m:
            options[m[1]] = json.loads(m[2])
            lines[k] = line[: m.start()] + " " * (m.end() - m.start()) + line[m.end() :]
    grid = {(x, y): c for y, row in enumerate(lines) for x, c in enumerate(row) if c != " "}
    paths, taken = [], set()
    for corners in _corners(lines):
        cells_of = _border(corners)
        taken |= cells_of
        paths.append({"kind": "closed", "corners": corners, "dashed": any(grid.get(p, " ") in _DASHED for p in cells_of), "start": False, "end": False, "text": "", "tag": ""})
    for path in _open_lines(grid, taken):
        taken |= set(path)
        paths.append({"kind": "open", "corners": _turns(path), "dashed": any(grid[p] in _DASHED for p in path), "start": grid[path[0]] in _ARROWS, "end": grid[path[-1]] in _ARROWS, "text": "", "tag": ""})
    texts = []
    for y, row in enumerate(lines):
        plain_row = "".join(" " if (x, y) in taken else c for x, c in enumerate(row))
        for m in re.finditer(r"\S+(?: {1,2}\S+)*", plain_row):
            texts.append({"kind": "text", "corners": [(m.start(), y)], "dashed": False, "start": False, "end": False, "text": m[0], "tag": ""})
    place = lambda o: min((y, x) for x, y in o["corners"])
    paths.sort(key=place)
    texts.sort(key=place)
    for t in texts:
        x, y = t["corners"][0]
        for m in _REFERENCE.finditer(t["text"]):
            around = [p for p in paths if p["kind"] == "closed" and _inside(x + m.start(), y, p["corners"])]
            if around:
                around[0]["tag"] = t["tag"] = m[1]
    for tag in options:
        if m := _CORNER.fullmatch(tag):
            for p in paths:
                if p["corners"][0] == (int(m[1]), int(m[2])):
                    p["tag"] = tag
    return paths + texts, options


def objects(drawings: DataFrame, key: str, text: str, tab: int = 8) -> DataFrame:
    """(key, seq, kind, corners, dashed, start, end, text, tag) of the objects of each drawing, in their order."""

    @F.pandas_udf("array<struct<kind:string,corners:array<struct<x:int,y:int>>,dashed:boolean,start:boolean,end:boolean,text:string,tag:string>>")  # type: ignore[call-overload]
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: [o | {"corners": [{"x": x, "y": y} for x, y in o["corners"]]} for o in drawing(t or "", tab)[0]])

    return drawings.select(key, F.posexplode(run(F.col(text))).alias("seq", "o")).select(key, "seq", "o.*")


def _shade(colour: str) -> str:
    """Black or white, whichever is read better on a colour of three or six hex digits; black on others."""
    h = colour.removeprefix("#")
    if not re.fullmatch(r"[0-9A-Fa-f]{3}|[0-9A-Fa-f]{6}", h):
        return "#000"
    r, g, b = (int(x, 16) for x in ([c * 2 for c in h] if len(h) == 3 else [h[i : i + 2] for i in (0, 2, 4)]))
    return "#fff" if (r * 299 + g * 587 + b * 114) // 1000 < 125 and r + g + b < 500 else "#000"


def svg_of(text: str, cell: tuple[int, int] = (9, 16), tab: int = 8, font: str = "monospace") -> str:
    """A drawing as SVG: closed shapes with the options of their tags as attributes, lines with arrows, texts in a colour that can be read."""
    found, options = drawing(text, tab)
    x_of, y_of = (lambda x: x * cell[0] + cell[0] // 2), (lambda y: y * cell[1] + cell[1] // 2)
    lines = text.split("\n")
    out = [f'<svg width="{(max(map(len, lines)) + 1) * cell[0]}px" height="{(len(lines) + 1) * cell[1]}px" version="1.1" xmlns="http://www.w3.org/2000/svg">', '<defs><marker id="tip" viewBox="0 0 10 10" refX="5" refY="5" markerWidth="8" markerHeight="8" orient="auto-start-reverse"><path d="M 0 0 L 10 5 L 0 10 z"/></marker></defs>']
    attributes = lambda tag: "".join(f' {k}="{plain(str(v)).replace(chr(34), "&quot;")}"' for k, v in options.get(tag, {}).items() if ":" not in k)
    for o in found:
        x, y = o["corners"][0]
        if o["kind"] == "text":
            fills = [str(options.get(p["tag"], {}).get("fill", "none")) for p in found if p["kind"] == "closed" and _inside(x, y, p["corners"])]
            colour = next((_shade(f) for f in fills if f != "none"), "#000")
            out.append(f'<text x="{x_of(x)}" y="{y_of(y)}" fill="{colour}" font-family="{font}">{plain(o["text"])}</text>')
            continue
        d = "M " + " L ".join(f"{x_of(a)} {y_of(b)}" for a, b in o["corners"]) + (" Z" if o["kind"] == "closed" else "")
        dashed = ' stroke-dasharray="5 5"' if o["dashed"] else ""
        tips = "".join(f' marker-{k}="url(#tip)"' for k in ("start", "end") if o[k])
        given = attributes(o["tag"])
        out.append(f'<path d="{d}"{"" if " fill=" in given else f" fill={chr(34)}none{chr(34)}"} stroke="#000"{dashed}{tips}{given}/>')
    return "\n".join([*out, "</svg>"])


def svg(drawings: DataFrame, key: str, text: str, cell: tuple[int, int] = (9, 16)) -> DataFrame:
    """(key, svg) of each drawing."""

    @F.pandas_udf("string")  # type: ignore[call-overload]
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: svg_of(t or "", cell))

    return drawings.select(key, run(F.col(text)).alias("svg"))


SELECT_MARKS = ("<!-- VERSIONS START -->", "<!-- VERSIONS END -->")


def version_select(versions: DataFrame, order: Column, current: str = "") -> DataFrame:
    """(select): one row, the select element of a site between its marks, versions (folder) in the given order, newest first."""
    option = F.concat(F.lit('<option value="'), "folder", F.lit('"'), F.when(F.col("folder") == current, " selected").otherwise(""), F.lit(">"), "folder", F.lit("</option>"))
    listed = versions.agg(F.sort_array(F.collect_list(F.struct(order.alias("k"), option.alias("o"))), asc=False).alias("x"))
    return listed.select(F.concat(F.lit(SELECT_MARKS[0] + "<select>"), F.array_join(F.transform("x", lambda x: x["o"]), ""), F.lit("</select>" + SELECT_MARKS[1])).alias("select"))


def with_select(html: Column, select: Column, anchor: str) -> Column:
    """The page with the select behind the anchor, or in the place of an earlier one."""
    start, stop = F.instr(html, SELECT_MARKS[0]), F.instr(html, SELECT_MARKS[1])
    again = F.concat(F.substring(html, F.lit(1), start - 1), select, F.substring(html, stop + len(SELECT_MARKS[1]), F.length(html)))
    return F.when((start > 0) & (stop > start), again).otherwise(F.replace(html, F.lit(anchor), F.concat(F.lit(anchor), select)))
