"""Scalar text functions as column expressions; Python is used only where Unicode rules have no built-in equivalent."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folio.functions.arrays import let, running
from folio.functions.stemming import RETRIEVAL_STOP_WORDS, STOP_WORDS

# Expansion of retrieval terms.
SYNONYMS = {"feature": ["module", "extension", "capability"], "module": ["feature", "extension", "component"], "extension": ["module", "feature", "plugin"], "capability": ["feature", "module"], "component": ["module", "feature"], "plugin": ["extension", "module"]}
#: Characters of the body that are searchable.
SEARCHABLE = 800


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if c <= "\x7f")


def normalize_index(text: Column) -> Column:
    """Lower case, accents removed, other characters beyond ASCII dropped; '' for null. Texts in ASCII stay in the JVM."""
    low = F.lower(_blank(text))

    @F.pandas_udf(StringType())
    def folded(values: pd.Series) -> pd.Series:
        return values.map(lambda x: "" if x is None else _folded(x))

    return F.when(F.octet_length(low) == F.length(low), low).otherwise(folded(low))


def normalize_query(text: Column) -> Column:
    """Lower case; each run of characters other than a-z and 0-9 is one space; trimmed. Accents are not folded."""
    return F.trim(F.regexp_replace(F.lower(_blank(text)), "[^a-z0-9]+", " "))


def words(normalized: Column, stop_words: bool = True) -> Column:
    """The words of a normalised text in order, without stop words."""
    found = F.filter(F.split(normalized, "[^a-z0-9]+"), lambda w: w != "")
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS)) if stop_words else found


def word_positions(normalized: Column) -> Column:
    """array of (raw, pos): words and the characters at which they start, stop words left out.

    Starts come from the lengths of the words and of the gaps between them.
    """

    def placed(text: Column, ws: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, "[a-z0-9]+", -1), F.lit(1), F.size(ws)), F.length)
        ends = running(F.zip_with(ws, gaps, lambda w, g: F.length(w) + g), lambda a, b: a + b)
        return F.zip_with(ws, ends, lambda w, e: F.struct(w.alias("raw"), (e - F.length(w)).alias("pos")))

    every = let(normalized, lambda text: let(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)), lambda ws: placed(text, ws)))
    return F.filter(every, lambda x: ~x["raw"].isin(STOP_WORDS))


def searchable_text(description: Column, h1: Column, h2: Column, h3: Column, text: Column, limit: int = SEARCHABLE) -> Column:
    """Five lines; the last is cut to limit characters."""
    return F.concat(*[x for c in (description, h1, h2, h3) for x in (_blank(c), F.lit("\n"))], F.substring(_blank(text), 1, limit))


def seconds_to_read(content: Column) -> Column:
    n = F.size(F.filter(F.split(_blank(content), "[ \t\n\r\f]+"), lambda w: w != ""))
    return F.floor(n / F.lit(3.5)).cast("int")


def reading_time(content: Column) -> Column:
    s = seconds_to_read(content)
    minutes, rest = F.floor(s / 60).cast("int"), s % 60
    return F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(" min "), F.when(rest > 0, F.concat(F.lit("and "), rest.cast("string"), F.lit(" sec "))).otherwise(""), F.lit("read"))).when(s == 0, "quick read").otherwise(F.concat(s.cast("string"), F.lit(" sec read")))


def slug(name: Column) -> Column:
    """URL name: capitals become a dash and the small letter, other characters a dash; pairs of dashes become one, once."""
    first, rest = F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30)
    marked = F.regexp_replace(F.regexp_replace(rest, r"[^\p{L}\p{N}_$\p{Pc}\p{Sc}]", "-"), r"(\p{Lu})", "-$1")
    return F.replace(F.concat(first, F.lower(marked)), F.lit("--"), F.lit("-"))


def human_name(name: Column) -> Column:
    """First letter large; a space before a capital that follows an identifier character other than a capital."""
    spaced = F.regexp_replace(name, r"(?<=[\p{Ll}\p{Lo}\p{N}_$])(\p{Lu})", " $1")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30))


def xml_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&#x26;")), F.lit("<"), F.lit("&#x3C;")), F.lit(">"), F.lit("&#x3E;"))


def html_escape(text: Column) -> Column:
    """Named entities of HTML 4; the apostrophe stays. Texts in ASCII stay in the JVM."""
    core = text
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        core = F.replace(core, F.lit(a), F.lit(b))

    @F.pandas_udf(StringType())
    def named(values: pd.Series) -> pd.Series:
        from html.entities import codepoint2name

        table = {k: f"&{v};" for k, v in codepoint2name.items() if k > 0x7F}
        return values.map(lambda x: None if x is None else x.translate(table))

    return F.when(F.octet_length(text) == F.length(text), core).otherwise(named(core))


def title_id(title: Column, prefix: str = "_", separator: str = "_") -> Column:
    plain = F.lower(F.regexp_replace(title, "<[^>]+>", ""))
    return F.concat(F.lit(prefix), F.regexp_replace(F.replace(F.replace(plain, F.lit(" "), F.lit(separator)), F.lit("\n"), F.lit("")), r"[^\w]", ""))


def lowercase(value: Column) -> Column:
    return F.lower(F.coalesce(value.cast("string"), F.lit("null")))


def uppercase(value: Column) -> Column:
    return F.upper(F.coalesce(value.cast("string"), F.lit("null")))


def truncate(text: Column, length: Column | int) -> Column:
    n = F.lit(length) if isinstance(length, int) else length
    return F.when((F.length(text) > n) & (n >= 3), F.concat(F.substring(text, F.lit(1), n - 3), F.lit("..."))).otherwise(text)


def identifier(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9_-]", "_")


def csv_values(value: Column) -> Column:
    """The trimmed values of a comma list, blank ones dropped; empty for null."""
    return F.filter(F.transform(F.split(_blank(value), ","), lambda x: F.trim(x)), lambda x: x != "")


def published(value: Column, now: Column) -> Column:
    """A date, an offset time or a local time, all as instants in UTC; now if blank or missing."""
    v = F.trim(_blank(value))
    local = F.replace(v, F.lit(" "), F.lit("T"))
    return F.when(v == "", now).when(F.length(v) == 10, F.try_to_timestamp(v, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(local))


def gravatar(mail: Column, template: str = "https://www.gravatar.com/avatar/{hash}?d=identicon&size=64") -> Column:
    before, after = template.split("{hash}")

    @F.pandas_udf(StringType())
    def windows(values: pd.Series) -> pd.Series:
        import hashlib

        return values.map(lambda x: None if x is None else hashlib.md5(x.encode("cp1252", "replace")).hexdigest())

    digest = F.when(F.octet_length(mail) == F.length(mail), F.md5(mail.cast("binary"))).otherwise(windows(mail))
    return F.concat(F.lit(before), digest, F.lit(after))


def text_colour(colour: Column) -> Column:
    """#fff on dark colours, else #000; colours have three or six hex digits."""
    h = F.replace(colour, F.lit("#"), F.lit(""))
    full = F.when(F.length(h) == 3, F.concat(*[F.repeat(F.substring(h, i, 1), 2) for i in (1, 2, 3)])).otherwise(h)
    r, g, b = (F.conv(F.substring(full, i, 2), 16, 10).cast("int") for i in (1, 3, 5))
    bright = F.floor((r * 299 + g * 587 + b * 114) / 1000)
    return F.when((bright < 125) & (r + g + b < 500), "#fff").otherwise("#000")


def query_terms(question: Column) -> tuple[Column, Column]:
    """Distinct content words of a question, and their synonyms that aren't among them."""
    primary = F.array_distinct(F.filter(F.split(F.lower(question), r"\W+"), lambda w: (F.length(w) > 2) & ~w.isin(RETRIEVAL_STOP_WORDS)))
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    known = lambda w: F.coalesce(F.element_at(table, w), F.element_at(table, F.regexp_replace(w, "s$", "")), F.array().cast("array<string>"))
    return primary, F.array_except(F.array_distinct(F.flatten(F.transform(primary, known))), primary)


def term_fraction(terms: Column, text: Column) -> Column:
    hits = F.size(F.filter(terms, lambda t: F.contains(text, t) | F.contains(text, F.regexp_replace(t, "s$", ""))))
    return F.when(F.size(terms) == 0, 0.0).otherwise(hits / F.size(terms))


def lexical_score(primary: Column, synonyms: Column, text: Column, weight: float = 0.3) -> Column:
    low = F.lower(text)
    return term_fraction(primary, low) + weight * term_fraction(synonyms, low)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if a vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, 0.0).otherwise(dot(a.cast("array<double>"), b.cast("array<double>")) / length)


def unit_vector(v: Column) -> Column:
    """v over its length, in single precision; a zero vector is unchanged."""
    length = F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(v, lambda x: (x / length).cast("float"))).otherwise(v.cast("array<float>"))


def chunk_text(title: Column, body: Column) -> Column:
    return F.regexp_replace(F.concat(F.lit("Title: "), title, F.lit("\nContent:\n"), body), r"^\s+|\s+$", "")


def chunk_id(text: Column, url: Column) -> Column:
    return F.sha2(F.concat(text, F.lit("|"), url), 256)


def json_pointer(body: Column, pointer: str, last_segment_only: bool = False) -> Column:
    """The value at /a/b/0 as text. last_segment_only: look only the last segment up, at the root."""
    if not pointer.startswith("/"):
        raise ValueError("a pointer starts with /")
    parts = [p for p in pointer.split("/") if p]
    parts = parts[-1:] if last_segment_only else parts
    path = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts)
    return F.get_json_object(body, path)


def wrapped_json(body: Column) -> Column:
    """An object as it is, anything else as {"value": ...}."""
    return F.when(F.trim(body).startswith("{"), F.trim(body)).otherwise(F.concat(F.lit('{"value":'), F.trim(body), F.lit("}")))


def line_ranges(text: Column, ranges: str) -> Column:
    """Lines "n", "a..b" and "a..-1" of a comma or semicolon list, from 1; repeats allowed."""
    lines = F.split(text, "\n", -1)
    parts = []
    for r in ranges.replace(";", ",").split(","):
        a, _, b = r.strip().partition("..")
        start, stop = int(a), int(b or a)
        n = F.size(lines) - start + 1 if stop < 0 else F.least(F.lit(stop), F.size(lines)) - start + 1
        parts.append(F.slice(lines, F.lit(start), F.greatest(n, F.lit(0))))
    return F.array_join(F.concat(*parts), "\n")


def tagged_lines(text: Column, include: str) -> Column:
    """Lines between "tag::name[]" and "end::name[]" without the marks; rules in order: **, *, name, !name."""
    rules = [r.strip() for r in include.replace(";", ",").split(",")]

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        import re

        mark = re.compile(r"(tag|end)::([^\[\s]+)\[\]")

        def pick(value: str | None) -> str | None:
            if value is None:
                return None
            tags: list[str] = []
            rows: list[tuple[int, str, tuple[str, ...]]] = []
            for k, line in enumerate(value.split("\n")):
                m = mark.search(line)
                if m:
                    if m[1] == "tag":
                        tags.append(m[2])
                    elif m[2] in tags:
                        tags.remove(m[2])
                else:
                    rows.append((k, line, tuple(tags)))
            kept = set() if not all(r.startswith("!") for r in rules) else {k for k, _, _ in rows}
            for r in rules:
                name = r.removeprefix("!")
                hit = {k for k, _, t in rows if name == "**" or name == "*" and t or name in t}
                kept = kept - hit if r.startswith("!") else kept | hit
            return "\n".join(line for k, line, _ in rows if k in kept)

        return values.map(pick)

    return run(text)


def callouts(snippet: Column) -> tuple[Column, Column]:
    """The snippet with <n> as (n), and the numbers."""
    return F.regexp_replace(snippet, r"<(\d+)>", r"($1)"), F.transform(F.regexp_extract_all(snippet, F.lit(r"<(\d+)>"), F.lit(1)), lambda x: x.cast("int"))


def authors(line: Column) -> Column:
    """array of (name, mail) of "Name <mail>, ..."."""
    part = F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(part, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^<]*)", 1)).alias("name"), F.regexp_extract(x, "<([^>]*)>", 1).alias("mail")))


def revision(line: Column) -> Column:
    """(number, date, remark) of "number, date: remark"; a colon without a comma ends the number."""
    return F.struct(F.trim(F.regexp_extract(line, "^v?([^,:]*)", 1)).alias("number"), F.trim(F.regexp_extract(line, "^[^,]*,([^:]*)", 1)).alias("date"), F.trim(F.regexp_extract(line, ":(.*)$", 1)).alias("remark"))


def release_body(body: Column, name: Column) -> Column:
    """Bullets one level deeper, trimmed, without the leading "Release <name>"."""
    deeper = F.regexp_replace(F.replace(body, F.lit("\n*"), F.lit("\n**")), r"^\s+|\s+$", "")
    head = F.concat(F.lit("Release "), name)
    return F.when(F.startswith(deeper, head), F.ltrim(F.substring(deeper, F.length(head) + 1, F.length(deeper)))).otherwise(deeper)


def human_duration(millis: Column, corrected: bool = False) -> Column:
    """"h m s ms" parts that aren't 0; "0" for 0. Not corrected: seconds and milliseconds are counted in minutes' units."""
    total = F.floor(millis / 60000)
    minutes = total % 60
    seconds, rest = (F.floor(millis / 1000) % 60, millis % 1000) if corrected else (total % 60, total % 1000)
    parts = [(F.floor(millis / 3600000), "h"), (minutes, "mn"), (seconds, "s"), (rest, "ms")]
    joined = F.concat_ws(" ", *[F.when(v > 0, F.concat(v.cast("bigint").cast("string"), F.lit(u))) for v, u in parts])
    return F.when(joined == "", "0").otherwise(joined)


def next_version(content: Column, attribute: str = "data-version-iteration") -> Column:
    """The number in the attribute plus 1; 1 without one."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(content, attribute + r'="(\d+)"', 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0)) + 1


def replaced(text: Column, token: str, value: str) -> Column:
    """Literal replacement, or by the expression in regex{...}."""
    if token.startswith("regex{") and token.endswith("}"):
        return F.regexp_replace(text, token[6:-1], value)
    return F.replace(text, F.lit(token), F.lit(value))


def attributes_replaced(text: Column, attributes: Column) -> Column:
    """{name} by the value of that attribute; unknown names stay."""
    return F.aggregate(F.array_sort(F.map_entries(attributes)), text, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def level_offset(text: Column, offset: int) -> Column:
    """Section titles of each line deeper by offset, one = at least."""
    if offset >= 0:
        return F.regexp_replace(text, r"(?m)^(=+) ", "=" * offset + "$1 ")
    return F.regexp_replace(text, r"(?m)^={0," + str(-offset) + r"}(=+) ", "$1 ")


def indented(text: Column, n: int) -> Column:
    """The common indentation of the lines with text replaced by n spaces."""
    lines = F.split(text, "\n", -1)
    depth = F.coalesce(F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.ltrim(x)))), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.when(F.trim(x) == "", "").otherwise(F.concat(F.lit(" " * n), F.substring(x, depth + 1, F.length(x))))), "\n")


def category_class(categories: Column) -> Column:
    first = F.get(csv_values(categories), F.lit(0))
    return F.coalesce(F.concat(F.lit("category-"), slug(first)), F.lit(""))


def schema_anchor(ref: Column) -> Column:
    return F.replace(F.substring_index(ref, "/", -1), F.lit("."), F.lit("_"))


def separated(cells: Column, separator: str = ";") -> Column:
    return F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), separator)


def interpolated(attributes: Column, expression: str, fallback: Column | None = None) -> Column:
    """The attribute of "key?emptyIfMissing=true&ignoreErrors=true"; a missing one is the fallback, '', null or an error."""
    key, _, options = expression.partition("?")
    flags = dict(o.partition("=")[::2] for o in options.split("&") if o)
    missing = F.lit("") if flags.get("emptyIfMissing") == "true" else F.lit(None).cast("string") if flags.get("ignoreErrors") == "true" else F.raise_error(F.lit(f"no attribute {key}")).cast("string")
    found = F.try_element_at(attributes, F.lit(key))
    return F.coalesce(found, fallback, missing) if fallback is not None else F.coalesce(found, missing)
