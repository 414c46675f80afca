"""Operator 3: secret scan with multipart credential linking, in DataFrame expressions only.

Strong kinds (assign, access, hex) are reported wherever they stand. Three kinds of parts are weak alone: identifiers
(user names, client and access key ids), endpoints (URLs, hosts) and secret-looking values. A value is reported, as
kind "linked", only if an identifier or an endpoint stands within SCOPE characters of it; the nearest of either kind is
reported with it. A scope never crosses a document, so this interval join runs inside each row: the parts of a kind are
sorted arrays, and binary searches find, for each value, the last part that ends before it and the first that starts
behind it. So a row takes time in proportion to its text and its parts (times their logarithm), nothing is shuffled, no
pair is emitted, and no key can become hot.

Positions are code points, end exclusive. Matches of one kind never overlap; a linked value that overlaps a span of a
strong kind is left out. Of parts at equal distances the one before the value is named. Null and empty texts have no
spans. Repeated rows are scanned each. Only the id and the text are read, whatever the names of other columns; redact()
keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.arrays import let, rank, running
from folio.llm.common import column, positional

#: Greatest distance, in characters, between a value and the part that supports it.
SCOPE = 256
#: Strong kinds in the order in which ties are listed; linked spans come last.
KINDS = ("assign", "access", "hex", "linked")

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
IDENTIFIER = r"""(?i:\b(?:access_?key_?id|client_?id|account_?id|user_?name|user|login|email))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}|\b(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{12,}"""
ENDPOINT = r"""(?i:\b(?:https?|ftps?|sftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3|jdbc:[a-z]+))://[^\s"'<>]{4,}|(?i:\b(?:host|hostname|endpoint|server|base_?url))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{4,}"""
VALUE = r"""(?i:\b(?:pwd|pass|passphrase|auth|credentials?|private_?key|access_?key|key|sig|signature))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=~!@#$%^&*-]{6,}|(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"""
#: Strings of which one occurs, in lower case, in each match of the pattern; they keep the patterns off other texts.
NEEDS = {
    ASSIGN: ("password", "passwd", "secret", "token", "api_key", "apikey"),
    ACCESS: ("akia",),
    IDENTIFIER: ("user", "login", "email", "key", "client", "account", "akia", "asia", "aroa", "aida"),
    ENDPOINT: ("://", "host", "endpoint", "server", "base_url", "baseurl"),
}
#: Characters of the blocks from which redact() cuts.
CHARACTERS = 4_096
_SPANS = "array<struct<s:int,e:int,k:int>>"


def _any(lower: Column, needs: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in needs:
        out = out | F.contains(lower, F.lit(x))
    return out


def _spans(text: Column, pattern: str, kind: int, minimum: tuple[int, int] | None = None) -> Column:
    """Spans of the pattern's matches, from the lengths of the matches and of the pieces between them.

    minimum: (group, characters): matches whose group is shorter are dropped, after they have taken their place.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    keep = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(minimum[0])), lambda g: F.length(g) >= minimum[1]) if minimum else F.transform(found, lambda _: F.lit(True))

    def placed(sizes: Column) -> Column:
        ends = running(F.zip_with(sizes, F.slice(F.transform(between, F.length), F.lit(1), F.size(sizes)), lambda n, gap: n + gap), lambda a, b: a + b)
        every = F.zip_with(F.zip_with(sizes, ends, lambda n, e: F.struct((e - n).alias("s"), e.alias("e"))), keep, lambda x, good: F.when(good, F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k"))))
        return F.filter(every, F.isnotnull)

    return let(F.transform(found, F.length), placed)


def _none() -> Column:
    return F.array().cast(_SPANS)


def _nearest(parts: str, value: Column, scope: int) -> Column:
    """The nearest part beside value within scope, or null. parts: the name of a sorted array of spans that don't overlap."""
    before = F.get(F.col(parts), rank(F.col(f"{parts}_e"), value["s"], True) - 1)
    behind = F.get(F.col(parts), rank(F.col(f"{parts}_s"), value["e"], False))
    far = F.lit(1 << 30)
    gaps = lambda b, a: (F.coalesce(value["s"] - b["e"], far), F.coalesce(a["s"] - value["e"], far))
    both = lambda x: F.when(F.least(*gaps(x["b"], x["a"])) > scope, None).when(gaps(x["b"], x["a"])[0] <= gaps(x["b"], x["a"])[1], x["b"]).otherwise(x["a"])
    return let(F.struct(before.alias("b"), behind.alias("a")), both)


def _with_spans(texts: DataFrame, scope: int) -> DataFrame:
    """texts, which has a column x_text without nulls, with x_base (s, e, k) by start and kind, and x_linked (s, e, k, identifier, endpoint)."""
    t, lower = F.col("x_text"), F.col("x_lower")
    at = texts.withColumn("x_lower", F.lower(t))
    strong = [F.when(_any(lower, NEEDS[ASSIGN]), _spans(t, ASSIGN, 0, (2, ASSIGN_MIN))).otherwise(_none()), F.when(F.contains(t, F.lit("AKIA")), _spans(t, ACCESS, 1)).otherwise(_none()), F.when(t.rlike(HEX), _spans(t, HEX, 2)).otherwise(_none())]
    at = at.withColumns({"x_base": F.array_sort(F.concat(*strong)), "x_id": F.when(_any(lower, NEEDS[IDENTIFIER]), _spans(t, IDENTIFIER, 4)).otherwise(_none()), "x_end": F.when(_any(lower, NEEDS[ENDPOINT]), _spans(t, ENDPOINT, 5)).otherwise(_none())})
    at = at.withColumn("x_values", F.when((F.size("x_id") + F.size("x_end") > 0) & t.rlike(VALUE), _spans(t, VALUE, 3)).otherwise(_none()))
    # Where there is no value, no array is searched.
    some = F.size("x_values") > 0
    side = lambda c, f: F.when(some, F.array_sort(F.transform(c, lambda x: x[f]))).otherwise(F.array().cast("array<int>"))
    at = at.withColumns({f"{c}_{f}": side(c, f) for c in ("x_id", "x_end", "x_base") for f in "se"})

    def link(v: Column) -> Column:
        # As many base spans have ended before v as have started before its end, if none overlaps it.
        alone = rank(F.col("x_base_s"), v["e"], False) == rank(F.col("x_base_e"), v["s"], True)
        full = lambda p: F.when(p["identifier"].isNotNull() | p["endpoint"].isNotNull(), F.struct(v["s"].alias("s"), v["e"].alias("e"), v["k"].alias("k"), p["identifier"].alias("identifier"), p["endpoint"].alias("endpoint")))
        return F.when(alone, let(F.struct(_nearest("x_id", v, scope).alias("identifier"), _nearest("x_end", v, scope).alias("endpoint")), full))

    # Each array is referred to twice, so that the optimizer computes it once and not inside the lambda.
    used = [f"{c}{f}" for c in ("x_id", "x_end", "x_base") for f in ("", "_s", "_e")]
    ready = some & (sum((F.size(c) for c in used), F.lit(0)) >= 0)
    linked = F.filter(F.transform(F.when(ready, F.col("x_values")).otherwise(_none()), link), F.isnotnull)
    return at.withColumn("x_linked", linked).drop("x_lower", "x_values", *(c for c in used if c != "x_base"))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with positional columns and x_text."""
    return positional(docs).withColumn("x_text", F.coalesce(F.col(column(docs, text_col)).cast("string"), F.lit("")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id; base and spans, arrays of (s, e, k: place in KINDS), base spans first where starts are equal; links: each linked span with the nearest identifier and endpoint in scope."""
    at = _with_spans(_texts(docs, text_col).select(F.col(column(docs, id_col)).alias("doc_id"), "x_text"), scope).select("doc_id", "x_base", "x_linked")
    return at.select("doc_id", F.col("x_base").alias("base"), F.array_sort(F.concat("x_base", _plain(F.col("x_linked")))).alias("spans"), F.transform("x_linked", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["identifier"].alias("identifier"), x["endpoint"].alias("endpoint"))).alias("links"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked and links (start:end of the value, identifier, endpoint) of what scan returns."""
    count = lambda c, k: F.size(F.filter(c, lambda x: x["k"] == k)).cast("long")
    place = lambda x: F.coalesce(F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string")), F.lit(""))
    links = F.array_join(F.transform("links", lambda x: F.concat_ws("/", place(x), place(x["identifier"]), place(x["endpoint"]))), ",")
    return found.select("doc_id", *[count("base", k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), count("spans", 3).alias("n_linked"), links.alias("links"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[REDACTED]", scope: int = SCOPE) -> DataFrame:
    """docs with all spans of the text, overlapping ones as one, replaced by mask; rows without spans keep their text."""
    text = column(docs, text_col)
    at = _with_spans(_texts(docs, text_col), scope).withColumn("x_all", F.array_sort(F.concat("x_base", _plain(F.col("x_linked")))))
    some = F.size("x_all") > 0
    # Where the text before each span has been dealt with, and the text in blocks, so that cutting doesn't start over.
    at = at.withColumn("x_upto", F.when(some, running(F.transform("x_all", lambda x: x["e"]), lambda a, b: F.greatest(a, b))).otherwise(F.array().cast("array<int>")))
    at = at.withColumn("x_blocks", F.when(some, F.regexp_extract_all("x_text", F.lit(f"(?s).{{1,{CHARACTERS}}}"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    blocks, block = F.col("x_blocks"), lambda i: F.floor(i / CHARACTERS).cast("int")

    def cut(a: Column, b: Column) -> Column:
        first, last = block(a), block(b)
        inside = F.substring(F.get(blocks, first), a % CHARACTERS + 1, b - a)
        across = F.concat(F.substring(F.get(blocks, first), a % CHARACTERS + 1, F.lit(CHARACTERS)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substring(F.coalesce(F.get(blocks, last), F.lit("")), F.lit(1), b % CHARACTERS))
        return F.when(a >= b, "").when(first == last, inside).otherwise(across)

    def piece(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(F.col("x_upto"), i - 1), F.lit(0))
        return F.when(x["s"] >= before, F.concat(cut(before, x["s"]), F.lit(mask))).otherwise("")

    clean = F.concat(F.array_join(F.transform("x_all", piece), ""), cut(F.element_at("x_upto", -1), F.length("x_text")))
    masked = F.when(some & (F.size("x_blocks") + F.size("x_upto") > 0), clean).otherwise(F.col(text))
    return at.select(*[masked.alias(c) if c == text else F.col(c) for c in positional(docs).columns]).toDF(*docs.columns)
