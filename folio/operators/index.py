"""Inverted index of pages: documents, vocabulary and postings as three tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, StringType

from folio.functions import text as T
from folio.functions.stemming import remembered, stems
from folio.operators import filters, joins, ordering
from folio.plans.durable import spread, stored
from folio.sources.html import page_fields

#: Points of a word that a field holds.
WEIGHTS = {"title": 10, "keywords": 6, "description": 5, "h1": 4, "h2": 3, "h3": 2, "text": 1}


#: Words of queries up to which they are broadcast, about 100 bytes each.
BROADCAST_WORDS = 200_000


@dataclass
class Index:
    """docs (doc_idx, url, title, description, searchable_text), terms (raw), postings (stem, doc_idx, score, positions)."""

    docs: DataFrame
    terms: DataFrame
    postings: DataFrame


@F.pandas_udf(ArrayType(StringType()))
def _stem_lists(values):
    return values.map(lambda ws: None if ws is None else [remembered(w) for w in ws])


def fields_of(pages: DataFrame, body: str, meta_attribute: str, url: str = "url", html: str = "html", skip_mark: str = ":index-skip: true") -> DataFrame:
    """url and the fields of pages without the skip mark."""
    return pages.where(~filters.skipped(F.col(html), skip_mark)).select(F.col(url).alias("url"), page_fields(F.col(html), body, meta_attribute).alias("f")).select("url", "f.*")


def saved(index: Index, path: str) -> None:
    """Writes the tables of an index, so that searches don't build it again."""
    for name in ("docs", "terms", "postings"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def opened(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("docs", "terms", "postings")])


def _score(sets: dict[str, Column], stem: Column) -> Column:
    """Sum of the weights of the fields whose set of stems holds the stem."""
    total = F.lit(0.0)
    for field, words in sets.items():
        total = total + F.when(F.array_contains(words, stem), float(WEIGHTS[field])).otherwise(0.0)
    return total


def build(pages: DataFrame, body: str = ".page-content-body", meta_attribute: str = "content", skip_mark: str = ":index-skip: true") -> Index:
    """Scores are made inside each page's row, so only postings are shuffled, and only to number the pages."""
    # Pages are numbered by their addresses alone, so that each is parsed once.
    kept = pages.where(~filters.skipped(F.col("html"), skip_mark)).select("url").distinct()
    numbers = ordering.numbered(kept, "url", name="n").select("url", (F.col("n") - 1).cast("int").alias("doc_idx"))
    at = fields_of(spread(pages), body, meta_attribute, skip_mark=skip_mark)
    at = at.withColumn("searchable", T.searchable_text(*[F.col(c) for c in ("description", "h1", "h2", "h3", "text")]))
    at = stored(at.withColumn("norm", T.normalize_index(F.col("searchable"))).join(numbers, "url"), "pages")
    docs = at.select("doc_idx", "url", "title", "description", F.col("searchable").alias("searchable_text"))
    sets = {f: F.col(f"s_{f}") for f in WEIGHTS}
    words = spread(at).select("doc_idx", T.word_positions(F.col("norm")).alias("words"), *[_stem_lists(F.array_distinct(T.words(T.normalize_index(F.col(f))))).alias(f"s_{f}") for f in WEIGHTS])
    words = words.withColumn("stems", _stem_lists(F.transform("words", lambda w: w["raw"])))
    # Scores are made before words become rows, so that no row carries the sets of its page.
    words = words.withColumn("scores", F.transform("stems", lambda s: _score(sets, s)))
    each = words.select("doc_idx", F.explode(F.arrays_zip("words", "stems", "scores")).alias("w")).select("doc_idx", F.col("w.words.raw").alias("raw"), F.col("w.words.pos").alias("pos"), F.col("w.stems").alias("stem"), F.col("w.scores").alias("score"))
    made = each.groupBy("stem", "doc_idx").agg(F.max("score").alias("score"), F.sort_array(F.collect_list("pos")).alias("positions"), F.collect_set("raw").alias("raws"))
    made = stored(made, "postings")  # words are stemmed once, however often the index is searched
    return Index(docs, made.select(F.explode("raws").alias("raw")).distinct(), made.drop("raws"))


def search(index: Index, queries: DataFrame, limit: int = 20, consistent: bool = False, max_distance: int = 2) -> DataFrame:
    """(query_id, rank, doc_idx, score, n, exact, positions) of the best pages for each of queries (query_id, query).

    A word without postings is replaced by the vocabulary's words within max_distance edits, at 0.8 of their score; each
    of these adds its postings. Exact pages come first, then by score and number of hits; ties by page number.
    consistent: look words up as the index stems them, else as the query side stems them.
    """
    words = T.words(T.normalize_query(F.col("query")))
    asked = queries.select("query_id", F.posexplode(words).alias("at", "raw")).withColumn("stem", stems(F.col("raw"), not consistent))
    asked = stored(asked, "asked")
    known = index.postings.select("stem").distinct()
    # Few words of queries go to the postings, so that a stem of many pages is not gathered; else both sides are shuffled.
    hint = F.broadcast if asked.count() <= BROADCAST_WORDS else lambda x: x
    exact = index.postings.join(hint(asked), "stem").select("query_id", "doc_idx", "score", "positions", F.lit(True).alias("exact"))
    lost = asked.join(known, "stem", "left_anti").select("query_id", "at", F.col("raw").alias("wanted"))
    near = joins.fuzzy(index.terms, lost, "raw", "wanted", max_distance)
    near = stored(near.withColumn("stem", stems(F.col("raw"), not consistent)), "near")
    hint = F.broadcast if near.count() <= BROADCAST_WORDS else lambda x: x
    fuzzy = index.postings.join(hint(near), "stem").select("query_id", "doc_idx", (F.col("score") * 0.8).alias("score"), "positions", F.lit(False).alias("exact"))
    found = exact.unionByName(fuzzy).groupBy("query_id", "doc_idx").agg(F.sum("score").alias("score"), F.count("*").alias("n"), F.bool_or("exact").alias("exact"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), F.desc(F.round("score", 9)), F.desc("n"), "doc_idx")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return stored(best.select("query_id", "rank", "doc_idx", F.round("score", 6).alias("score"), "n", "exact", "positions"), "hits")  # few rows, read more than once


def snippets(hits: DataFrame, docs: DataFrame, terms: list[str], radius: int = 55) -> DataFrame:
    """hits with snippet: the merged surroundings of their positions, joined by " ... ", with the terms in bold."""
    at = hits.select("query_id", "doc_idx", F.explode("positions").alias("pos")).join(docs.select("doc_idx", "searchable_text"), "doc_idx")
    spans = at.select("query_id", "doc_idx", F.greatest(F.lit(0), F.col("pos") - radius).alias("start"), F.least(F.length("searchable_text"), F.col("pos") + radius).alias("end")).withColumn("key", F.struct("query_id", "doc_idx"))
    merged = ordering.merged_intervals(spans, "key", "start", "end", bounded=True).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")).select("key.query_id", "key.doc_idx", "spans")
    cutout = lambda s: F.substring(F.col("searchable_text"), s["start"] + 1, s["end"] - s["start"])
    out = merged.join(docs.select("doc_idx", "searchable_text"), "doc_idx").withColumn("snippet", F.array_join(F.transform("spans", cutout), " ... "))
    for t in terms:
        out = out.withColumn("snippet", F.regexp_replace("snippet", "(?i)(" + re.escape(t) + ")", "<b>$1</b>"))
    return hits.join(out.select("query_id", "doc_idx", "snippet"), ["query_id", "doc_idx"], "left")


def document_parts(index: Index, stop_words: list[str]) -> DataFrame:
    """(section, key, value): the index document in parts, a row for each entry: v, s (stop words), d (pages), t (vocabulary), i (postings)."""
    entry = F.concat(F.lit("["), F.col("doc_idx").cast("string"), F.lit(","), F.col("score").cast("string"), F.when(F.size("positions") > 0, F.concat(F.lit(",["), F.array_join(F.col("positions").cast("array<string>"), ","), F.lit("]"))).otherwise(""), F.lit("]"))
    page = F.to_json(F.struct(F.col("url").alias("u"), F.col("title").alias("t"), F.col("description").alias("m"), F.col("searchable_text").alias("x")))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))  # noqa: E731  words are of letters and digits
    row = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.alias("value"))
    spark = index.docs.sparkSession
    fixed = spark.createDataFrame([("v", "", "1"), *[("s", w, f'"{w}"') for w in sorted(set(stop_words))]], "section string, key string, value string")
    return fixed.unionByName(row(index.docs, "d", F.col("doc_idx"), page)).unionByName(row(index.terms, "t", F.col("raw"), quoted(F.col("raw")))).unionByName(row(index.postings, "i", F.concat_ws("/", "stem", "doc_idx"), entry))


def document(index: Index, stop_words: list[str]) -> DataFrame:
    """(value): the index of a site as one JSON text, which a browser loads; document_parts() and tables are the normal output."""
    parts = document_parts(index, stop_words)
    place = F.when(F.col("section").isin("d", "i"), F.substring_index("key", "/", -1).cast("int")).otherwise(0)
    at = parts.select("section", F.when(F.col("section") == "i", F.substring_index("key", "/", 1)).otherwise("").alias("stem"), F.struct(place.alias("n"), "key", "value").alias("x"))
    lists = at.groupBy("section", "stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda e: e["value"]), ",").alias("l"))
    whole = lists.select("section", "stem", F.when(F.col("section") == "i", F.concat(F.lit('"'), "stem", F.lit('":['), "l", F.lit("]"))).otherwise(F.col("l")).alias("l"))
    one = whole.groupBy().pivot("section", ["d", "i", "s", "t", "v"]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stem", "l"))), lambda e: e["l"]), ","))
    text = [F.lit('{"d":['), "d", F.lit('],"i":{'), "i", F.lit('},"s":['), "s", F.lit('],"t":['), "t", F.lit('],"v":'), "v", F.lit("}")]
    return one.select(F.concat(*[F.coalesce(F.col(x), F.lit("")) if isinstance(x, str) else x for x in text]).alias("value"))
