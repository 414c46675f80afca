"""Changes of files as streams: the polling of the original as micro-batches, with its waiting period as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from folio.functions import markup


def changes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, content) of new and rewritten files below a folder."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def settled(events: DataFrame, key: str, at: str, quiet: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(key, first, last, n): bursts of events of a key, given out once no event has come for the quiet time."""
    session = F.session_window(at, quiet)
    return events.withWatermark(at, late).groupBy(session, key).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("session_window")


def rising(events: DataFrame, key: str, at: str) -> DataFrame:
    """Events whose time is later than all of their key before; one number for each key is kept as state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def newer(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else -1
        rows = pd.concat(list(frames)).sort_values("at")
        kept = rows[rows["at"].cummax().shift(fill_value=seen).clip(lower=seen) < rows["at"]]
        state.update((int(max(seen, rows["at"].max())),))
        yield pd.DataFrame({"key": kept["key"], "at": kept["at"]})

    at_us = F.unix_micros(F.col(at).cast("timestamp"))
    return events.select(F.col(key).cast("string").alias("key"), at_us.alias("at")).groupBy("key").applyInPandasWithState(newer, "key string, at long", "at long", "append", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, render: Callable[[DataFrame], None], checkpoint: str, interval: str = "1 second") -> StreamingQuery:
    """Calls render with the rows of each micro-batch."""
    return stream.writeStream.foreachBatch(lambda df, _: render(df)).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def windowed(events: DataFrame, at: str, group: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by window and group; an extension, as the original has no windows."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(w.alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n")


def rendered(deltas: DataFrame, key: str, seq: str, delta: str) -> DataFrame:
    """(key, n, html): the answer that the deltas of each key, in the order of seq, make so far, rendered; a stream needs the output mode complete or update.

    An answer's deltas are as many as its words, so they fit into one row.
    """
    so_far = deltas.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(seq, delta))).alias("x"))
    return so_far.select(key, "n", markup.markdown(F.array_join(F.transform("x", lambda x: x[delta]), "")).alias("html"))
