"""What the operators of this subpackage share: durable cuts of lineage, stable hashing of keys, arrow helpers."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.plans.durable import cut, scope, shared_dir, stored

__all__ = ["column", "cut", "fold", "joined", "modest_batches", "positional", "scope", "shared_dir", "slabs", "stored", "texts_of"]

#: Texts handled together inside a Python worker, in bytes; bounds its memory whatever the Arrow batch holds.
SLAB_BYTES = 2_000_000
#: Rows of an Arrow batch; Spark's own default holds tens of MB of texts in the JVM and in each worker.
BATCH_ROWS, _ROWS = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Joins of more than MANY rows split a key that holds more than one in SHARES of them, and more than LEAST_HOT.
MANY, SHARES, LEAST_HOT = 10_000, 4_096, 10_000


def modest_batches(spark: SparkSession) -> None:
    """Sets the rows of an Arrow batch to BATCH_ROWS, unless the session has a setting of its own. For the queries and the pipeline: operators leave the session as it is."""
    if not spark._jsparkSession.sessionState().conf().contains(_ROWS):
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def positional(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... by position, so that no name of the caller can clash with one of an operator."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def column(df: DataFrame, name: str) -> str:
    """The positional name of the column called name: the first that is spelt so, else the first that differs in case only."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(df.columns):
            if same(c):
                return f"c{i}"
    raise ValueError(f"no column {name} among {df.columns}")


def joined(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined (inner or left) with table, which has at most one row for each key and none with a null key.

    A hot key's rows are dealt over several tasks by a hash of the column by, and its row of table is repeated for each;
    rows with a null key are dealt likewise. At most SHARES keys are hot, so what comes to the driver is bounded.
    counts: (key, count) of rows, where known.
    """
    n = rows.count()
    if n <= MANY:
        return rows.join(table, key, how)
    least = max(LEAST_HOT, n // SHARES)
    counts = rows.groupBy(key).count() if counts is None else counts
    hot = {r[key]: -(-r["count"] // least) for r in counts.where(F.col("count") > least).select(key, "count").collect()}
    if not hot:
        return rows.join(table, key, how)
    parts = rows.sparkSession.createDataFrame([(k, n) for k, n in hot.items() if k is not None] or [(None, 1)], f"__key {rows.schema[key].dataType.simpleString()}, __parts int")
    split = lambda df: df.join(F.broadcast(parts), F.col(key) == F.col("__key"), "left").drop("__key")
    dealt = F.pmod(F.xxhash64(F.lit(29), by), F.coalesce("__parts", F.when(F.col(key).isNull(), F.lit(hot.get(None, 1))), F.lit(1))).cast("int")
    left = split(rows).withColumn("__part", dealt).drop("__parts")
    right = split(table).withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [key, "__part"], how).drop("__part")


def _give_back() -> None:
    """Returns freed memory of this worker, which stays for further tasks, to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim:
        trim(0)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def slabs(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about SLAB_BYTES of text (a column of strings, or of their lengths), or one row if that is longer."""
    for batch in batches:
        c = batch.column(text)
        ends = np.cumsum(np.asarray(pc.fill_null(c if pa.types.is_integer(c.type) else pc.binary_length(c), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + SLAB_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    _give_back()


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [x or "" for x in batch.column(text).to_pylist()]
