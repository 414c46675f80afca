"""What the two operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import column, positional


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, e) of the vectors that take part, e as double array, and their dimension.

    Left out: null ids and vectors, null or non-finite components, zero vectors, and lengths other than the commonest.
    """
    at = positional(vectors).select(F.col(column(vectors, id_col)).cast("long").alias("id"), F.col(column(vectors, vector_col)).cast("array<double>").alias("e"))
    e = F.col("e")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    at = at.where(F.col("id").isNotNull() & e.isNotNull()).where(good)
    top = at.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dimension = top[0]["d"] if top else 0
    return at.where(F.size("e") == dimension), dimension


def matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """Rows of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), dimension)


def collected(df: DataFrame, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded table (id, e), by id."""
    rows = df.toArrow()
    ids = rows["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix(rows["e"], dimension)[order]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of x, none of them zero, at length 1; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
