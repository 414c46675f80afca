"""Operator 9: near-duplicate vectors through a pivot-permutation index.

Each vector is described by its NEAR nearest reference points (pivots), in their order. Inverted lists hold, for pairs of
places in that order (PLACES, those at its beginning), the vectors that have this pair of pivots there; vectors that
share at least two pivots so meet in the list of each shared pair, and the smallest of these lists alone counts them.
Members of a list are verified by cosine in double precision. Copies of a vector are one entry with a multiplicity.

The number of pivots grows with the square root of the number of vectors, up to PIVOT_BYTES, so lists keep their length
and work for each vector stays the same. Lists with one member are dropped before vectors are shuffled. Short lists share
tasks; a list longer than BLOCK is cut into blocks, and pairs of blocks are separate tasks, so no task holds a whole hot
list. Tasks return the number of links of each vector and one label for each linked vector (the smallest id in its local
component), never pairs. Components come from minimum labels over these, in tables.

Pivots are rows chosen by a hash of the id, no two of them near-duplicates, so that a large group of near copies has one
pivot. Vectors that are null or zero, or hold null or non-finite components, or have another length than the commonest
link with nothing; they and rows with a null id are returned with 0 links and their own id. Vectors are scaled by their
largest component before they are measured, so very large and very small ones have right cosines. Repeated rows with one
id are copies of each other. Only the id and the vector are read, whatever the names of other columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from folio.llm.common import column, joined, positional, scope, stored
from folio.llm.near_dup import minimum_labels
from folio.llm.vectors import collected, matrix, unit, usable

#: Pivots: GROWTH times the square root of the vectors, at least FEWEST, at most PIVOT_BYTES; chosen among SAMPLE times as many rows.
GROWTH, FEWEST, PIVOT_BYTES, SAMPLE = 8, 64, 8 << 20, 4
#: Places of the permutation whose pairs make lists, and how many pivots these need.
PLACES, NEAR = ((0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (1, 2), (1, 3), (2, 3)), 6
#: Rows of a block; rows of short lists in a task, about; cosine up to which two pivots may be near; lists up to which their table is broadcast.
BLOCK, TASK, APART, BROADCAST_LISTS = 1_024, 8_192, 0.9, 500_000


def pivots_of(x: np.ndarray, most: int) -> np.ndarray:
    """At most most rows of x, normalised, of which no two are nearer than APART."""
    kept, k = np.zeros((most, x.shape[1])), 0
    for v in unit(x) if len(x) else x:
        if k < most and (kept[:k] @ v).max(initial=-1) < APART:
            kept[k] = v
            k += 1
    return kept[:k]


def _local_labels(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each row's component."""
    labels = ids.copy()
    while True:
        lower = np.minimum(labels, np.where(linked, labels[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (lower == labels).all():
            return labels
        labels = lower


def _verified(x: np.ndarray, ids: np.ndarray, m: np.ndarray, lists: np.ndarray, own: int, threshold: float, blocks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """ids, links and labels of the linked members (unit vectors x) of one list, own; blocks: only pairs of two."""
    close = x @ x.T >= threshold
    np.fill_diagonal(close, False)
    if blocks is not None:
        close &= blocks[:, None] != blocks[None, :]
    some = np.flatnonzero(close.any(axis=1))
    if not len(some):
        return None
    close, ids, m, lists = close[np.ix_(some, some)], ids[some], m[some], lists[some]
    links = np.zeros(len(some), np.int64)
    a, b = np.nonzero(np.triu(close))
    for k in range(0, len(a), 1 << 16):
        i, j = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
        smaller = (lists[i][:, :, None] == lists[j][:, None, :]).any(axis=2) & (lists[i] < own)
        first = ~smaller.any(axis=1)  # a pair that shares a smaller list is counted there
        np.add.at(links, i[first], m[j[first]])
        np.add.at(links, j[first], m[i[first]])
    return ids, links, _local_labels(close, ids)


def linked(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    every, dimension = usable(vectors, id_col, vector_col)
    name_id, name_vector = column(vectors, id_col), column(vectors, vector_col)
    kind = positional(vectors).schema[name_vector].dataType
    narrow = "float" if getattr(kind, "elementType", None) == FloatType() else "double"  # shuffled as given
    with scope() as needed:
        every = stored(every.select("id", F.col("e").cast(f"array<{narrow}>").alias("e")).withColumn("key", F.xxhash64("e")).withColumn("key2", F.xxhash64(F.lit(5), "e")), "vectors")
        # Classes of equal vectors, by 128 bits of hashes.
        classes = stored(every.groupBy("key", "key2").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("e").alias("e")).withColumn("cid", F.monotonically_increasing_id()), "classes")
        n = classes.count()
        most = max(2, min(max(FEWEST, int(GROWTH * math.sqrt(n))), PIVOT_BYTES // (8 * max(1, dimension))))
        _, sample = collected(classes.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(SAMPLE * most).select("id", "e"), dimension)
        pivots = pivots_of(sample, most)
        near = min(NEAR, len(pivots))
        places = [(i, j) for i, j in PLACES if j < near]

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = np.zeros((b.num_rows, max(1, len(places))), np.int64)
                if places and b.num_rows:
                    s = unit(matrix(b.column("e"), dimension)) @ pivots.T
                    top = np.argpartition(-s, near - 1, axis=1)[:, :near]
                    order = np.lexsort((top, -np.take_along_axis(s, top, 1)), axis=1)
                    top = np.take_along_axis(top, order, 1)
                    lists = np.stack([np.minimum(top[:, i], top[:, j]) * len(pivots) + np.maximum(top[:, i], top[:, j]) for i, j in places], axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(lists), pa.list_(pa.int64()))], ["cid", "id", "m", "e", "lists"])

        described = stored(classes.select("cid", "id", "m", "e").mapInArrow(describe, f"cid long, id long, m long, e array<{narrow}>, lists array<long>"), "described")
        entries = described.select("cid", F.explode("lists").alias("list"))
        counts = stored(entries.groupBy("list").count().where("count > 1"), "lists")
        alive = joined(entries, counts, "list", "cid", counts=counts).groupBy("cid").agg(F.collect_list(F.struct("list", "count")).alias("alive"))  # at most len(PLACES)
        met = described.join(alive, "cid").withColumn("x", F.explode("alive")).select("id", "m", "e", "lists", F.col("x.list").alias("list"), F.col("x.count").alias("count"))
        tasks = max(1, (counts.where(F.col("count") <= BLOCK).agg(F.sum("count")).first()[0] or 0) // TASK)
        blocks = F.ceil(F.col("count") / BLOCK).cast("int")
        big = met.where(F.col("count") > BLOCK).withColumn("mine", F.pmod(F.xxhash64(F.lit(2), "id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(F.col("list").alias("task"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "list", "id", "m", "e", "lists")
        little = met.where(F.col("count") <= BLOCK).select(F.pmod(F.xxhash64(F.lit(3), "list"), F.lit(tasks)).cast("long").alias("task"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(-1).alias("mine"), "list", "id", "m", "e", "lists")

        def verify(t: pa.Table) -> pa.Table:
            ids, m, mine, own = (t[c].to_numpy() for c in ("id", "m", "mine", "list"))
            x, lists = unit(matrix(t["e"], dimension)), matrix(t["lists"], max(1, len(places))).astype(np.int64)
            two = t["i"][0].as_py() != t["j"][0].as_py()
            order = np.argsort(own, kind="stable")
            found = []
            for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                if len(part) > 1:
                    got = _verified(x[part], ids[part], m[part], lists[part], own[part[0]], threshold, mine[part] if two else None)
                    if got is not None:
                        found.append(got)
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
            return pa.table(dict(zip(("id", "links", "label"), (pa.array(c, pa.int64()) for c in columns), strict=True)))

        found = stored(big.unionAll(little).groupBy("task", "i", "j").applyInArrow(verify, "id long, links long, label long"), "links")
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        labels = minimum_labels(found.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b")).distinct())
        known = stored(classes.select("key", "key2", "id", "m").join(links, "id", "left").join(labels, "id", "left").select("key", F.col("key2").alias("own"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("label", "id").alias("component")), "known")
        members = joined(every.select("id", "key", "key2"), known, "key", "id").where("key2 = own").select("id", "n", "component")
        needed.append(members)
    rest = positional(vectors).select(F.col(name_id).cast("long").alias("id"), F.col(name_vector).cast("array<double>").alias("e"))
    part = F.col("id").isNotNull() & F.col("e").isNotNull() & (F.size("e") == dimension) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    others = rest.where(~F.coalesce(part, F.lit(False))).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    out = members.unionAll(others)
    return out.select(F.col("id").alias("vec_id"), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
