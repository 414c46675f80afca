"""Operator 4: nearest neighbours by largest inner product over a hierarchical k-means tree, best bin first.

The tree is fitted on a sample of at most SAMPLE_BYTES. Leaves that get more than LEAF_ROWS of all rows are split again, on
the executors, by trees fitted on samples of their own rows, up to TREE_BYTES of centres; so leaves keep their size and
the work for a query doesn't grow with the table as long as the tree may. A query walks it with a priority queue of nodes, ordered by the greatest
inner product that the node may hold, estimated from its centre and spread, and visits leaves until the calibrated
number is reached (and at least enough rows have been seen). That number is found for each run: a fixed number of
queries is answered exactly against all rows, in one pass, and visits are widened until TARGET of these neighbours is
in visited leaves; if need be, up to all leaves, which is exact.

All rows are indexed. Leaves are packed into bins of up to BIN rows, and large leaves are split over several, so neither
a popular leaf nor copies of one vector make a large task; queries meet a bin in blocks of up to BLOCK. A query first
meets the bin of its best leaf; the score of the last of the k rows found there bounds what its other bins need to
return. The best rows of all bins are the result. Scores are inner products of the original vectors in
double precision, computed in one order of components, so equal vectors have equal scores; ties go to the smaller id.

Vectors that are null or zero, or hold null or non-finite components, take no part, neither do null ids and vectors of
another length than the commonest. Repeated rows are candidates each; a query's own rows are those with its id, and of a
query id with several vectors the smallest, component by component, asks. Products that overflow count as infinite, those
without a value (a sum of opposite infinities) are no neighbours. Without queries or candidates the result is empty. Only
the id and the vector are read, whatever the names of other columns.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import column, positional, scope, stored
from folio.llm.vectors import collected, matrix, usable

#: Bytes of the vectors (as doubles) that the tree is fitted on, at most about; children of a node; sample rows of a leaf; rounds of k-means.
SAMPLE_BYTES, BRANCHES, LEAF_SAMPLE, ROUNDS, SEED = 48_000_000, 8, 96, 8, 3
#: Queries that are answered exactly, and the share of their neighbours that visited leaves must hold.
CALIBRATION, TARGET = 64, 0.985
#: Rows of a leaf above which it is split; its rows that decide how, about; bytes of centres of the whole tree; rounds of splitting.
LEAF_ROWS, SPLIT_SAMPLE, TREE_BYTES, SPLITS = 4_096, 2_048, 16_000_000, 4
BIN, BLOCK = 2_048, 4_096


@dataclass
class Tree:
    """centres, children (empty for leaves), spread of inner products, and the leaf number of each node."""

    centres: np.ndarray
    spread: np.ndarray
    children: list[np.ndarray] = field(default_factory=list)
    leaf: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    scale: float = 1.0  # of the vectors; centres are of vectors divided by it

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at each node the nearest child."""
        out, x = np.zeros(len(x), int), np.clip(x / self.scale, -1e150, 1e150)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not len(kids) or not len(rows):
                out[rows] = self.leaf[node]
                continue
            c = self.centres[kids]
            best = ((c**2).sum(1)[None, :] - 2 * x[rows] @ c.T).argmin(1)
            todo += [(int(k), rows[best == i]) for i, k in enumerate(kids)]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        q = q / np.abs(q).max()
        bound = self.centres @ q + np.linalg.norm(q) * self.spread
        heap = [(-bound[0], 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                yield int(self.leaf[node])
            for k in self.children[node]:
                heapq.heappush(heap, (-bound[k], int(k)))


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Labels of Lloyd's k-means."""
    c = x[rng.choice(len(x), k, replace=False)]
    labels = np.zeros(len(x), int)
    for _ in range(ROUNDS):
        labels = ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        n = np.bincount(labels, minlength=k)
        sums = np.stack([x[labels == j].sum(axis=0) for j in range(k)])
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return labels


def fit(x: np.ndarray) -> Tree:
    rng, scale = np.random.default_rng(SEED), float(np.abs(x).max())
    x = x / scale
    centres, spread, children, leaf = [x.mean(0)], [0.0], [], []
    rows = [np.arange(len(x))]
    k = 0
    while k < len(rows):
        mine = x[rows[k]]
        # A typical distance below the root mean square: what a leaf may add to its centre's product along a query.
        spread[k] = float(np.sqrt(((mine - centres[k]) ** 2).sum(1).mean() / x.shape[1]))
        kids: list[int] = []
        if len(mine) >= 2 * LEAF_SAMPLE and spread[k] > 0:
            labels = _means(mine, min(BRANCHES, len(mine) // LEAF_SAMPLE), rng)
            parts = [rows[k][labels == i] for i in range(labels.max() + 1) if (labels == i).any()]
            if len(parts) > 1:
                for p in parts:
                    kids.append(len(rows))
                    rows.append(p)
                    centres.append(x[p].mean(0))
                    spread.append(0.0)
        children.append(np.array(kids, int))
        leaf.append(-1 if kids else 0)
        k += 1
    return _numbered(Tree(np.array(centres), np.array(spread), children, np.array(leaf), scale))


def _numbered(tree: Tree) -> Tree:
    """tree, its leaves numbered depth first, so that neighbours in the tree are neighbours in number."""
    todo, n = [0], 0
    while todo:
        node = todo.pop()
        if len(tree.children[node]):
            todo += list(tree.children[node][::-1])
        else:
            tree.leaf[node] = n
            n += 1
    return tree


def grafted(tree: Tree, parts: dict[int, Tree]) -> Tree:
    """tree with trees over the rows of some leaves in the place of these."""
    centres, spread, children, leaf = list(tree.centres), list(tree.spread), list(tree.children), list(tree.leaf)
    for node in range(len(tree.leaf)):
        part = parts.get(int(tree.leaf[node]))
        if part is None or len(part.leaf) == 1:
            continue
        shift, ratio = len(centres) - 1, part.scale / tree.scale  # the part's root is this node
        centres += list(part.centres[1:] * ratio)
        spread += list(part.spread[1:] * ratio)
        children[node] = part.children[0] + shift
        children += [c + shift for c in part.children[1:]]
        leaf[node] = -1
        leaf += list(part.leaf[1:])
    return _numbered(Tree(np.array(centres), np.array(spread), children, np.array(leaf), tree.scale))


def _best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None, least: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(query row, row of x, score) of the k best rows for each query, of those with a score of least; ties to the smaller id."""
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        rough = q @ x.T
        # A product by blocks may differ from the sum in order by this much.
        slack = 4 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)
        out_of = q_ids[:, None] == ids[None, :]
        if allowed is not None:
            out_of |= ~allowed
        odd = ~np.isfinite(rough)
        rough[out_of] = -np.inf
        for i, s in enumerate(rough):
            near = np.flatnonzero(~out_of[i])
            if len(near) > k and not odd[i].any() and np.isfinite(slack[i]):
                near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k] - slack[i])
                near = near[~out_of[i][near]]
            exact = (x[near] * q[i]).sum(axis=1)
            near, exact = near[~np.isnan(exact)], exact[~np.isnan(exact)]
            top = np.lexsort((ids[near], -exact))[:k]
            out += [(i, near[j], exact[j]) for j in top if least is None or exact[j] >= least[i]]
    return out


def _split(placed: DataFrame, sizes: dict[int, int], big: list[int], dimension: int) -> dict[int, Tree]:
    """A tree for each of the leaves big, fitted on about SPLIT_SAMPLE of its rows."""
    share = placed.sparkSession.createDataFrame([(i, min(1.0, SPLIT_SAMPLE / sizes[i])) for i in big], "leaf int, share double")
    unit = (F.xxhash64(F.lit(SEED + 3), "id") % 1_000_000 + 1_000_000) / 2_000_000

    def one(t: pa.Table) -> pa.Table:
        return pa.table({"leaf": pa.array([t["leaf"][0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(fit(matrix(t["e"], dimension)))], pa.binary())})

    rows = placed.join(F.broadcast(share), "leaf").where(unit < F.col("share")).select("leaf", "e")
    return {r["leaf"]: pickle.loads(r["tree"]) for r in rows.groupBy("leaf").applyInArrow(one, "leaf int, tree binary").collect()}


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k rows nearest to each row for which is_query holds."""
    with scope() as needed:
        out = _neighbours(vectors, is_query, k, id_col, vector_col)
        needed.append(out)
    return out


def _neighbours(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str) -> DataFrame:
    spark = vectors.sparkSession
    every, dimension = usable(vectors, id_col, vector_col)
    every = stored(every, "every")
    marked = vectors.withColumn("__folio_query", is_query)
    asking = positional(marked).where(F.col(f"c{len(marked.columns) - 1}")).select(F.col(column(vectors, id_col)).cast("long").alias("id")).distinct()
    n = every.count()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if n < 2:
        return none
    unit = (F.xxhash64(F.lit(SEED), "id") % 1_000_000 + 1_000_000) / 2_000_000
    most = max(1, SAMPLE_BYTES // (8 * dimension))
    _, sample = collected(every.where(unit < most / n) if n > most else every, dimension)
    if not len(sample):
        _, sample = collected(every.limit(1), dimension)
    tree = fit(sample)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("e"), pa.array(tree.assign(matrix(b.column("e"), dimension)).astype(np.int32))], ["id", "e", "leaf"])

    for turn in range(SPLITS + 1):
        placed = stored(every.mapInArrow(place, "id long, e array<double>, leaf int"), "leaves")
        sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # as many rows as the tree has leaves
        room = TREE_BYTES // (8 * dimension) - len(tree.leaf)
        big = sorted((i for i, c in sizes.items() if c > LEAF_ROWS), key=lambda i: -sizes[i])[: max(0, room * LEAF_SAMPLE // (2 * SPLIT_SAMPLE))]
        larger = grafted(tree, _split(placed, sizes, big, dimension)) if big and turn < SPLITS else tree
        if len(larger.leaf) == len(tree.leaf):  # no leaf to split, or of copies only
            break
        tree = larger
    queries = every.join(asking, "id", "left_semi").groupBy("id").agg(F.min("e").alias("e"))

    # Calibration: exact neighbours of a bounded set of queries, in one pass over all rows.
    few = queries.orderBy(F.xxhash64(F.lit(SEED + 1), "id"), "id").limit(CALIBRATION)
    q_ids, q = collected(few, dimension)
    if not len(q_ids):
        return none

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in q_ids]  # of the partition: (-score, id, leaf)
        for b in batches:
            x, ids, leaf = matrix(b.column("e"), dimension), b.column("id").to_numpy(), b.column("leaf").to_numpy()
            for a in range(0, len(ids), BLOCK):
                for i, j, s in _best(q, q_ids, x[a : a + BLOCK], ids[a : a + BLOCK], k, None):
                    best[i].append((-s, int(ids[a + j]), int(leaf[a + j])))
                best = [heapq.nsmallest(k, rows) for rows in best]
        found = [(int(q_ids[i]), v, -s, leaf) for i, rows in enumerate(best) for s, v, leaf in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int32()))], ["query_id", "vec_id", "score", "leaf"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = placed.mapInArrow(exact, "query_id long, vec_id long, score double, leaf int").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "leaf").collect()  # CALIBRATION x k rows
    rank_of = {int(i): {leaf: r for r, leaf in enumerate(tree.visits(v))} for i, v in zip(q_ids, q, strict=True)}
    depth = np.sort([rank_of[r["query_id"]][r["leaf"]] for r in truth]) if truth else np.array([0])
    visits = int(depth[min(len(depth) - 1, int(np.ceil(TARGET * len(depth))) - 1)]) + 1

    # Bins: consecutive leaves with up to BIN rows; a larger leaf has several bins, and its rows are dealt by hash.
    bins: dict[int, tuple[int, int]] = {}
    at, room = -1, 0
    for leaf in range(tree.leaves):
        size = sizes.get(leaf, 0)
        if size > room:
            parts = max(1, -(-size // BIN))
            bins[leaf] = (at + 1, parts)
            at += parts
            room = BIN - size if parts == 1 else 0
        else:
            bins[leaf] = (max(at, 0), 1)
            room -= size
    at = max(at, 0)
    where = spark.createDataFrame([(i, *bins[i]) for i in range(tree.leaves)], "leaf int, at int, parts int")  # as many rows as the tree has leaves

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int, list[int], bool]] = []
            for i, v in enumerate(matrix(b.column("e"), dimension)):
                seen, mine = 0, {}
                for step, leaf in enumerate(tree.visits(v)):
                    if step >= visits and seen > k:
                        break
                    seen += sizes.get(leaf, 0)
                    for part in range(bins[leaf][1] if sizes.get(leaf) else 0):
                        mine.setdefault(bins[leaf][0] + part, []).append(leaf)
                rows += [(i, bin_, leaves, n == 0) for n, (bin_, leaves) in enumerate(mine.items())]
            for a in range(0, len(rows), 10_000):
                some = rows[a : a + 10_000]
                pick = pa.array([r[0] for r in some], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("id").take(pick), b.column("e").take(pick), pa.array([r[1] for r in some], pa.int32()), pa.array([r[2] for r in some], pa.list_(pa.int32())), pa.array([r[3] for r in some])], ["id", "e", "bin", "leaves", "first"])

    asked = stored(queries.mapInArrow(walk, "id long, e array<double>, bin int, leaves array<int>, first boolean"), "visits")
    deal = lambda c, m: F.pmod(F.xxhash64(F.lit(SEED + 2), c), m).cast("int")
    binned = placed.join(F.broadcast(where), "leaf").select((F.col("at") + deal(F.col("id"), F.col("parts"))).alias("bin"), "id", "e", "leaf")

    def meet(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        x, ids, leaf = matrix(rows["e"], dimension), rows["id"].to_numpy(), rows["leaf"].to_numpy()
        qs, q_all, wanted = matrix(asks["e"], dimension), asks["id"].to_numpy(), asks["leaves"].to_pylist()
        least = asks["least"].to_numpy()
        for a in range(0, len(q_all) if len(ids) else 0, 256):
            allowed = np.stack([np.isin(leaf, w) for w in wanted[a : a + 256]])
            out += [(int(q_all[a + i]), int(ids[j]), float(s)) for i, j, s in _best(qs[a : a + 256], q_all[a : a + 256], x, ids, k, allowed, least[a : a + 256])]
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    def met(asks: DataFrame) -> DataFrame:
        """asks: asked with least. Blocks of queries for each bin are counted in a table, as bins grow with the rows."""
        blocks = asks.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        left = binned.join(blocks, "bin").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bin", "block", "id", "e", "leaf")
        right = asks.join(blocks, "bin").withColumn("block", deal(F.col("id"), F.col("blocks"))).select("bin", "block", "id", "e", "leaves", "least")
        return left.groupBy("bin", "block").cogroup(right.groupBy("bin", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")

    lowest = F.lit(float("-inf"))
    home = stored(met(asked.where("first").withColumn("least", lowest)), "home")
    bounds = home.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select("id", "s")
    rest = met(asked.where("NOT first").join(bounds, "id", "left").withColumn("least", F.coalesce("s", lowest)))
    return home.unionAll(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
