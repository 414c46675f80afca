"""Operator 1: quality classifier: random Fourier features, partition-summed ridge, isotonic calibration.

Each whole text becomes a short vector of document statistics (character classes, word and line repetition, lengths,
mean, least and greatest compressibility of its blocks). Random Fourier features of the standardised statistics approximate a Gaussian kernel; ridge weights
come from normal equations that each partition of the training rows sums for itself. Pool-adjacent-violators on a
separate part of the training rows turns ridge values into calibrated scores.

Training uses at most MAX_TRAIN labelled rows, chosen by a hash of the id, so its cost doesn't depend on the corpus;
scoring is one pass without a shuffle. Neither labels nor language, source or id enter a score.

Null texts count as empty and get a score like any other; a null id is in no held-out fold. Rows are scored each, so
repeated rows give repeated scores and equal texts equal ones; ids with contradicting labels aren't trained on, and of an
id with several texts only the smallest is. Without both classes in the training rows every score is the share of label 1
(0.5 if there are no labels); without rows set apart for calibration the fitted rows calibrate. Only the id and the text
are read, whatever the names of other columns; keep_scored() keeps all columns. Empty tables give empty tables.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import column, fold, positional, slabs

#: Labelled rows that are trained on, at most (expected size of the hash sample), and the partitions that hold them.
MAX_TRAIN, TRAIN_PARTITIONS = 24_000, 8
#: Random Fourier features, kernel width in standard deviations, ridge penalty for each training row.
FEATURES, WIDTH, RIDGE, SEED = 384, 4.0, 1e-4, 7
_WORD = re.compile(rb"[^\x00-\x20]+")
_STATS = 28
#: Bytes that are compressed together, at most: the window of zlib.
BLOCK = 32_768


def block_ratios(raw: bytes) -> np.ndarray:
    """Compressed share of each of the blocks, as few and as equal as BLOCK allows, that make up the whole of raw (not empty)."""
    k = -(-len(raw) // BLOCK)
    at = [i * len(raw) // k for i in range(k + 1)]
    return np.array([len(zlib.compress(raw[a:b], 1)) / (b - a) for a, b in zip(at, at[1:], strict=False)])


def statistics(raw: bytes) -> np.ndarray:
    """Statistics of one text in UTF-8; all 0 for an empty text."""
    out = np.zeros(_STATS)
    n = len(raw)
    if not n:
        return out
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    w = max(1, len(words))
    lines = raw.split(b"\n")
    different = set(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    pairs = len(set(zip(words, words[1:], strict=False)))
    letters = h[65:91].sum() + h[97:123].sum() + h[128:].sum()
    marks = h[33:48].sum() + h[58:65].sum() + h[91:97].sum() + h[123:127].sum()
    usual = h[[33, 44, 46, 63]].sum()  # ! , . ?
    packed = block_ratios(raw)
    out[:] = (
        np.log1p(n), np.log1p(w), sizes.mean(), sizes.std(), np.log1p(sizes.max()),
        letters / n, h[65:91].sum() / max(1, letters), h[48:58].sum() / n, marks / n, (marks - usual) / n, h[128:].sum() / n,
        h[33] / w, h[44] / w, h[46] / w, h[10] / w, h[124] / w, (h[35] + h[36] + h[37] + h[38] + h[42]) / w, h[32] / n,
        len(different) / w, pairs / max(1, len(words) - 1), len(set(lines)) / len(lines), np.log1p(len(lines)),
        np.log1p(n / len(lines)), len(different) / np.sqrt(w), (h[:32].sum() - h[10]) / n, packed.mean(), packed.min(), packed.max(),
    )
    return out


def _table(batch: pa.RecordBatch) -> np.ndarray:
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    return np.stack([statistics(x or b"") for x in texts])


@dataclass
class Model:
    """Everything that scoring needs; a few hundred KB at most."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def lifted(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.omega + self.phase) * np.sqrt(2 / self.omega.shape[1]), np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lifted(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; blocks are joined linearly between their mean positions, with a slight slope inside."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of x, sum of y, rows
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    t = np.array(blocks)
    knots = np.concatenate([[x.min() - 1e-6 - 1], t[:, 0] / t[:, 2], [x.max() + 1]])
    means = (t[:, 1] + 0.25) / (t[:, 2] + 0.5)  # keeps pure blocks off 0 and 1, larger ones less
    values = np.maximum.accumulate(np.concatenate([[means[0] * 0.98], means, [means[-1] + (1 - means[-1]) * 0.5]]))
    return np.maximum.accumulate(knots), values


def sampled(docs: DataFrame, labels: DataFrame, label: str, held_out, bound: int, keep: str | None = None, each: int | None = None, room: int | None = None) -> DataFrame:
    """(y, part, text, weight and keep) of at most about bound labelled rows outside the held-out fold; part: 0 fits, 1 calibrates.

    keep: a column of docs that goes along, null if docs has none of that name. each: rows of each class, at most about;
    room: bytes of texts of each class, at most about, of which no text takes more than a hundredth.
    """
    marks = positional(labels).select(F.col(column(labels, "doc_id")).cast("long").alias("id"), F.col(column(labels, label)).cast("int").alias("y"))
    one = marks.where("y IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("hi")).where("y = hi").drop("hi").where(~held_out(F.col("id")))
    unit = lambda seed: (F.xxhash64(F.lit(seed), "id") % 1_000_000 + 1_000_000) / 2_000_000
    known = keep is not None and keep.lower() in [c.lower() for c in docs.columns]
    text = positional(docs).select(F.col(column(docs, "doc_id")).cast("long").alias("id"), F.coalesce(F.col(column(docs, "text")).cast("string"), F.lit("")).alias("text"), (F.col(column(docs, keep)).cast("string") if known else F.lit(None).cast("string")).alias("keep"))
    if each is None:
        share = F.lit(min(1.0, bound / max(1, one.count())))
    else:
        n = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
        shares = {y: min(1.0, each / max(1, n.get(y, 0))) for y in (0, 1)}
        share = F.when(F.col("y") == 1, shares[1]).otherwise(shares[0])
    few = one.withColumn("weight", 1 / share).where(unit(11) < share)
    # At most about bound rows of ids: a few hundred KB. Only their texts are shuffled, and combined by id before.
    rows = text.join(F.broadcast(few), "id")
    if room is not None:
        rows = rows.where(F.octet_length("text") <= room // 100)
        size = {r["y"]: r["size"] for r in rows.groupBy("y").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
        part = {y: min(1.0, room / max(1, size.get(y, 0) or 0)) for y in (0, 1)}
        left = F.when(F.col("y") == 1, part[1]).otherwise(part[0])
        rows = rows.where(unit(12) < left).withColumn("weight", F.col("weight") / left)
    rows = rows.groupBy("id", "y", "weight").agg(F.min(F.struct("text", "keep")).alias("x"))
    return rows.select("y", F.when(unit(13) < 0.35, 1).otherwise(0).alias("part"), F.col("x.text").alias("text"), "weight", F.col("x.keep").alias("keep"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out=lambda i: fold(i, 5) == 0, bound: int = MAX_TRAIN) -> Model:
    """Fits the model on the labelled rows for which held_out(id) is false."""

    def stats_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slabs(batches):
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("part"), pa.array(list(_table(b)), pa.list_(pa.float64()))], ["y", "part", "x"])

    # About bound rows of _STATS doubles (5 MB at MAX_TRAIN): standardised and lifted on the driver's plan, summed by partition.
    rows = sampled(docs, labels, label, held_out, bound).mapInArrow(stats_of, "y int, part int, x array<double>").persist()
    try:
        m = rows.select("y", *[F.element_at("x", i + 1).alias(f"x{i}") for i in range(_STATS)]).agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[f(f"x{i}").alias(f"{k}{i}") for i in range(_STATS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        rng = np.random.default_rng(SEED)
        mean = np.array([m[f"m{i}"] or 0.0 for i in range(_STATS)])
        scale = np.array([(m[f"s{i}"] or 0.0) + 1e-6 for i in range(_STATS)])
        model = Model(mean, scale, rng.normal(0, 1 / WIDTH, (_STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.full(2, 0.5 if m["y"] is None else m["y"]))
        if not m["n"] or m["y"] in (0.0, 1.0):
            return model
        width = FEATURES + 1

        def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b = np.zeros((width, width)), np.zeros(width)
            for batch in batches:
                y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
                z = model.lifted(np.stack(batch.column("x").to_numpy(zero_copy_only=False))) if len(y) else np.zeros((0, width))
                a, b = a + z.T @ z, b + z.T @ y
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], ["a", "b"])

        sums = rows.where("part = 0").select("y", "x").coalesce(TRAIN_PARTITIONS).mapInArrow(equations, "a binary, b binary").collect()  # TRAIN_PARTITIONS rows
        a = sum(np.frombuffer(r["a"]).reshape(width, width) for r in sums)
        b = sum(np.frombuffer(r["b"]) for r in sums)
        model.weights = np.linalg.solve(a + RIDGE * m["n"] * np.eye(width), b)
        apart = rows.where("part = 1").limit(1).count()
        kept = rows.where("part = 1" if apart else "part = 0").select("y", "x").toPandas()  # a part of the bounded sample
        if len(kept):
            model.knots, model.values = isotonic(model.raw(np.stack(kept["x"].to_numpy())), kept["y"].to_numpy(float))
        return model
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slabs(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_table(b)))], ["doc_id", "score"])

    at = positional(docs)
    return at.select(F.col(column(docs, id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(column(docs, text_col)).cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_scored(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is at least least, with all their columns; no shuffle."""
    at = positional(docs)
    text = column(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slabs(batches, text):
            good = model.score(np.stack([statistics(x or b"") for x in s.column(text).cast(pa.binary()).to_pylist()])) >= least
            yield s.filter(pa.array(good))

    return at.mapInArrow(run, at.schema).toDF(*docs.columns)
