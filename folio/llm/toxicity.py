"""Operator 2: toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words and their beginnings are hashed; buckets that are frequent enough in the training rows have an embedding, all
others share a zero one, and a word's vector is the sum of its buckets' embeddings.
Filters of several widths slide over the whole text, the greatest response of each is kept, and a logistic layer on
these gives the score, calibrated (Platt) on training rows that were not fitted. Thresholds are calibrated for each
language on the same rows; language decides over the threshold only, never over a score.

Training uses at most about MAX_CLASS labelled rows of each class, chosen by a hash of the id, and TRAIN_BYTES of their
texts, of which none is longer than a hundredth of that, so what comes to the driver is bounded in rows and bytes;
scoring is one pass without a shuffle, over whole texts. Null texts count as empty and get the score of a text without
words; repeated rows give repeated scores; ids with contradicting labels aren't trained on, and of an id with several
texts only the smallest is. Without both classes in the training rows every score is the share of label 1 (0.5 if there
are none). Languages with few labelled toxic rows, unknown ones and nulls have the threshold DEFAULT_THRESHOLD, as has a
table without languages. Extra columns are not read, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import column, fold, positional, slabs, texts_of
from folio.llm.quality import sampled

#: Labelled rows of each class that are trained on, at most; rows of them that a bucket needs; embedding size, filters of each width.
MAX_CLASS, LEAST_ROWS, SIZE, FILTERS, WIDTHS = 2_500, 3, 8, 12, (1, 2, 3)
#: Bytes of texts of each class that are trained on, at most about.
TRAIN_BYTES = 30_000_000
EPOCHS, BATCH, RATE, DECAY, WORD_DROP, START, SEED = 8, 48, 0.1, 1e-5, 0.1, 0.02, 5
#: Lengths of the beginnings of a word that have buckets of their own, besides the whole word.
PREFIXES = (4, 5, 6, 7, 8, 9)
#: Hash bits; words in a worker's table; threshold where a language has fewer than LEAST_TOXIC toxic rows.
BITS, MEMO, DEFAULT_THRESHOLD, LEAST_TOXIC = 26, 500_000, 0.7, 20
_PARTS, _MASK = len(PREFIXES) + 1, (1 << BITS) - 1
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def buckets_of(words: list[str]) -> np.ndarray:
    """_PARTS hashes (from 1; 0: none) for each word: of the word and of its proper beginnings."""
    out, crc = [], zlib.crc32
    for w in words:
        n = len(w)
        out.append((crc(w.encode("utf-8", "replace")) & _MASK) + 1)
        for k in PREFIXES:
            out.append((crc(("<" + w[:k]).encode("utf-8", "replace")) & _MASK) + 1 if n > k else 0)
    return np.array(out, np.int64).reshape(-1, _PARTS)


@dataclass
class Network:
    """buckets: sorted hash values with an embedding, rows 1.. of table; some MB at most."""

    buckets: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray] = field(default_factory=list)  # width x SIZE x FILTERS
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS)))
    at: float = 0.0
    platt: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    memo: dict[str, int] = field(default_factory=dict)  # word -> row of known; both belong to one process
    known: np.ndarray = field(default_factory=lambda: np.zeros((1024, SIZE), np.float32))

    def forget(self) -> None:
        self.memo, self.known = {}, np.zeros((1024, SIZE), np.float32)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the table; 0 for buckets without an embedding."""
        if not len(self.buckets):
            return np.zeros(hashes.shape, np.int64)
        k = np.minimum(np.searchsorted(self.buckets, hashes), len(self.buckets) - 1)
        return np.where(self.buckets[k] == hashes, k + 1, 0)

    def vectors(self, words: list[str]) -> np.ndarray:
        """A word's embedding: the sum of its buckets' embeddings."""
        return self.table[self.rows(buckets_of(words))].sum(axis=1)

    def numbered(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the places of its words in the memo table, which gets the vectors of new words."""
        out, memo = [], self.memo
        for t in texts:
            words = words_of(t)
            if len(memo) > MEMO:
                break
            new = [w for w in dict.fromkeys(words) if w not in memo]
            if new:
                at = len(memo) + 1
                if at + len(new) > len(self.known):
                    self.known = np.concatenate([self.known, np.zeros((max(len(new), len(self.known)), SIZE), np.float32)])
                self.known[at : at + len(new)] = self.vectors(new)
                memo.update(zip(new, range(at, at + len(new)), strict=True))
            out.append(np.array([memo[w] for w in words], np.int64))
        return out

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """For each width the response of its filters at each position of x, word vectors followed by enough zeros."""
        out = []
        for f, b in zip(self.filters, self.bias, strict=True):
            n = len(x) - len(f) + 1
            y = x[:n] @ f[0]
            for j in range(1, len(f)):
                y += x[j : n + j] @ f[j]
            y += b
            out.append(y)
        return out

    def logits(self, texts: list[str]) -> np.ndarray:
        out: list[np.ndarray] = []
        done, pad = 0, np.zeros(max(WIDTHS), np.int64)
        while done < len(texts):
            ids_of = self.numbered(texts[done:])
            if ids_of:
                ids = np.concatenate([x for t in ids_of for x in (t, pad)] + [pad])
                starts = np.cumsum([0] + [len(t) + len(pad) for t in ids_of[:-1]])
                # A text's windows begin at its words and at the first zero behind them; later ones would reach the next text.
                ends = np.stack([starts, starts + [len(t) + 1 for t in ids_of]], axis=1).ravel()
                pooled = np.concatenate([np.maximum(np.maximum.reduceat(y, ends, axis=0)[::2], 0) for y in self.responses(self.known[ids])], axis=1)
                out.append(pooled @ self.out + self.at)
                done += len(ids_of)
            if len(self.memo) > MEMO:
                self.memo.clear()
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.logits(texts) + b, -30, 30)))


def _fit(net: Network, texts: list[np.ndarray], parts_of: np.ndarray, y: np.ndarray) -> None:
    """Stochastic gradients with Adagrad; only the positions that won the pooling carry a gradient.

    texts: word numbers from 1; parts_of: rows of the table for each word number.
    """
    rng = np.random.default_rng(SEED)
    net.table = rng.normal(0, START, (len(net.buckets) + 1, SIZE)).astype(np.float32)
    net.table[0] = 0
    net.filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    net.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    net.out = rng.normal(0, 0.1, FILTERS * len(WIDTHS))
    net.at = 0.0
    rows = texts
    params = [net.table, *net.filters, *net.bias, net.out]
    squares = [np.full(p.shape, 1e-4) for p in params]
    rare = np.flatnonzero(y == (1 if y.mean() < 0.5 else 0))  # rows of the smaller class, shown again
    again = min(9, round(len(y) / max(1, len(rare))) - 2) if len(y) > 2 * len(rare) else 0
    square_at, pad = 1e-4, np.zeros(max(WIDTHS), np.int64)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + 0.3 * epoch)
        order = rng.permutation(np.concatenate([np.arange(len(rows)), np.repeat(rare, again)]))
        for k in range(0, len(order), BATCH):
            batch = order[k : k + BATCH]
            parts = [np.where(rng.random(len(rows[i])) < WORD_DROP, 0, rows[i]) for i in batch]
            ids = np.concatenate([x for p in parts for x in (p, pad)] + [pad])
            starts = np.cumsum([0] + [len(p) + len(pad) for p in parts])
            x = net.table[parts_of[ids]].sum(axis=1)
            ys = net.responses(x)
            best = [np.stack([a + y[a : b - len(pad) + 1].argmax(axis=0) for a, b in zip(starts, starts[1:], strict=False)]) for y in ys]
            top = np.concatenate([np.take_along_axis(y, b, 0) for y, b in zip(ys, best, strict=True)], axis=1)
            pooled = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.at, -30, 30)))
            d = (p - y[batch]) / len(batch)
            grads = [np.zeros_like(x) for x in params[1:]]
            grads[-1] = pooled.T @ d + DECAY * net.out
            back = (d[:, None] * net.out[None, :] * (top > 0)).reshape(len(batch), len(WIDTHS), FILTERS)
            touched, moves = [], []
            for m, w in enumerate(WIDTHS):
                g = back[:, m].astype(np.float32)
                grads[len(WIDTHS) + m] = g.sum(0)
                for j in range(w):
                    at = best[m] + j  # documents x filters
                    grads[m][j] = np.einsum("dfs,df->sf", x[at], g) + DECAY * net.filters[m][j]
                    move = (g[:, :, None] * net.filters[m][j].T[None]).reshape(-1, SIZE)
                    parts_at = parts_of[ids[at.ravel()]]
                    touched.append(parts_at.ravel())
                    moves.append(np.repeat(move, _PARTS, axis=0))
            rows_at, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            change = np.zeros((len(rows_at), SIZE))
            np.add.at(change, inverse, np.concatenate(moves))
            squares[0][rows_at] += change**2
            net.table[rows_at] -= (rate * change / np.sqrt(squares[0][rows_at])).astype(np.float32)
            net.table[0] = 0
            for x, g, s in zip(params[1:], grads, squares[1:], strict=True):
                s += g**2
                x -= (rate * g / np.sqrt(s)).astype(x.dtype)
            square_at += d.sum() ** 2
            net.at -= rate * d.sum() / np.sqrt(square_at)


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one value, by Newton steps with a small penalty; the slope stays positive."""
    spread = max(float(z.std()), 1e-9)
    z, a, b = z / spread, 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = weight * p * (1 - p) + 1e-3
        g = np.array([(weight * (p - y) * z).sum() + 0.05 * a, (weight * (p - y)).sum() + 0.05 * b])
        h = np.array([[(w * z * z).sum() + 0.05, (w * z).sum()], [(w * z).sum(), w.sum() + 0.05]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
    return (a / spread, b) if a > 0 and np.isfinite(a + b) else (1.0, 0.0)


def _threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The least score at which the F1 on these rows is greatest, halfway to the next lower score."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum((y * weight)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + (y * weight).sum())
    k = int(np.argmax(f1))
    return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(p) else 0.0)) / 2)


def train(docs: DataFrame, labels: DataFrame, held_out=lambda i: fold(i, 3) == 1, bound: int = MAX_CLASS, lang_col: str = "lang") -> Network:
    """Fits the network on labelled rows outside the held-out fold. lang_col is used for thresholds only."""
    # At most about bound texts and TRAIN_BYTES of each class come to the driver.
    rows = sampled(docs, labels, "toxic", held_out, 2 * bound, keep=lang_col, each=bound, room=TRAIN_BYTES).toPandas().sort_values(["text", "y"], kind="stable")
    y = rows["y"].to_numpy(float)
    net = Network(np.zeros(0, np.int64), np.zeros((1, SIZE), np.float32))
    fit = rows["part"].to_numpy() == 0
    if not len(y) or fit.sum() < 2 or y[fit].min() == y[fit].max():
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    numbers: dict[str, int] = {}
    texts, seen = [], []
    for t, f in zip(rows["text"], fit, strict=True):
        if f:
            texts.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in words_of(t)], np.int64))
    hashes = buckets_of(list(numbers))
    for t in texts:
        h = np.unique(hashes[np.unique(t) - 1])
        seen.append(h[h > 0])
    buckets, n = np.unique(np.concatenate(seen), return_counts=True)
    net.buckets = buckets[n >= LEAST_ROWS]
    parts_of = np.concatenate([np.zeros((1, _PARTS), np.int64), net.rows(hashes)])
    _fit(net, texts, parts_of, y[fit])
    rest = ~fit if (~fit).any() else fit
    held, weight = rows["text"][rest].tolist(), rows["weight"][rest].to_numpy(float)
    net.platt = _platt(np.concatenate([net.logits(held[i : i + 64]) for i in range(0, len(held), 64)]), y[rest], weight / weight.mean())
    p = np.concatenate([net.score(held[i : i + 64]) for i in range(0, len(held), 64)])
    langs = rows["keep"][rest].to_numpy()
    for lang in sorted({x for x in langs if x is not None}):
        mine = langs == lang
        if y[rest][mine].sum() >= LEAST_TOXIC:
            net.thresholds[lang] = _threshold(p[mine], y[rest][mine], weight[mine])
    net.forget()
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slabs(batches):
            found = net.score(texts_of(b))
            yield pa.RecordBatch.from_arrays([*b.columns[:1], *b.columns[2:], pa.array(found, pa.float64())], ["doc_id", "lang", "score"])

    at = positional(docs)
    lang = F.col(column(docs, "lang")).cast("string") if "lang" in [c.lower() for c in docs.columns] else F.lit(None).cast("string")
    return at.select(F.col(column(docs, id_col)).cast("long").alias("doc_id"), F.col(column(docs, text_col)).cast("string").alias("text"), lang.alias("lang")).mapInArrow(run, "doc_id long, lang string, score double")


def threshold(net: Network, lang: Column) -> Column:
    """The calibrated threshold of a language."""
    out = F.lit(DEFAULT_THRESHOLD)
    for k, v in sorted(net.thresholds.items()):
        out = F.when(lang == k, F.lit(v)).otherwise(out)
    return out
