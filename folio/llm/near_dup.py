"""Operator 5: near-duplicates by bottom-k sketches of one hash function.

A document's set holds its distinct five-word shingles as 63-bit hashes; its sketch is the KEEP smallest of them (all of
a set of up to WHOLE). Documents with equal sets are one class, so copies cost nothing beyond the first pass.

Candidates come from inverted lists of retained values. In two linked documents the sketches share at least NEED values
(the chance of fewer, at the threshold, is 4e-9 a pair; small sets are exact), so, with the values of a sketch in the
order of their frequency, the first (size - NEED + 1) of each must meet in one. Only these are listed, which keeps
passages that many documents share out of the lists. The union of two sketches estimates the similarity; pairs that can
reach the threshold are verified on full sets. This goes in two rounds. First each class meets the first one of its
lists, which joins most of a group of near copies in a star. Then the lists that still hold several components are
joined to neighbourhoods. In each of these the sketches of all members are compared, in blocks, and those without a
partner of another component drop out; the full sets of the rest decide, again in blocks, of a bounded number of
shingles. Only links that join two components leave a block, so a group's pairs are never listed, and no link between
components of a neighbourhood is lost.

Components are found by minimum labels with pointer jumping, in tables; nothing but counts, sums and hot keys, of which
there are at most common.SHARES for each join, comes to the driver. Hot values, heads and labels are split over tasks.

Null and empty texts and texts without words have no shingles and are linked with nothing; a text of fewer than five
words is one shingle. Rows with a null id are returned with a null component and kept = false, and link nothing. Rows
with one id and several texts are several nodes; equal rows are one, and all of them are returned. Extra columns are not
read by components(), whatever their names. keep_first() keeps them, and of each component exactly one row: among rows
of the smallest id the text with the smallest hash, among equal texts any one; rows with a null id are all kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import MANY, column, cut, joined, positional, scope, slabs, stored

WORDS, PERCENT = 5, 75
#: Values a sketch retains; sets up to WHOLE are retained in full; values that the sketches of a link share at least.
KEEP, WHOLE, NEED = 32, 48, 9
#: Shingles in a block of a large neighbourhood, and the shingles as which a smaller set counts, so that a block has about
#: ROOM / LEAST_WEIGHT members at most; small neighbourhoods share tasks of about this size.
ROOM, LEAST_WEIGHT = 1 << 20, 1 << 10
#: Ids up to which the list of documents to read again is broadcast (8 bytes each).
BROADCAST_IDS = 500_000
#: Bytes hashed at once.
BLOCK = 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_CODE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_FACTORS = _mixed(np.arange(1001, 1001 + WORDS, dtype=np.uint64)) | np.uint64(1)
#: Bytes for which powers are kept.
POWERS = 2 * BLOCK
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, POWERS)
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _BACK))  # type: ignore[assignment]
    return _powers


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of raw, which ends with a blank: a polynomial of the bytes, freed of the position."""
    a = _LOW[np.frombuffer(raw, np.uint8)]
    blank = _BLANK[a]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    up, down = _grown(len(a))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[a] * up[: len(a)])])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (int64, not negative) of each text."""
    hashes, owner = [], []
    k = 0
    while k < len(texts):
        group, size, first = [], 0, k
        while k < len(texts) and (not group or size + len(texts[k]) < BLOCK):
            group.append(texts[k])
            size += len(texts[k]) + 1
            k += 1
        raw = b" ".join(group) + b" "
        if len(raw) <= 2 * BLOCK or len(group) > 1:
            h, at = _word_hashes(raw)
            starts = np.cumsum([0] + [len(t) + 1 for t in group[:-1]])
            hashes.append(h)
            owner.append(np.searchsorted(starts, at, "right") - 1 + first)
        else:  # one very long text, in blocks that end at blanks
            at = 0
            while at < len(raw):
                stop = min(at + BLOCK, len(raw))
                while stop < len(raw) and raw[stop - 1] not in b" \t\n\x0b\x0c\r":
                    stop += 1
                h, _ = _word_hashes(raw[at:stop])
                hashes.append(h)
                owner.append(np.full(len(h), first))
                at = stop
    w = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    doc = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    n = max(0, len(w) - WORDS + 1)
    s = np.zeros(n, np.uint64)
    for j in range(WORDS):
        s += w[j : n + j] * _FACTORS[j]
    s = (_mixed(s) >> np.uint64(1)).astype(np.int64)
    good = doc[:n] == doc[WORDS - 1 :] if n else np.zeros(0, bool)
    s, owners = s[good], doc[:n][good]
    ends = np.searchsorted(owners, np.arange(len(texts)), "right")
    begins = np.concatenate([[0], ends[:-1]])
    words_to = np.searchsorted(doc, np.arange(len(texts)), "right")
    words_from = np.concatenate([[0], words_to[:-1]])
    out = []
    for i in range(len(texts)):
        if ends[i] > begins[i]:
            x = np.sort(s[begins[i] : ends[i]])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif words_to[i] > words_from[i]:
            own = w[words_from[i] : words_to[i]]
            total = np.array([len(own)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for j in range(len(own)):
                total += own[j : j + 1] * _FACTORS[j]
            out.append((_mixed(total) >> np.uint64(1)).astype(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _set_key(x: np.ndarray) -> bytes | None:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None


def _hashed(docs: DataFrame, full: bool) -> DataFrame:
    """doc_id, mark, n, key, and the sketch or the full set, of docs (doc_id, text, mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slabs(batches):
            sets = shingle_sets([x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()])
            kept = sets if full else [_sketch(x) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array([len(x) for x in sets], pa.int64()), pa.array([_set_key(x) for x in sets], pa.binary()), _lists(kept)], ["doc_id", "mark", "n", "key", "values"])

    return docs.mapInArrow(run, "doc_id long, mark long, n long, key binary, values array<long>")


def _sketch(x: np.ndarray) -> np.ndarray:
    return x if len(x) <= WHOLE else x[:KEEP]


def _similar(a: str, b: str) -> Column:
    """Whether sizes allow a link."""
    return F.least(F.col(a), F.col(b)) * 100 >= F.greatest(F.col(a), F.col(b)) * PERCENT


def _estimate() -> Column:
    """Similarity estimated on the union sketch of (n_a, s_a) and (n_b, s_b); exact if both sets are retained in full."""
    whole = (F.col("n_a") <= WHOLE) & (F.col("n_b") <= WHOLE)
    both = F.array_intersect("s_a", "s_b")
    union = F.array_sort(F.array_union("s_a", "s_b"))
    # A value of the union's KEEP smallest that is in both sets is in both sketches.
    lowest = F.element_at(union, F.least(F.lit(KEEP), F.size(union)))
    return F.when(whole, F.size(both) / F.size(union)).otherwise(F.size(F.filter(both, lambda v: v <= lowest)) / F.least(F.lit(KEEP), F.size(union)))


def _possible() -> Column:
    whole = (F.col("n_a") <= WHOLE) & (F.col("n_b") <= WHOLE)
    return F.when(whole, _estimate() * 100 >= PERCENT - 1e-9).otherwise(_estimate() >= NEED / KEEP)


def minimum_labels(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that edges (a, b) reach from each id that occurs in them."""
    with scope() as needed:
        both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
        labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
        degrees = cut(both.groupBy("b").count()) if both.count() > MANY else None
        before = None
        while True:
            total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
            if total == before or total is None:
                needed.append(labels)
                return labels
            before = total
            near = joined(both, labels.withColumnRenamed("id", "b"), "b", "a", counts=degrees).groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "id")
            jump = joined(labels, labels.select(F.col("id").alias("label"), F.col("label").alias("next")), "label", "id")
            labels = cut(jump.join(near, "id").select("id", F.least("m", "next").alias("label")))


def _full_sets(cids: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(cid, n, s): the full sets of the classes, from their first documents, which are read again."""
    wanted = stored(cids.select("cid").distinct().join(classes.select("cid", "rep", "key"), "cid"), "wanted")
    few = wanted.select(F.col("rep").alias("doc_id")).distinct()
    small = wanted.count() <= BROADCAST_IDS
    again = _hashed(texts.join(F.broadcast(few) if small else few, "doc_id", "left_semi"), full=True).withColumnRenamed("doc_id", "rep")
    return stored(wanted.join(again, ["rep", "key"]).select("cid", "n", F.col("values").alias("s")).dropDuplicates(["cid"]), "sets")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of class ids whose full sets are similar enough."""
    with scope() as needed:
        pairs = stored(pairs, "pairs")
        sets = _full_sets(pairs.select(F.col("a").alias("cid")).unionAll(pairs.select(F.col("b").alias("cid"))), classes, texts)
        side = lambda x: sets.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("s").alias(f"s_{x}"))
        common = F.size(F.array_intersect("s_a", "s_b"))
        met = joined(pairs, side("a"), "a", "b").join(side("b"), "b")
        links = cut(met.withColumn("i", common).where(F.col("i") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("i")) * PERCENT).select("a", "b"))
        needed.append(links)
    return links


def _needed(n: np.ndarray) -> np.ndarray:
    """Values that the sketch of a set of n shingles shares with that of any set it is linked with."""
    # All partners of a set of up to three quarters of WHOLE are retained in full, so its overlap is exact.
    return np.where(n * 100 <= WHOLE * PERCENT, -(-n * PERCENT // 100), NEED)


def partners(labels: np.ndarray, n: np.ndarray, sketches: list[np.ndarray], blocks: np.ndarray | None = None) -> np.ndarray:
    """Matrix of the pairs of different labels (and blocks) that sizes and sketches allow a link."""
    m = len(sketches)
    owner = np.repeat(np.arange(m), [len(x) for x in sketches])
    _, where, df = np.unique(np.concatenate(sketches) if m else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    owner, where = owner[df[where] > 1], where[df[where] > 1]
    owner = owner[np.argsort(where, kind="stable")]
    ends = np.cumsum(df[df > 1])
    shared = np.zeros((m, m), np.int16)
    for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        g = owner[a:b]
        shared[g[:, None], g] += 1
    need = _needed(n)
    close = shared >= np.maximum(need[:, None], need[None, :])
    close &= (np.minimum(n[:, None], n) * 100 >= np.maximum(n[:, None], n) * PERCENT) & (labels[:, None] != labels)
    return close if blocks is None else close & (blocks[:, None] != blocks)


def joining_links(cids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join different components (labels), until no pair of different components is left; blocks: only pairs of two."""
    n = np.array([len(x) for x in sets])
    labels, out = labels.copy(), []
    for i, j in np.argwhere(np.triu(partners(labels, n, [_sketch(x) for x in sets], blocks), 1)).tolist():
        if labels[i] == labels[j]:
            continue
        x, y = (sets[i], sets[j]) if n[i] <= n[j] else (sets[j], sets[i])
        at = np.searchsorted(y, x)
        common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        if common * 100 >= (n[i] + n[j] - common) * PERCENT:
            out.append((int(cids[i]), int(cids[j])))
            labels[labels == labels[j]] = labels[i]
    return out


def _dealt(members: DataFrame) -> DataFrame:
    """members (cid, label, around, weight) with task, i, j, mine.

    Neighbourhoods (around) of a weight of up to ROOM share tasks of about that; a larger one is dealt into blocks
    (mine), and each pair of blocks (i, j) is a task.
    """
    sizes = members.groupBy("around").agg(F.sum("weight").alias("size"))
    placed = stored(joined(members, sizes, "around", "cid"), "around")
    tasks = max(1, (placed.where(F.col("size") <= ROOM).agg(F.sum("weight")).first()[0] or 0) // ROOM)
    deal = F.ceil(F.col("size") / ROOM).cast("int")
    big = placed.where(F.col("size") > ROOM).withColumn("mine", F.pmod(F.xxhash64("cid"), deal).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), deal - 1))).select("cid", "label", "around", F.col("around").alias("task"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine")
    little = placed.where(F.col("size") <= ROOM).select("cid", "label", "around", F.pmod(F.xxhash64("around"), F.lit(tasks)).cast("long").alias("task"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(-1).alias("mine"))
    return big.unionAll(little)


def _compared(members: DataFrame, sets: DataFrame, schema: str, found) -> DataFrame:
    """What found(cids, labels, sets, blocks) lists in each neighbourhood of members, of the columns of schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def compare(t: pa.Table) -> pa.Table:
        cids, labels, around, mine = (t[c].to_numpy() for c in ("cid", "label", "around", "mine"))
        two = t["i"][0].as_py() != t["j"][0].as_py()
        each = [np.asarray(x) for x in t["s"].to_numpy()]
        n = t["n"].to_numpy()
        out: list[tuple[int, ...]] = []
        order = np.argsort(around, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(around[order])) + 1):
            if (labels[part] != labels[part[0]]).any():
                out += found(cids[part], labels[part], [each[k] for k in part], mine[part] if two else None, n[part])
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names, zip(*out, strict=True) if out else [[]] * len(names), strict=True)})

    return stored(_dealt(members).join(sets, "cid").groupBy("task", "i", "j").applyInArrow(compare, schema), "compared")


def _round2(open_lists: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links that join the components of the lists (v, cid, label)."""
    met = lambda cids, labels, sets, blocks, n: [(int(c),) for c in cids[partners(labels, n, sets, blocks).any(axis=1)]]
    joins = lambda cids, labels, sets, blocks, n: joining_links(cids, labels, sets, blocks)
    with scope() as needed:
        heads = stored(open_lists.groupBy("v").agg(F.min("cid").alias("b"), F.count("*").alias("count")), "heads2")
        spokes = joined(open_lists, heads.select("v", "b"), "v", "cid", counts=heads).select(F.col("cid").alias("a"), "b").where("a <> b").distinct()
        around = minimum_labels(spokes).select(F.col("id").alias("cid"), F.col("label").alias("around"))
        members = stored(open_lists.select("cid", "label").distinct().join(around, "cid"), "members")
        alive = _compared(members.withColumn("weight", F.lit(LEAST_WEIGHT).cast("long")), classes.select("cid", "n", "s"), "cid long", met).distinct()
        rest = stored(members.join(alive, "cid").join(classes.select("cid", "n"), "cid").withColumn("weight", F.greatest(F.col("n"), F.lit(LEAST_WEIGHT))).drop("n"), "rest")
        links = _compared(rest, _full_sets(rest, classes, texts), "a long, b long", joins)
        needed.append(links)
    return links


def _listed(classes: DataFrame) -> DataFrame:
    """(cid, n, v): the inverted lists, of the rarest retained values of each class, without those that only it has."""
    each = classes.select("cid", F.explode("s").alias("v"))
    need = F.when(F.col("n") * 100 <= WHOLE * PERCENT, F.ceil(F.col("n") * PERCENT / 100)).otherwise(NEED)
    with scope() as needed:
        common = stored(each.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "values")
        shared = joined(each, common, "v", "cid", counts=common.withColumnRenamed("df", "count")).groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("order"))
        # Of size values, size - need + 1 must be listed; those that no other class has needn't.
        spare = (F.size("order") - need + 1).cast("int")
        ranked = shared.join(classes.select("cid", "n"), "cid").withColumn("spare", spare).where("spare > 0")
        lists = stored(ranked.select("cid", "n", F.explode(F.slice("order", F.lit(1), F.col("spare"))).alias("x")).select("cid", "n", F.col("x.v").alias("v")), "lists")
        needed.append(lists)
    return lists


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark, n, label, component of every row of docs; mark is a hash of the text, label null for a set that links with nothing."""
    at = positional(docs)
    texts = at.select(F.col(column(docs, id_col)).cast("long").alias("doc_id"), F.col(column(docs, text_col)).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    rows = stored(_hashed(texts, full=False), "sketches")
    first = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "n", "values")).alias("x"))
    classes = stored(first.select("key", F.col("x.doc_id").alias("rep"), F.col("x.n").alias("n"), F.col("x.values").alias("s")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    sketch = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("s").alias(f"s_{x}"))

    lists = _listed(classes)

    # Round 1: each class and the first class of each of its lists; the most similar one is verified.
    heads = stored(lists.groupBy("v").agg(F.min(F.struct("cid", "n")).alias("h"), F.count("*").alias("count")).where("count > 1").select("v", F.col("h.cid").alias("a"), F.col("h.n").alias("n_h"), "count"), "heads")
    near = joined(lists, heads.drop("count"), "v", "cid", counts=heads).where((F.col("cid") != F.col("a")) & _similar("n", "n_h")).select("a", F.col("cid").alias("b")).distinct()
    near = joined(stored(near, "near"), sketch("a"), "a", "b").join(sketch("b"), "b").where(_possible()).select("b", F.struct(_estimate().alias("e"), (-F.col("a")).alias("m")).alias("x")).groupBy("b").agg(F.max("x").alias("x")).select((-F.col("x.m")).alias("a"), "b")
    links = _verified(near, classes, texts)
    labels = minimum_labels(links)

    # Round 2: lists with several components.
    placed = stored(lists.select("cid", "v").join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid")), "placed")
    mixed = stored(placed.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("count")).where("lo < hi"), "mixed")
    open_lists = stored(joined(placed, mixed.select("v"), "v", "cid", counts=mixed).select("v", "cid", "label"), "open")
    labels = minimum_labels(links.unionAll(_round2(open_lists, classes, texts)))

    whole = stored(classes.select("cid", "key", "rep").join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid")), "labelled")
    lowest = whole.groupBy("label").agg(F.min("rep").alias("component"))
    by_key = stored(joined(whole, lowest, "label", "cid").select("key", "component", "label"), "components")
    out = joined(rows.select("doc_id", "mark", "n", "key"), by_key, "key", "doc_id", "left")
    return out.select("doc_id", "mark", "n", "label", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    with scope() as needed:
        out = _grouped(docs, id_col, text_col)
        needed.append(out)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


def _found(docs: DataFrame, table: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """The rows of docs, as positional columns, (not) listed in table (id, mark), which is broadcast if it is small."""
    small = table.count() <= BROADCAST_IDS
    at = positional(docs)
    same = (F.col(id_col).cast("long") == F.col("id")) & F.xxhash64(F.col(text_col).cast("string")).eqNullSafe(F.col("mark"))
    return at.join(F.broadcast(table) if small else table, same, how)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, and all rows with a null id, with docs' columns."""
    names, i, x = docs.columns, column(docs, id_col), column(docs, text_col)
    with scope() as needed:
        every = stored(_grouped(docs, id_col, text_col).where("doc_id IS NOT NULL"), "grouped")
        # Texts of a smallest id that are linked with each other: the one with the smallest hash stays.
        tops = every.where("doc_id = component").groupBy(F.col("doc_id").alias("id"), "label", "mark").agg(F.count("*").alias("rows"))
        firsts = stored(tops.withColumn("lost", F.col("label").isNotNull() & (F.col("mark") > F.min("mark").over(Window.partitionBy("id", "label")))), "tops")
        lost = stored(every.where("doc_id <> component").select(F.col("doc_id").alias("id"), "mark").distinct().unionAll(firsts.where("lost").select("id", "mark")), "lost")
        again = stored(firsts.where("NOT lost AND rows > 1").select("id", "mark"), "again")
        needed += [lost, again]
    kept = _found(docs, lost, i, x, "left_anti")
    if not again.count():
        return kept.toDF(*names)
    # Repeated rows: any one of them, by an aggregate that combines them before the shuffle.
    once = _found(kept, again, i, x, "left_semi")
    values = [c for c in once.columns if c not in (i, x)]
    one = once.groupBy(i, x).agg(*[F.first(c).alias(c) for c in values]).select(*once.columns)
    return _found(kept, again, i, x, "left_anti").unionAll(one).toDF(*names)
