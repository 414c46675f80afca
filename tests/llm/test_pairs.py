"""Operators 4, 5 and 9 against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import ann_tree, near_dup, pivot_dup

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, n_shingles string, key string, values string, rep int"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def closed(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_components(docs):
    sets = {i: shingles(t) for i, t in docs}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    where = {x: ids for x, ids in where.items() if len(ids) > 1}
    pairs = {(a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, closed(sets, links)


def test_near_duplicates_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets, want = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = near_dup.components(docs).collect()
    assert len(got) == len(sets) and sum(a != b for a, b in want.items()) > 20
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_of_hard_cases(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = ["", None, " \n ", "one", "ONE", "one two", "a b c d e", "A  b\tc d e", "x" * 3000, "İ K one two three four"]
    passage = [word() for _ in range(60)]
    for size in (6, 9, 14, 30, 45, 52, 60, 200):
        base = [word() for _ in range(size)]
        for _ in range(12):
            other = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                other[rng.randrange(size)] = word()
            texts.append(" ".join(other))
        chain = list(base)
        for k in range(12):  # each near the one before, ends far apart
            chain[(k * 5) % size] = word()
            texts.append(" ".join(chain))
    for _ in range(60):  # a passage that many share
        texts.append(" ".join([word() for _ in range(rng.randint(5, 90))] + passage + [word() for _ in range(rng.randint(5, 90))]))
    base = [word() for _ in range(120)]
    for k in range(120):  # one large group of near copies
        texts.append(" ".join(base[:k] + [word()] + base[k + 1 :]))
    sets, want = brute_components(list(enumerate(texts)))
    df = spark.createDataFrame([(i, t, "x", "k", "v", 1) for i, t in enumerate(texts)] + [(None, "one", "", "", "", 0), (3, "one", "", "", "", 0)], SCHEMA)
    got = near_dup.components(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept and r.n_shingles == 1
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), texts[r.doc_id]
    kept = near_dup.keep_first(df)
    assert kept.columns == df.columns
    # Of the two equal rows of id 3 one stays.
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i in want if want[i] == i)
    assert kept.where("doc_id is null").count() == 1
    assert near_dup.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("small, large, pairs", [(300, 400, 300), (750, 1000, 200), (3000, 4000, 60)])
def test_round_2_links_texts_that_contain_each_other(small, large, pairs):
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(pairs):
        whole = np.unique(rng.integers(0, 1 << 62, large))
        sets += [whole, np.sort(rng.choice(whole, small, replace=False))]
    cids = np.arange(len(sets))
    want = {(2 * k, 2 * k + 1) for k in range(pairs)}
    assert set(near_dup.joining_links(cids, cids, sets)) == want
    assert set(near_dup.joining_links(cids, cids, sets, cids % 2)) == want
    below = [x if i % 2 == 0 else x[:-1] for i, x in enumerate(sets)]  # one value too few
    assert near_dup.joining_links(cids, cids, below) == []


def nested_texts(rng, sizes):
    """Texts of sizes words, each the beginning of the first."""
    whole = [f"w{rng.getrandbits(40)}" for _ in range(max(sizes))]
    return [" ".join(whole[:n]) for n in sizes]


def test_groups_of_nested_and_overlapping_texts(spark, monkeypatch):
    rng, texts = random.Random(9), []
    for n in [200, 300, 400, 700, 1000] * 14 + [2500, 5000]:
        texts += nested_texts(rng, [n + 4, n * 3 // 4 + 4, n * 72 // 100 + 4])  # the third is near the second only
        texts += nested_texts(rng, [n + 4, n * 3 // 4 + 3])  # one shingle too few
        base = [f"w{rng.getrandbits(40)}" for _ in range(n)]
        texts += [" ".join(base), " ".join(base[n // 8 :] + [f"w{rng.getrandbits(40)}" for _ in range(n // 40)])]  # partly nested
    rng.shuffle(texts)
    sets, want = brute_components(list(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for room, least in ((near_dup.ROOM, 10_000), (4_000, 20)):  # also in many small blocks, with split keys
        monkeypatch.setattr(near_dup, "ROOM", room)
        monkeypatch.setattr(near_dup, "LEAST_WEIGHT", min(room // 8, near_dup.LEAST_WEIGHT))
        monkeypatch.setattr(near_dup, "MANY", least)
        monkeypatch.setattr("folio.llm.common.MANY", least)
        monkeypatch.setattr("folio.llm.common.LEAST_HOT", min(least, 500))
        got = {r.doc_id: r.component_id for r in near_dup.components(df).collect()}
        assert got == want
    assert sum(a != b for a, b in want.items()) > 150


def test_hot_lists_and_copies(spark, monkeypatch):
    """A third of the rows are copies, as many near copies of one text, and many share a passage; hot keys are split."""
    monkeypatch.setattr(near_dup, "MANY", 30)
    monkeypatch.setattr("folio.llm.common.MANY", 30)
    monkeypatch.setattr("folio.llm.common.LEAST_HOT", 30)
    monkeypatch.setattr(near_dup, "ROOM", 20_000)
    rng = random.Random(11)
    word = lambda: f"w{rng.getrandbits(30)}"
    base, passage = [word() for _ in range(90)], [word() for _ in range(40)]
    texts = ["the very same text of a group"] * 120 + [""] * 60 + [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(90)] + [" ".join([word() for _ in range(6)] + passage) for _ in range(100)]
    texts += [" ".join(base[:60] + [word() for _ in range(30)]) for _ in range(40)]
    sets, want = brute_components(list(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.components(df).collect()} == want


def test_one_row_of_each_group_whatever_the_columns(spark):
    names = ["__lost", "doc_id", "ID", "mark", "text", "TEXT", "c0", "label", "__key"]
    rows = [(7, 1, 0, "m", "a b c d e f g h i j", "other", 3, "l", 1), (7, 1, 0, "m", "unlike the first text of this id", "other", 3, "l", 1), (8, 2, 0, "m", "A b c d e f g h i j", "other", 3, "l", 1)]
    rows += [(9, 3, k, "m", "said twice", "other", 3, "l", 1) for k in (1, 2)] + [(9, 3, 0, "m", None, "other", 3, "l", 1), (9, 3, 0, "m", "", "o", 3, "l", 1), (1, None, 0, "m", "said twice", "o", 3, "l", 1)]
    rows += [(1, 4, 0, "m", "k l m n o p q r s t u v w x", "o", 3, "l", 1), (1, 4, 0, "m", "K l m n o p q r s t u v w x", "o", 3, "l", 1)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d string, e string, f string, g long, h string, i long").toDF(*names)
    kept = near_dup.keep_first(df)
    assert kept.columns == names
    got = [tuple(r) for r in kept.collect()]
    assert sorted((str(r[1]), r[4] and r[4].lower()) for r in got if r[4] is not None) == sorted([("1", "a b c d e f g h i j"), ("1", "unlike the first text of this id"), ("3", "said twice"), ("3", ""), ("None", "said twice"), ("4", "k l m n o p q r s t u v w x")])
    assert all(r[0] in (7, 9, 1) and r[3] == "m" and r[7] == "l" for r in got) and sum(r[4] is None for r in got) == 1
    assert near_dup.components(df).count() == len(rows)


def test_blocks_of_very_long_texts(monkeypatch):
    text = ("alpha beta gamma delta " * 40 + "w" * 300 + " end of text").encode()
    want = near_dup.shingle_sets([text, b"", b"a b"])
    monkeypatch.setattr(near_dup, "BLOCK", 64)
    got = near_dup.shingle_sets([text, b"", b"a b"])
    assert all((a == b).all() for a, b in zip(want, got, strict=True))
    assert len(want[0]) == len(shingles(text.decode()))


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 64


def vectors(spark, extra=()):
    at = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, "x", 1) for r in at.collect()]
    rows += [(10_000 + k, v, "x", 1) for k, v in enumerate(extra)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, e int"), rows


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(1)
    hot = rng.normal(size=64)
    near = [(hot + rng.normal(scale=0.08, size=64)).tolist() for _ in range(150)]
    same = [rng.normal(size=64).tolist()] * 30
    return [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [1.0, 2.0], [float("inf")] + [1.0] * 63, *near, *same, *[(2 * np.array(x)).tolist() for x in same[:3]]]


def test_linked_vectors(spark, odd):
    df, rows = vectors(spark, odd)
    ids = np.array([r[0] for r in rows if usable(r[1])])
    x = np.array([r[1] for r in rows if usable(r[1])], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    want = closed(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(np.triu(close)), strict=True)])
    links = dict(zip(ids.tolist(), close.sum(1).tolist(), strict=True))
    got = {r.vec_id: r for r in pivot_dup.linked(df).collect()}
    assert len(got) == len(rows)
    found = sum(min(r.n_links, links.get(i, 0)) for i, r in got.items())
    print("links found", found, "of", sum(links.values()))
    assert all(r.n_links <= links.get(i, 0) for i, r in got.items()) and found >= 0.98 * sum(links.values())
    assert sum(r.component_id == want.get(i, i) for i, r in got.items()) >= 0.995 * len(rows)
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_vectors_of_extreme_size(spark):
    big, tiny = 1e200, 1e-310
    rows = [(1, [big, big]), (2, [big, 1.0001 * big]), (3, [1.0, 1.0]), (4, [tiny, tiny]), (5, [5e-324, 0.0]), (6, [1e308, 0.0]), (7, [-1e308, 1e308]), (8, [0.0, -0.0])]
    df = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, E int, id int, x int").toDF("vec_id", "embedding", "EMBEDDING", "id", "lists")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivot_dup.linked(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8)}


def test_links_in_many_blocks(spark, odd, monkeypatch):
    """Long lists, hot keys and small tasks give the same result as short ones."""
    df, _ = vectors(spark, odd)
    want = sorted(map(tuple, pivot_dup.linked(df).collect()), key=str)
    for name, value in (("BLOCK", 16), ("TASK", 32)):
        monkeypatch.setattr(pivot_dup, name, value)
    monkeypatch.setattr("folio.llm.common.MANY", 20)
    monkeypatch.setattr("folio.llm.common.LEAST_HOT", 20)
    assert sorted(map(tuple, pivot_dup.linked(df).collect()), key=str) == want


@pytest.mark.parametrize("split", [False, True])
def test_neighbours(spark, odd, split, monkeypatch):
    if split:  # a small tree whose leaves are split on the executors
        for name, value in (("SAMPLE_BYTES", 200 * 64 * 8), ("LEAF_ROWS", 60), ("SPLIT_SAMPLE", 100), ("LEAF_SAMPLE", 12)):
            monkeypatch.setattr(ann_tree, name, value)
    df, rows = vectors(spark, odd)
    good = [r for r in rows if usable(r[1])]
    ids, x = np.array([r[0] for r in good]), np.array([r[1] for r in good], np.float32).astype(float)
    got = {}
    for r in ann_tree.neighbours(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == sorted(int(i) for i in ids if i % 20 == 0)
    hits = total = 0
    for q, found in got.items():
        found.sort()
        s = (x * x[ids == q][0]).sum(axis=1)
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21))
        for _, v, score in found:
            assert abs(score - s[ids == v][0]) < 1e-9
        hits += len({v for _, v, _ in found} & set(ids[order].tolist()))
        total += 20
    print("recall", hits / total)
    assert hits / total >= 0.95


def test_leaves_are_split_and_hold_all_rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3_000, 8))
    tree = ann_tree.fit(x[:200])
    placed = tree.assign(x)
    parts = {int(i): ann_tree.fit(x[placed == i]) for i in np.unique(placed)[::2]}
    larger = ann_tree.grafted(tree, parts)
    assert larger.leaves == tree.leaves + sum(p.leaves - 1 for p in parts.values())
    now = larger.assign(x)
    for i in np.unique(placed):  # a leaf's rows lie below it, as its own tree places them
        mine = now[placed == i]
        assert len(np.unique(mine)) == (parts[i].leaves if i in parts else 1)
        if i in parts:
            assert (parts[i].assign(x[placed == i]) == mine - mine.min()).all()
    assert sorted(larger.visits(x[0])) == list(range(larger.leaves))


def test_neighbours_of_extreme_and_clashing_rows(spark):
    big = 1e200
    rows = [(0, [big, 0.0]), (1, [big, big]), (2, [1.0, -1.0]), (3, [-big, big]), (4, [5e-324, 0.0]), (20, [1e-3, 1e9]), (20, [1e-3, 1e8]), (5, [1e9, 1e-9]), (6, [1e9, 2e-9])]
    df = spark.createDataFrame([(i, v, 1, 1, 1) for i, v in rows], "a long, b array<double>, c int, d int, e int").toDF("vec_id", "embedding", "id", "E", "leaf")
    got = {}
    for r in ann_tree.neighbours(df, F.col("vec_id") % 20 == 0, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = {0: [big, 0.0], 20: [1e-3, 1e8]}
    for q, v in asked.items():
        scores = sorted((-(v[0] * x[0] + v[1] * x[1]), i) for i, x in rows if i != q)
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores[:3])]


def test_few_vectors(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (40, [-1.0, 5.0]), (3, None)], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann_tree.neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 40, -1.0), (40, 1, 1, -1.0), (40, 2, 2, -1.0), (40, 3, 20, -1.0)]
    assert {(r.vec_id, r.n_links, r.component_id) for r in pivot_dup.linked(df).collect()} == {(20, 2, 1), (1, 2, 1), (2, 2, 1), (40, 0, 40), (3, 0, 3)}
    assert ann_tree.neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0 and pivot_dup.linked(df.limit(0)).count() == 0
