"""Operators on small typed-in inputs, and on long texts."""

import duckdb
import examples
import pytest
from pyspark.sql import functions as F
from test_catalogue import rows

from folio.functions import text as T
from folio.functions.arrays import rank, running


@pytest.mark.parametrize("name", sorted(examples.QUERIES))
def test_example(spark, name):
    want = duckdb.sql(examples.SQL[name]).df()
    got = examples.QUERIES[name](spark, None).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_running_sums_and_ranks(spark):
    numbers = [(k * 7919) % 101 for k in range(70_000)]
    for xs in ([], [5], numbers[:64], numbers[:65], numbers[:5000], numbers):
        row = spark.createDataFrame([(xs,)], "x array<int>").select(running(F.col("x"), lambda a, b: a + b).alias("s"), running(F.col("x"), lambda a, b: F.greatest(a, b)).alias("m")).first()
        total = high = 0
        for x, s, m in zip(xs, row.s, row.m, strict=True):
            total, high = total + x, max(high, x)
            assert (s, m) == (total, high)
    points = sorted(numbers[:500])
    got = spark.createDataFrame([(points, q) for q in range(-1, 103)], "p array<int>, q int").select("q", rank(F.col("p"), F.col("q"), False).alias("a"), rank(F.col("p"), F.col("q"), True).alias("b")).collect()
    assert all(r.a == sum(p < r.q for p in points) and r.b == sum(p <= r.q for p in points) for r in got)
    assert spark.createDataFrame([([],)], "p array<int>").select(rank(F.col("p"), F.lit(3), True).alias("r")).first().r == 0


def test_word_positions(spark):
    texts = ["", "one two", "  The lamp, the LAMP!", "x1  y2\nz3 " * 3000, "été déjà vu"]
    for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("n", T.normalize_index(F.col("t"))).select("n", T.word_positions(F.col("n")).alias("w")).collect():
        assert all(r.n[x.pos : x.pos + len(x.raw)] == x.raw for x in r.w)
        assert len(r.w) == len([w for w in __import__("re").findall("[a-z0-9]+", r.n) if w not in T.STOP_WORDS])
