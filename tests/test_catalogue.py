"""Every registered query with SQL against DuckDB on the same tables; the others run and give a stable schema."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and np.isnan(x):
            return ""
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if hasattr(x, "year"):
            return str(pd.Timestamp(x))
        if isinstance(x, (float, np.floating)):
            return repr(float(x)) if x != int(x) else str(int(x))
        return str(x)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF)
    if name not in entry.oracle_sql():
        assert got.count() >= 0 and len(set(got.columns)) == len(got.columns)
        return
    want = con.execute(entry.oracle_sql()[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert {"query_id", "rank", "url", "score"} <= set(df.columns) and df.count() > 0
