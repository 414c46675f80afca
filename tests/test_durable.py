"""Tables in the shared folder."""

from folio.plans import durable


def test_stored_and_cleared(spark):
    at = durable.stored(spark.range(5), "five")
    assert at.count() == 5 and at.dtypes == spark.range(5).dtypes
    assert durable.clear(spark) >= 1 and durable.clear(spark) == 0


def test_cut(spark):
    assert sorted(r.id for r in durable.cut(spark.range(3)).collect()) == [0, 1, 2]


def test_scope_keeps_what_results_need(spark):
    from pyspark.sql import functions as F

    durable.clear(spark)
    with durable.scope() as needed:
        a, b = durable.stored(spark.range(3), "a"), durable.stored(spark.range(4), "b")
        with durable.scope() as inner:
            c, d = durable.stored(spark.range(5), "c"), durable.stored(spark.range(6), "d")
            inner.append(c)
        out = a.withColumn("x", F.lit(1)).join(c, "id").unionByName(spark.range(1).withColumn("x", F.lit(0)))
        needed.append(out)
    assert out.count() == 4 and len(durable._written) == 2
    for gone in (b, d):
        try:
            gone.count()
            raise AssertionError("still there")
        except Exception as e:
            assert "still there" not in str(e)
    assert durable.clear(spark) == 2


def test_a_cluster_needs_a_shared_folder():
    import pytest

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable.shared_dir(Session())
