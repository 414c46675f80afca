"""Cutting lineage so that the loss of an executor costs nothing: tables in the folder the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of tables that this process has written and not deleted yet.
_written: list[str] = []
#: Where a local session without a checkpoint folder writes.
LOCAL_DIR = "/tmp/checkpoints/folio"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; only a local session may name none."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = LOCAL_DIR
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again; what a session leaves is deleted when its JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    at, fs = _path(spark, path)
    fs.deleteOnExit(at.getParent())
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a table of any kind; survives the loss of any executor."""
    return stored(df, "cut")


def _delete(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return bool(fs.delete(at, True))


def _folders(df: DataFrame) -> set[str]:
    """Last parts of the paths that df reads, from its plan; files aren't listed."""
    out = set()
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            out |= {paths.apply(j).getName() for j in range(paths.size())}
    return out


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Deletes, at its end, the tables that were written inside, but for those behind the DataFrames added to the list."""
    before, keep = set(_written), []
    yield keep
    if keep:
        needed = set().union(*map(_folders, keep))
        for path in [p for p in _written if p not in before and p.rsplit("/", 1)[-1] not in needed]:
            _delete(keep[0].sparkSession, path)
            _written.remove(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables that stored() has written in this process, once all results over them are written; their number."""
    n = 0
    while _written:
        n += _delete(spark, _written.pop())
    return n


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as the cluster has cores, if it has fewer; for costly work on each row of small files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
