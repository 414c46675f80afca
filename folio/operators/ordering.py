"""Positions in an order: ranks, neighbours, pages, runs and budgets.

Orders over a whole table don't use a window over one partition: rows are range-partitioned and sorted, numbered within
their partition, and shifted by the number of rows in the partitions before. Orders within groups use windows over the
groups as long as no group has more than HOT rows; else the table is range-partitioned by group and order, windows stay
within a partition, and groups that reach over several partitions carry their totals from one to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.plans.durable import stored

#: Rows of a group up to which a window holds the whole group.
HOT = 1_000_000


class _Runs:
    """Running values within groups, in an order, over groups of any size; bounded: no group can be large, so they aren't counted."""

    def __init__(self, df: DataFrame, group: str, order: tuple[Column | str, ...], bounded: bool = False):
        self.group, self.order, self.names, self.added = group, order, df.columns, []
        self.hot = not bounded and (df.groupBy(group).count().agg(F.max("count")).first()[0] or 0) > HOT
        self.df = df
        if self.hot:
            parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
            self.df = stored(df.repartitionByRange(parts, group, *order).withColumn("__p", F.spark_partition_id()), "ranges")

    @property
    def window(self):
        return Window.partitionBy(self.group, "__p") if self.hot else Window.partitionBy(self.group)

    def add(self, name: str, value: Column, fold, whole, merge) -> None:
        """Adds name: the running value of a column up to each row.

        fold: its aggregate; whole: the same over the parts of a group that come before; merge: of both.
        """
        local = fold(value).over(self.window.orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0))
        self.df = self._carried(self.df.withColumn("__v", value), name, local, fold(F.col("__v")), whole, merge).drop("__v")

    def _carried(self, df: DataFrame, name: str, local: Column, total: Column, whole, merge) -> DataFrame:
        self.added.append(name)
        if not self.hot:
            return df.withColumn(name, local)
        # A row for each part of a group; only groups of several parts carry: two for each partition at most.
        parts = stored(df.groupBy(self.group, "__p").agg(total.alias("__t")), "parts")
        several = parts.groupBy(self.group).agg(F.count("*").alias("__n")).where("__n > 1").select(self.group)
        before = Window.partitionBy(self.group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        carry = parts.join(several, self.group).withColumn("__c", whole(F.col("__t")).over(before)).select(self.group, "__p", "__c")
        out = df.withColumn(name, local).join(F.broadcast(carry), [self.group, "__p"], "left")
        return out.withColumn(name, merge(F.col("__c"), F.col(name))).drop("__c")

    def totals(self, name: str) -> None:
        """Adds name: the rows of the group."""
        self.added.append(name)
        if not self.hot:
            self.df = self.df.withColumn(name, F.count("*").over(self.window))
            return
        counts = stored(self.df.groupBy(self.group).count(), "counts")
        # Small groups are counted where they are; groups of several partitions from a table of two rows a partition at most.
        parts = self.df.select(self.group, "__p").distinct().groupBy(self.group).agg(F.count("*").alias("__n")).where("__n > 1").select(self.group)
        several = counts.join(parts, self.group).withColumnRenamed("count", "__c")
        self.df = self.df.withColumn(name, F.count("*").over(self.window)).join(F.broadcast(several), self.group, "left").withColumn(name, F.coalesce("__c", name)).drop("__c")

    def done(self) -> DataFrame:
        return self.df.select(*self.names, *self.added)


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + b


def numbered(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with name: the place of each row, from 1, in the order; a total order gives one result."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    at = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    at = stored(at, "numbered")
    sizes = at.groupBy("__p").count()  # one row for each partition
    before = sizes.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    return at.join(F.broadcast(before), "__p").withColumn(name, F.col("__before") + F.col("__i") + 1).drop("__p", "__i", "__before")


def neighbours(ranked: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """ranked with previous and next, the key of the rows one place before and behind; null at the ends."""
    side = lambda step, name: ranked.select((F.col(rank) + step).alias(rank), F.col(key).alias(name))
    return ranked.join(side(1, "previous"), rank, "left").join(side(-1, "next"), rank, "left")


def neighbours_within(df: DataFrame, group: str, key: str, *order: Column | str) -> DataFrame:
    """As neighbours(), within each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def paged(ranked: DataFrame, size: int, total: int, rank: str = "rank") -> DataFrame:
    """ranked with page and pages; a size below 1 counts as 10."""
    size = size if size > 0 else 10
    return ranked.withColumn("page", (F.floor((F.col(rank) - 1) / size) + 1).cast("long")).withColumn("pages", F.lit(-(-total // size)).cast("long"))


def paged_within(df: DataFrame, group: str, size: int, *order: Column | str) -> DataFrame:
    size = size if size > 0 else 10
    runs = _Runs(df, group, order)
    runs.add("page", F.lit(1), F.sum, F.sum, _plus)
    runs.totals("pages")
    return runs.done().withColumn("page", (F.floor((F.col("page") - 1) / size) + 1).cast("long")).withColumn("pages", F.ceil(F.col("pages") / size).cast("long"))


def filled_down(df: DataFrame, group: str, value: str, *order: Column | str) -> DataFrame:
    """Blank values become the last one before them that isn't."""
    runs = _Runs(df.withColumn("__k", F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])), group, order)
    given = F.nullif(F.trim(value), F.lit(""))
    runs.add("__last", F.when(given.isNotNull(), F.struct(F.col("__k").alias("k"), given.alias("v"))), F.max, F.max, lambda before, mine: F.coalesce(mine, before))
    return runs.done().withColumn(value, F.col("__last.v")).drop("__k", "__last")


def running_least(df: DataFrame, group: str, value: str, name: str, *order: Column | str) -> DataFrame:
    """df with name: the least value of the rows of the group up to each one."""
    runs = _Runs(df, group, order)
    runs.add(name, F.col(value), F.min, F.min, lambda before, mine: F.least(before, mine))
    return runs.done()


def merged_intervals(df: DataFrame, group: str, start: str, end: str, bounded: bool = False) -> DataFrame:
    """(group, start, end, n): overlapping and touching intervals of a group as one."""
    runs = _Runs(df.select(group, start, end).withColumn("__i", F.monotonically_increasing_id()), group, (start, end, "__i"), bounded)
    order = runs.window.orderBy(start, end, "__i")
    local = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs.df = runs._carried(runs.df, "__high", local, F.max(end), F.max, lambda before, mine: F.greatest(before, mine))
    runs.add("__island", F.when(F.col(start) <= F.col("__high"), 0).otherwise(1), F.sum, F.sum, _plus)
    return runs.done().groupBy(group, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")


def within_budget(df: DataFrame, group: str, size: str, budget: int, *order: Column | str, bounded: bool = False) -> DataFrame:
    """The first rows of each group until one would exceed the budget; the first row always stays."""
    runs = _Runs(df, group, order, bounded)
    runs.add("__used", F.col(size).cast("long"), F.sum, F.sum, _plus)
    runs.add("__n", F.lit(1), F.sum, F.sum, _plus)
    runs.add("__cut", F.when((F.col("__used") > budget) & (F.col("__n") > 1), 1).otherwise(0), F.max, F.max, lambda before, mine: F.greatest(before, mine))
    return runs.done().where("__cut = 0").drop("__used", "__n", "__cut")


def first_of(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the order; all columns are kept and no group is collected."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def best_with_fallback(df: DataFrame, group: str, score: str, least: float, limit: int, *ties: Column | str) -> DataFrame:
    """Rows of each group with at least the score, up to limit; if there is none, the best row."""
    w = Window.partitionBy(group).orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= limit) & ((F.col(score) >= least) | (F.col("rank") == 1)))
