"""Work on sorted and long arrays inside a row, in time that grows with them, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of running sums.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column, op: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """op (of integers, with 0 as its start) over the numbers up to each one, block by block: time grows in proportion, up to BLOCK ** 3 numbers."""

    def over(xs: Column) -> Column:
        if not levels:
            return F.transform(xs, lambda _, i: F.aggregate(F.slice(xs, F.lit(1), i + 1), F.lit(0), op))
        n = F.ceil(F.size(xs) / BLOCK).cast("int")
        totals = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.aggregate(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), op))).otherwise(F.array().cast("array<int>"))
        at = lambda i: F.floor(i / BLOCK).cast("int")
        return let(running(totals, op, levels - 1), lambda before: F.transform(xs, lambda _, i: op(F.coalesce(F.get(before, at(i) - 1), F.lit(0)), F.aggregate(F.slice(xs, at(i) * BLOCK + 1, i % BLOCK + 1), F.lit(0), op))))

    return let(numbers, over)


def rank(points: Column, value: Column, inclusive: bool) -> Column:
    """How many of the sorted points are less than (inclusive: or equal to) value, by binary search."""
    rounds = F.ceil(F.log2(F.size(points) + F.lit(1.0))).cast("int") + 1

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        x = F.get(points, middle)
        low = (x <= value) if inclusive else (x < value)
        return F.when(acc["lo"] >= acc["hi"], acc).when(low, F.struct((middle + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), middle.alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), rounds), F.struct(F.lit(0).alias("lo"), F.size(points).alias("hi")), step, lambda acc: acc["lo"])
