"""Ranks, running totals and demeaning by group.

Ranks of ties are averaged; they come doubled, as integers, so that comparisons are exact. Running totals over a
group of any size go through buckets: quantile bounds of the ordering column cut a group into ranges, totals run
inside a range, and the ranges' sums, a few rows a group, run over the group. So no group is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a large group is cut into.
RANGES = 64


def running_total(df: DataFrame, group: list[str], value: str, totals: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """``totals`` summed over the rows of ``group`` with a smaller ``value``; ``value`` is unique in a group."""
    marks = F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 1000)
    bounds = df.groupBy(*group).agg(marks.alias("_marks")) if group else df.agg(marks.alias("_marks"))
    df = df.join(bounds, group) if group else df.crossJoin(F.broadcast(bounds))
    df = df.withColumn("_range", F.size(F.filter("_marks", lambda m: m < F.col(value)))).drop("_marks")
    inside = Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in totals.items()])
    sums = sums.select(*group, "_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in totals])
    for n, c in totals.items():
        df = df.withColumn(n, F.coalesce(F.sum(c).over(inside), F.lit(0)))
    df = df.join(sums, [*group, "_range"])
    return df.select(*[c for c in df.columns if not c.startswith("_")], *[(F.col(n) + F.col(f"_before_{n}")).alias(f"_{n}") for n in totals]).drop(*totals).withColumnsRenamed({f"_{n}": n for n in totals})


def twice_midrank(value: str, group: list[str]) -> Column:
    """Twice the average rank in a group that one task can sort (a block, a cell of few rows)."""
    return 2 * F.rank().over(Window.partitionBy(*group).orderBy(value)) + F.count(F.lit(1)).over(Window.partitionBy(*group, value)) - 1


def midranks(df: DataFrame, group: list[str], value: str, name: str = "twice_rank") -> DataFrame:
    """Twice the average rank of every row, for groups of any size: rows meet a table of distinct values."""
    seen = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    seen = seen.withColumnRenamed("_n", "ties")
    ranked = running_total(seen, group, value, {"below": F.col("ties")})
    ranked = ranked.select(*group, value, (2 * F.col("below") + F.col("ties") + 1).alias(name))
    return df.join(ranked, [*group, value])


def demean(value: str, group: list[str]) -> Column:
    return F.col(value) - F.avg(value).over(Window.partitionBy(*group))


def two_way_demean(df: DataFrame, value: str, first: str, second: str, rounds: int = 50, name: str = "demeaned") -> DataFrame:
    """Group means taken off alternately; group means are aggregates with map-side combine, joined back.

    Only the means of the groups change over the rounds, so the plan holds the rows once: with ``rounds`` rounds the
    value less the last mean of either group, each computed from the other's.
    """
    from ..session import cut, plain_constraints

    with plain_constraints(df.sparkSession):
        cells = cut(df.groupBy(first, second).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n")))
        a = cells.groupBy(first).agg((F.sum("_sum") / F.sum("_n")).alias("_a"))
        b = None
        for k in range(rounds):
            b = cells.join(a, first).groupBy(second).agg((F.sum(F.col("_sum") - F.col("_n") * F.col("_a")) / F.sum("_n")).alias("_b"))
            if k + 1 < rounds:
                b = cut(b) if k % 5 == 4 else b
                a = cells.join(b, second).groupBy(first).agg((F.sum(F.col("_sum") - F.col("_n") * F.col("_b")) / F.sum("_n")).alias("_a"))
                a = cut(a) if k % 5 == 4 else a
        return df.join(a, first).join(b, second).withColumn(name, F.col(value) - F.col("_a") - F.col("_b")).drop("_a", "_b")


def without_singletons(df: DataFrame, group: str) -> DataFrame:
    """Rows whose group has two or more rows."""
    several = df.groupBy(group).count().where("count >= 2").select(group)
    return df.join(several, group, "left_semi")


def factor_codes(df: DataFrame, value: str, name: str = "code") -> DataFrame:
    """Codes from 0 of the distinct values in ascending order."""
    from .locks import placed

    numbers = placed(df.select(value).where(F.col(value).isNotNull()).distinct(), [value], name).withColumn(name, F.col(name).cast("int"))
    return df.join(F.broadcast(numbers) if numbers.count() <= 100_000 else numbers, value)
