"""Spearman's correlation with its exact permutation test, and what unknown orders of ceiling cells do to it.

A suite is a handful of cells (x, y); there can be any number of suites. Statistics compare integers: with doubled
ranks, the sum of rank products orders permutations as the correlation does, so no tolerance is needed. Permutations
are numbers decoded to arrangements, spread over tasks by ``spark.range``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import direction, dot_long, permutation, twice_ranks


def rho_of(rx: Column, ry: Column) -> Column:
    """Pearson's correlation of two arrays of doubled ranks; null when a side is constant."""
    n = F.size(rx)
    mean = (n + 1).cast("double")  # doubled ranks have this mean
    spread = lambda r: dot_long(r, r) - n * mean * mean
    return F.try_divide(dot_long(rx, ry) - n * mean * mean, F.sqrt(spread(rx)) * F.sqrt(spread(ry)))


def suites(df: DataFrame, suite: str, x: str, y: str) -> DataFrame:
    """One row per suite: doubled ranks of x and y, by x."""
    rows = df.groupBy(suite).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("_c"))
    xs, ys = F.transform("_c", lambda c: c["x"]), F.transform("_c", lambda c: c["y"])
    return rows.select(suite, xs.alias("xs"), ys.alias("ys"), twice_ranks(xs).alias("rx"), twice_ranks(ys).alias("ry"))


def permutation_counts(ranked: DataFrame, suite: list[str], n: int) -> DataFrame:
    """Over all n! arrangements of ry: how many give no more, and no less, than the observed sum.

    The arrangements, at most 8!, go to all tasks; suites stay where they are.
    """
    if n > 8:
        raise ValueError("exact tests take up to eight cells")
    spark = ranked.sparkSession
    every = spark.range(math.factorial(n)).select(permutation(F.col("id"), n).alias("p"))
    met = ranked.where(F.size("rx") == n).crossJoin(F.broadcast(every))
    moved = dot_long(F.col("rx"), F.transform("p", lambda i: F.element_at("ry", i + 1)))
    seen = dot_long(F.col("rx"), F.col("ry"))
    return met.select(*suite, moved.alias("_moved"), seen.alias("_seen")).groupBy(*suite).agg(F.count_if(F.col("_moved") <= F.col("_seen")).alias("less"), F.count_if(F.col("_moved") >= F.col("_seen")).alias("greater"), F.count(F.lit(1)).alias("total"))


def exact_test(df: DataFrame, suite: str, x: str, y: str, n: int, alternative: str = "less") -> DataFrame:
    """suite, rho, direction, count, total, p of suites with ``n`` cells."""
    ranked = suites(df, suite, x, y)
    counts = permutation_counts(ranked.select(suite, "rx", "ry"), [suite], n)
    out = ranked.select(suite, rho_of(F.col("rx"), F.col("ry")).alias("rho")).join(counts, suite)
    return out.select(suite, "rho", direction(F.col("rho")).alias("direction"), F.col(alternative).alias("count"), "total", (F.col(alternative) / F.col("total")).alias("p"))


def ceiling_audit(df: DataFrame, suite: str, x: str, y: str, ceiling: str, n: int, alternative: str = "less", alpha: float = 0.05) -> DataFrame:
    """One row per suite: how rho, p, direction and decision range over the hidden orders of ceiling cells.

    With two or more ceiling cells their values are taken as the largest finite one plus each possible rank order.
    WITHHELD if direction or decision varies, else ROBUST; NO_AMBIGUOUS with fewer ceiling cells.
    """
    cells = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(ceiling).alias("top"))))
    rows = df.groupBy(suite).agg(cells.alias("_c"))
    tops = F.size(F.filter("_c", lambda v: v["top"]))
    base = F.coalesce(F.array_max(F.transform(F.filter("_c", lambda v: ~v["top"]), lambda v: v["y"])), F.lit(0.0))
    rows = rows.withColumn("tops", tops).withColumn("base", base)
    orders = F.when(F.col("tops") >= 2, F.factorial("tops")).otherwise(F.lit(1).cast("long"))
    rows = rows.withColumn("order", F.explode(F.sequence(F.lit(0).cast("long"), orders - 1)))
    rows = rows.withColumn("hidden", permutation(F.col("order"), F.col("tops")))
    place = F.transform("_c", lambda v, i: F.size(F.filter(F.slice("_c", F.lit(1), i), lambda w: w["top"])))
    rows = rows.withColumn("place", place)
    ys = F.transform("_c", lambda v, i: F.when(v["top"] & (F.col("tops") >= 2), F.col("base") + 1 + F.element_at("hidden", F.element_at("place", i + 1) + 1)).otherwise(v["y"]))
    ranked = rows.select(suite, "order", "tops", twice_ranks(F.transform("_c", lambda v: v["x"])).alias("rx"), twice_ranks(ys).alias("ry"))
    counts = permutation_counts(ranked.select(suite, "order", "rx", "ry"), [suite, "order"], n)
    each = ranked.join(counts, [suite, "order"]).withColumn("rho", rho_of(F.col("rx"), F.col("ry"))).withColumn("p", F.col(alternative) / F.col("total"))
    each = each.withColumn("direction", direction(F.col("rho"))).withColumn("supported", F.col("p") < alpha)
    out = each.groupBy(suite).agg(
        F.max("tops").alias("ceilings"),
        F.count(F.lit(1)).alias("orders"),
        F.min("rho").alias("rho_low"),
        F.max("rho").alias("rho_high"),
        F.min("p").alias("p_low"),
        F.max("p").alias("p_high"),
        F.array_join(F.array_sort(F.collect_set("direction")), ",").alias("directions"),
        F.array_join(F.array_sort(F.collect_set(F.col("supported").cast("string"))), ",").alias("decisions"),
    )
    varies = F.col("directions").contains(",") | F.col("decisions").contains(",")
    return out.withColumn("audit", F.when(F.col("ceilings") < 2, "NO_AMBIGUOUS").when(varies, "WITHHELD").otherwise("ROBUST"))


def verdict(audit: Column, supported: Column, directed: Column, prefix: str = "DIRECTIONAL") -> Column:
    """Withheld first, then support in the stated direction, else none."""
    return F.when(audit == "WITHHELD", "WITHHELD_CEILING").when(supported & directed, f"{prefix}_SUPPORTED").otherwise(f"{prefix}_NOT_SUPPORTED")
