"""Exact quantiles of groups of any size, by narrowing the ranges that hold the wanted ranks.

A quantile is between two ranks of its group. A pass over the values estimates, by mergeable sketches, a short range
around each wanted rank, and another counts what is below it, in it and at its ends, which is exact: the rank is then
at an end, inside, or, where the sketch erred, in the part before or behind. Either way the range loses values, in most
cases all but a four-hundredth of them. Ranges of ``FEW`` values are looked up by rank, and those of one value are
done. So a group of 10**12 values takes four rounds, and no task holds a group's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Values of a range that are looked up by rank.
FEW = 1 << 14
#: The sketch errs by a rank of one in so many.
ACCURACY = 10_000
GRID = 1024
#: Wanted ranks, 60 bytes each, that may be broadcast.
BROADCAST_RANKS = 1 << 16


def _held(values: DataFrame, ranges: DataFrame, group: list[str], small: bool) -> DataFrame:
    """Values with each range (group, rank, low, high) that they are in."""
    ranges = F.broadcast(ranges) if small else ranges
    met = values.join(ranges, group)
    return met.where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))


def selected(values: DataFrame, ranks: DataFrame, group: list[str], few: int = FEW, accuracy: int = ACCURACY) -> DataFrame:
    """group, rank (from 0) and the value of that rank; ``values`` has v, ``ranks`` has rank, low, high, n of the group."""
    key = [*group, "rank"]
    state = written(ranges := ranks.select(*key, "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    small = ranges.count() <= BROADCAST_RANKS
    grid = [k / GRID for k in range(GRID + 1)]
    while True:
        wide = state.where((F.col("inside") > few) & (F.col("low") < F.col("high")))
        if wide.isEmpty():
            break
        marks = _held(values, wide, group, small).groupBy(*key).agg(F.percentile_approx("v", grid, accuracy).alias("marks"))
        share, slack = (F.col("rank") - F.col("below")) / F.col("inside"), 3.0 / accuracy
        at = lambda x: F.element_at("marks", F.least(F.greatest(x, F.lit(0)), F.lit(GRID)).cast("int") + 1)
        span = written(wide.join(marks, key).select(*wide.columns, at(F.floor((share - slack) * GRID)).alias("from"), at(F.ceil((share + slack) * GRID)).alias("to")))
        v, start, end = F.col("v"), F.col("from"), F.col("to")
        only = lambda f, c: f(F.when(c, v))
        counts = {"under": F.count_if(v < start), "at_from": F.count_if(v == start), "between": F.count_if((v > start) & (v < end)), "at_to": F.count_if((v == end) & (end > start))}
        nearest = {"last_under": only(F.max, v < start), "first_in": only(F.min, (v > start) & (v < end)), "last_in": only(F.max, (v > start) & (v < end)), "first_over": only(F.min, v > end)}
        counted = span.join(_held(values, span, group, small).groupBy(*key).agg(*(c.alias(n) for n, c in {**counts, **nearest}.items())), key)
        # the parts of a range in order, each with its ends and how many values it has
        parts = [("low", "last_under", "under"), ("from", "from", "at_from"), ("first_in", "last_in", "between"), ("to", "to", "at_to")]
        below, took = F.col("below"), F.lit(None).cast("struct<low:double,high:double,below:bigint,inside:bigint>")
        for low, high, n in parts:
            here = F.struct(F.col(low).alias("low"), F.col(high).alias("high"), below.alias("below"), F.col(n).alias("inside"))
            took = F.coalesce(took, F.when(F.col("rank") < below + F.col(n), here))
            below = below + F.col(n)
        over = F.struct(F.col("first_over").alias("low"), F.col("high").alias("high"), below.alias("below"), (F.col("inside") - (below - F.col("below"))).alias("inside"))
        new = counted.select(*key, F.coalesce(took, over).alias("t")).select(*key, "t.*")
        state = written(state.join(wide.select(*key), key, "left_anti").unionByName(new))
    seen = _held(values, state.where("low < high").select(*key, "low", "high"), group, small).groupBy(*key, "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*key).orderBy("v"))
    found = seen.withColumn("upto", upto).join(state.select(*key, "below"), key)
    found = found.where((F.col("rank") < F.col("below") + F.col("upto")) & (F.col("rank") >= F.col("below") + F.col("upto") - F.col("n"))).select(*key, F.col("v").alias("value"))
    return found.unionByName(state.where("low >= high").select(*key, F.col("low").alias("value")))


def linear_quantiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float], few: int = FEW, accuracy: int = ACCURACY) -> DataFrame:
    """group and a column for each of ``shares``: the value at share * (n - 1), interpolated between ranks; null values don't count."""
    # one key, so that groups with nulls meet too
    name = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}) if group else F.lit("")
    values = rows.select(*group, name.alias("_key"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    ends = values.groupBy("_key").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"), *(F.first(g).alias(g) for g in group))
    ends = written(ends)
    back, values = ends.select("_key", *group), values.select("_key", "v")
    own, group = group, ["_key"]
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(float(s)).alias("share")) for k, s in shares.items()))).alias("s")
    wanted = ends.select(*group, "low", "high", "n", named).select(*group, "low", "high", "n", "s.name", (F.col("s.share") * (F.col("n") - 1)).alias("at"))
    wanted = wanted.withColumns({"rank": F.floor("at"), "next": F.ceil("at")})
    ranks = wanted.select(*group, F.explode(F.array("rank", "next")).alias("rank"), "low", "high", "n").distinct()
    found = written(selected(values, ranks, group, few, accuracy))
    a = found.select(*group, "rank", F.col("value").alias("_a"))
    b = found.select(*group, F.col("rank").alias("next"), F.col("value").alias("_b"))
    met = wanted.join(a, [*group, "rank"]).join(b, [*group, "next"])
    quantile = F.when(F.col("rank") == F.col("next"), F.col("_a")).otherwise(F.col("_a") * (F.col("next") - F.col("at")) + F.col("_b") * (F.col("at") - F.col("rank")))
    out = met.groupBy("_key").agg(*(F.max(F.when(F.col("name") == k, quantile)).alias(k) for k in shares))
    return back.join(out, "_key").select(*own, *shares)
