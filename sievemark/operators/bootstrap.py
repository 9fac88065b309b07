"""Bootstraps: resamples of sources shared by all cells, intervals, contrasts, differences in differences, clusters.

Draw k of replicate r is a hash of (seed, r, k), so any engine and any run draws alike. Replicates are spread over the
cluster: a task draws its own, counts how often each source is drawn, and has the AUROC of every cell from running sums
of these weights along the cell's sorted scores. So nothing of the size replicates x sources is moved or is a row. The sorted
scores go to every task while they are few (``PLACES``); beyond that a replicate's weights meet the scores in a shuffle,
as weighted histograms of at most one row for each source and side, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.md5 import Draws
from ..functions.text import hash_draw
from ..session import cut
from .locks import placed


#: Scores of all cells, or rows of a resampled table, 16 bytes each, that may go to every task.
PLACES = 1 << 22
#: Draws of the replicates whose results are sent together.
BLOCK = 1 << 22


def draws(spark: SparkSession, replicates: int, n: int, seed: int) -> DataFrame:
    """rep, draw, place: ``n`` places from 0 below n for each replicate."""
    rows = spark.range(replicates * n).select(F.floor(F.col("id") / F.lit(max(n, 1))).alias("rep"), (F.col("id") % F.lit(max(n, 1))).cast("int").alias("draw"))
    return rows.withColumn("place", hash_draw(n, F.lit(seed), "rep", "draw"))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """The distinct values of ``key`` with places from 0 in ascending order; no task sorts all of them."""
    return placed(df.select(key).distinct(), [key])


def samples(scores: DataFrame, replicates: int, seed: int, cell: str = "cell", source: str = "source") -> DataFrame:
    """rep, cell, auroc of every replicate; one draw of sources serves all cells."""
    spark = scores.sparkSession
    scores = cut(scores.select(cell, source, "human", "generated"))
    places = numbered(scores, source)
    rows = cut(scores.join(places, source).select(F.col(cell).cast("string").alias("cell"), F.col("place").cast("int").alias("place"), "human", "generated"))
    n = places.count()
    if rows.count() > PLACES:
        return _shuffled_samples(rows, draws(spark, replicates, n, seed), cell)
    held = rows.toArrow()
    coded = held.column("cell").combine_chunks().dictionary_encode()
    index, place, human, made = coded.indices.to_numpy(zero_copy_only=False), *(held.column(c).to_numpy() for c in ("place", "human", "generated"))
    cells = []
    for k, name in enumerate(coded.dictionary.to_pylist()):
        own = np.flatnonzero(index == k)
        # both sides in the order of their scores: places of either, and where the generated ones fall among the human ones
        h, g = own[np.argsort(human[own], kind="stable")], own[np.argsort(made[own], kind="stable")]
        among = (np.searchsorted(human[h], made[g], side).astype(np.int32) for side in ("left", "right"))
        cells.append((name, place[h].astype(np.int32), place[g].astype(np.int32), *among))
    block = max(1, BLOCK // max(n, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = Draws(n)
        for batch in batches:
            reps = batch.column("rep").to_pylist()
            for at in range(0, len(reps), block):
                out = []
                for rep in reps[at : at + block]:
                    weights = np.bincount(drawn.of(seed, rep), minlength=n).astype(np.int32)
                    for name, h, g, low, high in cells:
                        below = np.zeros(len(h) + 1, np.int64)
                        np.cumsum(weights[h], out=below[1:])
                        total = int(below[-1])
                        if total:
                            out.append((rep, name, float(np.dot(weights[g], below[low] + below[high])) / (2 * total * total)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.int64(), pa.string(), pa.float64()), strict=True)], names=["rep", "cell", "auroc"])

    out = replicated(spark, replicates if n else 0, n).mapInArrow(run, "rep long, cell string, auroc double")
    return out.select("rep", F.col("cell").cast(scores.schema[cell].dataType).alias(cell), "auroc")


def replicated(spark: SparkSession, replicates: int, n: int) -> DataFrame:
    """rep: numbers of replicates of ``n`` draws each, a few seconds' work in a partition."""
    parts = min(replicates, max(spark.sparkContext.defaultParallelism, replicates * n >> 24))
    return spark.range(0, replicates, 1, max(parts, 1)).select(F.col("id").alias("rep"))


def _shuffled_samples(rows: DataFrame, drawn: DataFrame, cell: str) -> DataFrame:
    """The same for more scores than a task holds: weights and scores meet in a shuffle."""
    weights = drawn.groupBy("rep", "place").agg(F.count(F.lit(1)).alias("w"))
    met = weights.join(rows, "place")
    sides = F.explode(F.array(F.struct(F.col("human").alias("score"), F.col("w").alias("h"), F.lit(0).cast("long").alias("g")), F.struct(F.col("generated").alias("score"), F.lit(0).cast("long").alias("h"), F.col("w").alias("g"))))
    hist = met.select("rep", "cell", sides.alias("s")).groupBy("rep", "cell", "s.score").agg(F.sum("s.h").alias("h"), F.sum("s.g").alias("g"))
    below = F.coalesce(F.sum("h").over(Window.partitionBy("rep", "cell").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = hist.withColumn("twice", F.col("g") * (2 * below + F.col("h")))
    return won.groupBy("rep", F.col("cell").alias(cell)).agg((F.sum("twice") / (2 * F.sum("h") * F.sum("g"))).alias("auroc"))


def interval(value: str | Column, low: float = 0.025, high: float = 0.975) -> tuple[Column, Column]:
    """Aggregates: percentiles by linear interpolation."""
    return F.percentile(value, low), F.percentile(value, high)


def cell_intervals(sampled: DataFrame, cell: str = "cell") -> DataFrame:
    low, high = interval("auroc")
    return sampled.groupBy(cell).agg(low.alias("ci_low"), high.alias("ci_high"))


def contrasts(sampled: DataFrame, estimates: DataFrame, pairs: dict[str, tuple[str, str]], cell: str = "cell") -> DataFrame:
    """One row per contrast a - b: estimate and interval from the shared samples."""
    spark = sampled.sparkSession
    named = F.broadcast(spark.createDataFrame([(k, a, b) for k, (a, b) in pairs.items()], "contrast string, a string, b string"))
    low, high = interval("d")

    def gap(df: DataFrame, on: list[str]) -> DataFrame:
        left = df.select(*on, F.col(cell).alias("a"), F.col("auroc").alias("x"))
        right = df.select(*on, F.col(cell).alias("b"), F.col("auroc").alias("y"))
        met = left.join(named, "a")
        return met.join(right, [*on, "b"]).select(*on, "contrast", (F.col("x") - F.col("y")).alias("d"))

    spread = gap(sampled, ["rep"]).groupBy("contrast").agg(low.alias("ci_low"), high.alias("ci_high"))
    return gap(estimates, []).select("contrast", F.col("d").alias("estimate")).join(spread, "contrast")


def decision(estimate: Column, low: Column, high: Column, ceilings: list[Column]) -> Column:
    """Labels of a dissociation; ``ceilings`` come in pairs, in order, and both of a pair withhold."""
    pairs = [ceilings[i] & ceilings[i + 1] for i in range(0, len(ceilings) - 1, 2)]
    both, some = F.lit(False), F.lit(False)
    for p in pairs:
        both = both | p
    for c in ceilings:
        some = some | c
    # fixed values: labels of the panel
    label = F.when(both, "WITHHELD_CEILING").when(some, "CEILING_CENSORED").when(low > 0, "DISSOCIATION_RW_MORE_DETECTABLE")
    return label.when(high < 0, "DISSOCIATION_RW_LESS_DETECTABLE").otherwise("NO_DISSOCIATION")


def boot_p(value: str | Column, replicates: int) -> Column:
    """An aggregate: two-sided p from the share of replicates on the rarer side of zero, 2 / B at least."""
    value = F.col(value) if isinstance(value, str) else value
    share = F.least(F.avg(F.when(value <= 0, 1.0).otherwise(0.0)), F.avg(F.when(value >= 0, 1.0).otherwise(0.0)))
    return F.least(F.lit(1.0), 2 * F.greatest(share, F.lit(1.0 / replicates)))


def cluster_resample(df: DataFrame, cluster: str, replicates: int, seed: int) -> DataFrame:
    """rep, draw and the rows of every drawn cluster; ``draw`` tells repeated clusters of a replicate apart."""
    places = numbered(df, cluster)
    n = places.count()
    return draws(df.sparkSession, replicates, n, seed).join(df.join(places, cluster), "place").drop("place")
