"""Matrix-permutation (QAP) tests of a pair matrix against another.

Matrices are rows (i, j, predictor, target) over a few items. The statistic is Spearman's correlation over chosen
pairs, under relabellings of the predictor's items. Ranks are computed once, as whole numbers, and only looked up
under a relabelling: sums of their products then order the relabellings without rounding. The rank
matrix is one small row that goes to all tasks; permutations are numbers spread over tasks. A triangle of a predictor
that isn't symmetric is refused, as its ranks would change under relabelling.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import cosine, twice_ranks
from ..functions.text import hash_draw
from ..session import cut
from .spearman import rho_of


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of every label, component by component."""
    parts = vectors.select(label, F.posexplode(vector).alias("dim", "v"))
    means = parts.groupBy(label, "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("mean"))


def pair_matrix(means: DataFrame, label: str = "label") -> DataFrame:
    """i, j, cosine of all ordered pairs of different labels; labels are few."""
    left = means.select(F.col(label).alias("i"), F.col("mean").alias("a"))
    right = F.broadcast(means.select(F.col(label).alias("j"), F.col("mean").alias("b")))
    return left.join(right, F.col("i") != F.col("j")).select("i", "j", cosine(F.col("a"), F.col("b")).alias("value"))


def symmetrise(matrix: DataFrame, value: str = "value") -> DataFrame:
    """(T + transposed T) / 2."""
    turned = matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col(value).alias("_other"))
    return matrix.join(turned, ["i", "j"]).withColumn(value, (F.col(value) + F.col("_other")) / 2).drop("_other")


def norm_corrected(matrix: DataFrame, norms: DataFrame, value: str = "value", mean: bool = False) -> DataFrame:
    """Values times the norm of j, or of the mean norm of i and j; ``norms`` has (label, norm)."""
    right = matrix.join(F.broadcast(norms.select(F.col("label").alias("j"), F.col("norm").alias("_j"))), "j")
    left = right.join(F.broadcast(norms.select(F.col("label").alias("i"), F.col("norm").alias("_i"))), "i")
    factor = (F.col("_i") + F.col("_j")) / 2 if mean else F.col("_j")
    return left.withColumn(value, F.col(value) * factor).drop("_i", "_j")


def _rank_row(matrix: DataFrame, n: int, which: str) -> DataFrame:
    """One row: the n x n matrix of the predictor's doubled ranks over chosen pairs, and chosen pairs with the target's."""
    if which != "ordered":
        turned = matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("predictor").alias("_other"))
        apart = F.abs(F.col("predictor") - F.col("_other")) > 1e-8 + 1e-5 * F.abs(F.col("_other"))
        if not matrix.join(turned, ["i", "j"]).where(apart).isEmpty():
            raise ValueError(f"pairs of the {which} triangle need a symmetric predictor")
    cell = F.struct("i", "j", "predictor", "target")
    chosen = {"upper": F.col("i") < F.col("j"), "lower": F.col("i") > F.col("j"), "ordered": F.col("i") != F.col("j")}[which]
    # a symmetric predictor has one rank for both orders of a pair
    rows = matrix.where(chosen).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    rows = rows.select("c", twice_ranks(F.transform("c", lambda x: x["predictor"])).alias("rp"), twice_ranks(F.transform("c", lambda x: x["target"])).alias("rt"))
    spot = lambda i, j: F.array_position(F.transform("c", lambda x: x["i"] * n + x["j"]), i * n + j)
    flip = which != "ordered"
    every = F.sequence(F.lit(0), F.lit(n * n - 1))

    def rank(k: Column) -> Column:
        i, j = F.floor(k / n), k % n
        at = spot(i, j)
        at = F.when((at == 0) & F.lit(flip), spot(j, i)).otherwise(at)
        return F.when(at == 0, 0).otherwise(F.element_at("rp", F.greatest(at, F.lit(1)).cast("int")))

    pairs = F.transform("c", lambda x, k: F.struct(x["i"].alias("i"), x["j"].alias("j"), F.element_at("rt", k + 1).alias("r")))
    return rows.select(F.transform(every, rank).alias("ranks"), pairs.alias("pairs"), "rp", "rt")


def _fixed() -> list[Column]:
    """Observed sum, centre, scale (a sum less the centre, over the scale, is its rho) and rho."""
    seen = F.aggregate(F.zip_with("rp", "rt", lambda a, b: a.cast("long") * b), F.lit(0).cast("long"), lambda s, x: s + x)
    n_pairs = F.size("rp")
    spread = lambda r: F.aggregate(F.transform(r, lambda x: (x.cast("double") - n_pairs - 1) * (x.cast("double") - n_pairs - 1)), F.lit(0.0), lambda s, x: s + x)
    return [F.sqrt(spread("rp") * spread("rt")).alias("scale"), seen.alias("o"), (n_pairs * (n_pairs + 1) * (n_pairs + 1)).cast("long").alias("centre"), rho_of(F.col("rp"), F.col("rt")).alias("rho")]


def _sums(permutations: DataFrame, row: DataFrame, n: int) -> DataFrame:
    met = permutations.crossJoin(F.broadcast(row))
    moved = F.aggregate(
        "pairs",
        F.lit(0).cast("long"),
        lambda s, x: s + F.element_at("ranks", (F.element_at("p", x["i"].cast("int") + 1) * n + F.element_at("p", x["j"].cast("int") + 1) + 1).cast("int")).cast("long") * x["r"],
    )
    return met.select(moved.alias("s"), *_fixed())


def _decoded(number: np.ndarray, n: int) -> np.ndarray:
    """Relabellings, one a column, from the factorial digits of their numbers."""
    p = np.stack([number // math.factorial(n - 1 - k) % (n - k) for k in range(n)]) if n else np.zeros((0, len(number)), dtype=np.int64)
    for k in range(n - 2, -1, -1):
        p[k + 1 :] += p[k + 1 :] >= p[k]
    return p


def _every_sum(row: DataFrame, n: int) -> DataFrame:
    """``_sums`` over all n! relabellings, decoded by batches."""
    spark = row.sparkSession
    small = row.first()
    ranks = np.array(small["ranks"] or [0], dtype=np.int64)
    pairs = [(int(x["i"]), int(x["j"]), int(x["r"])) for x in small["pairs"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _decoded(batch.column(0).to_numpy(), n)
            s = np.zeros(p.shape[1], dtype=np.int64)
            for i, j, r in pairs:
                s += ranks[p[i] * n + p[j]] * r
            yield pa.RecordBatch.from_arrays([pa.array(s)], names=["s"])

    sums = spark.range(math.factorial(n)).mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("times"))
    return sums.crossJoin(F.broadcast(row.select(*_fixed())))


def qap_exact(matrix: DataFrame, n: int, which: str = "upper") -> DataFrame:
    """rho, relabellings with no smaller and with no smaller absolute statistic, all n! of them, both p, and the null's moments and quantiles."""
    return _summary(_every_sum(_rank_row(matrix, n, which), n), 0)


def delete_one(matrix: DataFrame, n: int, which: str = "upper") -> DataFrame:
    """``qap_exact`` of each of the n matrices of n - 1 items, by ``dropped`` item, from one enumeration.

    A relabelling of the others is a relabelling of all that keeps the dropped item, so each of the n! serves those
    matrices whose item it keeps: one on average, (n - 1)! for each. Ranks are of the smaller matrix's own pairs.
    """
    if n < 2:
        raise ValueError("two items at least")
    fixed, ranks, pairs = [], {}, {}
    for d in range(n):
        code = lambda c, d=d: F.col(c) - (F.col(c) > d).cast("int")
        own = matrix.where((F.col("i") != d) & (F.col("j") != d)).withColumns({"i": code("i"), "j": code("j")})
        row = cut(_rank_row(own, n - 1, which))
        small = row.first()
        ranks[d] = np.array(small["ranks"] or [0], dtype=np.int64)
        pairs[d] = [(int(x["i"]), int(x["j"]), int(x["r"])) for x in small["pairs"]]
        fixed.append(row.select(F.lit(d).alias("dropped"), *_fixed()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _decoded(batch.column(0).to_numpy(), n)
            dropped, sums = [], []
            for d in range(n):
                own = p[:, p[d] == d]
                own = np.delete(own, d, axis=0)
                own -= own > d
                s = np.zeros(own.shape[1], dtype=np.int64)
                for i, j, r in pairs[d]:
                    s += ranks[d][own[i] * (n - 1) + own[j]] * r
                dropped.append(np.full(len(s), d, dtype=np.int32))
                sums.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(dropped)), pa.array(np.concatenate(sums))], names=["dropped", "s"])

    sums = matrix.sparkSession.range(math.factorial(n)).mapInArrow(run, "dropped int, s long")
    counted = sums.groupBy("dropped", "s").agg(F.count(F.lit(1)).alias("times"))
    return _summary(counted.join(F.broadcast(reduce(DataFrame.unionByName, fixed)), "dropped"), 0, ["dropped"])


def random_permutations(spark: SparkSession, n: int, draws: int, seed: int) -> DataFrame:
    """Permutations by sorting hashes, the same in every run."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(hash_draw(1 << 59, F.lit(seed), "id", i).alias("h"), i.alias("i")))
    return spark.range(draws).select(F.transform(F.array_sort(keys), lambda x: x["i"]).alias("p"))


def qap_monte_carlo(matrix: DataFrame, n: int, draws: int, seed: int, which: str = "upper") -> DataFrame:
    """The same over random relabellings, with p = (count + 1) / (draws + 1)."""
    return _summary(_sums(random_permutations(matrix.sparkSession, n, draws, seed), _rank_row(matrix, n, which), n), 1)


def _summary(sums: DataFrame, extra: int, by: list[str] | None = None) -> DataFrame:
    """Sums are counted by value before the null's moments and quantiles are taken, as few of them differ."""
    by = by or []
    kept = [*by, "s", "o", "centre", "scale", "rho"]
    sums = sums if "times" in sums.columns else sums.groupBy(*kept).agg(F.count(F.lit(1)).alias("times"))
    far = F.abs(F.col("s") - F.col("centre")) >= F.abs(F.col("o") - F.col("centre"))
    of, times = F.try_divide(F.col("s") - F.col("centre"), F.col("scale")), F.col("times")
    mean = F.sum(of * times) / F.sum(F.when(of.isNotNull(), times))
    spread = F.sum(of * of * times) / F.sum(F.when(of.isNotNull(), times))
    null = [mean.alias("null_mean"), F.sqrt(F.greatest(spread - mean * mean, F.lit(0.0))).alias("null_sd"), F.percentile(of, 0.95, times).alias("null_q95"), F.percentile(of, 0.99, times).alias("null_q99")]
    many = lambda c: F.sum(F.when(c, times).otherwise(0))
    out = sums.groupBy(*by).agg(F.first("rho").alias("rho"), many(F.col("s") >= F.col("o")).alias("count"), many(far).alias("count_abs"), F.sum(times).alias("total"), *null)
    names = ["null_mean", "null_sd", "null_q95", "null_q99"]
    return out.select(*by, "rho", "count", "count_abs", "total", *names, *[((F.col(c) + extra) / (F.col("total") + extra)).alias(p) for c, p in (("count", "p"), ("count_abs", "p_abs"))])
