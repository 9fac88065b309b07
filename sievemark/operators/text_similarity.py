"""BLEU of text pairs, from n-gram counts that are grouped and joined as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def _grams(tokens: Column, n: int) -> Column:
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(tokens, i, n), " ").alias("gram")))


def bleu4(df: DataFrame, key: list[str], hypothesis: str, reference: str) -> DataFrame:
    """key, bleu: geometric mean of clipped 1- to 4-gram precisions (add one above 1-grams) with the brevity penalty.

    A gram counts as often as both texts hold it. Without a common word, or with an empty text, the value is 0.
    """
    split = df.select(*key, words(hypothesis).alias("_h"), words(reference).alias("_r"))
    sizes = split.select(*key, F.size("_h").alias("h"), F.size("_r").alias("r"))
    sides = [split.select(*key, F.explode(F.concat(*[_grams(F.col(c), n) for n in range(1, 5)])).alias("g"), F.lit(int(c == "_h")).alias("own")) for c in ("_h", "_r")]
    counts = sides[0].unionByName(sides[1]).groupBy(*key, "g").agg(F.sum("own").alias("h"), F.sum(1 - F.col("own")).alias("r"))
    met = counts.groupBy(*key).agg(*[F.sum(F.when(F.col("g.n") == n, F.least("h", "r")).otherwise(0)).alias(f"m{n}") for n in range(1, 5)])
    rows = sizes.join(met, key, "left")
    logs = F.log(F.col("m1") / F.col("h"))
    for n in range(2, 5):
        logs = logs + F.log((F.col(f"m{n}") + 1) / (F.greatest(F.col("h") - (n - 1), F.lit(0)) + 1))
    brevity = F.when(F.col("h") >= F.col("r"), 0.0).otherwise(1 - F.col("r") / F.col("h"))
    value = F.when(F.coalesce("m1", F.lit(0)) > 0, F.exp(brevity + logs / 4)).otherwise(0.0)
    return rows.select(*key, value.alias("bleu"))
