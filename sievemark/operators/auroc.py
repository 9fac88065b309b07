"""AUROC of two classes of scores by cell, and what each source contributes to it.

Scores come as rows (cell, source, human, generated). The statistic is the mean over all pairs of 1 where the
generated score is larger and 1/2 where it ties. Pairs are never built: each class becomes a histogram of distinct
scores by partial aggregation, running totals over it count the human scores below, and twice the number of wins is
an exact integer. So ceilings (AUROC exactly 1) are decided on integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import dprime
from ..session import cut
from .ranking import running_total


def _histogram(scores: DataFrame, cell: str) -> DataFrame:
    sides = F.explode(F.array(F.struct(F.col("human").alias("score"), F.lit(0).alias("made")), F.struct(F.col("generated").alias("score"), F.lit(1).alias("made"))))
    rows = scores.select(cell, sides.alias("s")).select(cell, "s.*")
    # written once, as ranges, their sums and the totals are read from it
    return cut(rows.groupBy(cell, "score").agg(F.sum(1 - F.col("made")).alias("humans"), F.sum("made").alias("made")))


def wins(scores: DataFrame, cell: str = "cell") -> DataFrame:
    """cell, n_human, n_generated and twice the pairs that the generated side wins (ties count one)."""
    counted = running_total(_histogram(scores, cell), [cell], "score", {"below": F.col("humans")})
    twice = F.sum(F.col("made") * (2 * F.col("below") + F.col("humans")))
    return counted.groupBy(cell).agg(F.sum("humans").alias("n_human"), F.sum("made").alias("n_generated"), twice.alias("twice_wins"))


def auroc(scores: DataFrame, cell: str = "cell") -> DataFrame:
    """``wins`` with auroc, ceiling (exactly 1) and d' with its censoring."""
    out = wins(scores, cell).withColumn("auroc", F.try_divide(F.col("twice_wins"), 2 * F.col("n_human") * F.col("n_generated")))
    out = out.withColumn("ceiling", F.col("twice_wins") == 2 * F.col("n_human") * F.col("n_generated"))
    return out.withColumn("dprime", dprime("auroc"))


def contributions(scores: DataFrame, cell: str = "cell", source: str = "source") -> DataFrame:
    """cell, source and half the mean kernel of its generated and of its human score; the mean over sources is the AUROC."""
    hist = running_total(_histogram(scores, cell), [cell], "score", {"below": F.col("humans"), "made_below": F.col("made")})
    size = hist.groupBy(cell).agg(F.sum("humans").alias("n"), F.sum("made").alias("m"))
    human_wins = hist.select(cell, F.col("score").alias("generated"), (2 * F.col("below") + F.col("humans")).alias("twice_generated"))
    lost = hist.join(size, cell).select(cell, F.col("score").alias("human"), (2 * (F.col("m") - F.col("made_below") - F.col("made")) + F.col("made")).alias("twice_human"), "n", "m")
    met = scores.join(human_wins, [cell, "generated"]).join(lost, [cell, "human"])
    value = (F.col("twice_generated") / F.col("n") + F.col("twice_human") / F.col("m")) / 4
    return met.select(cell, source, value.alias("contribution"))
