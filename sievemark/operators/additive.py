"""Additive two-way models of class shifts, in long form: rows (model, condition, dim, v).

Every mean is a grouped aggregate over one component, so vectors of any length and any number of models spread over
the cluster. The leave-one-cell-out prediction has a closed form for two conditions: the model's other cell plus the
difference of the conditions over the other models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import pearson
from .cluster import spearman


def standardise(parts: DataFrame, train: str, key: list[str] | None = None, value: str = "v") -> DataFrame:
    """Components less the mean over the train rows, divided by their population deviation (1 where it is 0)."""
    by = [*(key or []), "dim"]
    used = F.col(value).cast("double")
    own = parts.where(train).groupBy(*by).agg(F.avg(used).alias("_m"), F.stddev_pop(used).alias("_s"))
    scaled = (used - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return parts.join(own, by).withColumn(value, scaled).drop("_m", "_s")


def class_shift(parts: DataFrame, key: list[str], positive: str, value: str = "v") -> DataFrame:
    """key, dim, v: mean of the positive rows less mean of the others."""
    one, other = F.avg(F.when(F.expr(positive), F.col(value))), F.avg(F.when(~F.expr(positive), F.col(value)))
    return parts.groupBy(*key, "dim").agg((one - other).alias("v"))


def fitted(shifts: DataFrame) -> DataFrame:
    """In-sample additive fit: model mean + condition mean - grand mean, as ``fit``."""
    over = lambda *by: F.avg("v").over(Window.partitionBy(*by))
    return shifts.withColumn("fit", over("model", "dim") + over("condition", "dim") - over("dim"))


def left_out(shifts: DataFrame) -> DataFrame:
    """Predictions of every cell from the others: ``additive``, ``model_only`` and ``task_only``."""
    other = shifts.select("model", "dim", F.col("condition").alias("_c"), F.col("v").alias("other"))
    met = shifts.join(other, ["model", "dim"]).where("condition <> _c").drop("_c")
    sums = shifts.groupBy("condition", "dim").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    both = met.join(sums, ["condition", "dim"]).join(sums.select(F.col("condition").alias("_c"), "dim", F.col("s").alias("s2"), F.col("n").alias("n2")), "dim").where("condition <> _c")
    here = F.try_divide(F.col("s") - F.col("v"), (F.col("n") - 1).cast("double"))
    there = F.try_divide(F.col("s2") - F.col("other"), (F.col("n2") - 1).cast("double"))
    return both.select("model", "condition", "dim", "v", (F.col("other") + here - there).alias("additive"), F.col("other").alias("model_only"), here.alias("task_only"))


def r_squared(predicted: DataFrame, prediction: str) -> DataFrame:
    """1 - squared error / squares around the grand mean vector."""
    grand = F.avg("v").over(Window.partitionBy("dim"))
    rows = predicted.withColumn("_g", grand)
    error, whole = F.sum(F.pow(F.col("v") - F.col(prediction), 2)), F.sum(F.pow(F.col("v") - F.col("_g"), 2))
    return rows.agg((1 - F.try_divide(error, whole)).alias("r2"))


def cells(predicted: DataFrame, prediction: str) -> DataFrame:
    """model, condition, norms of shift and prediction, and their cosine."""
    v, w = F.col("v"), F.col(prediction)
    out = predicted.groupBy("model", "condition").agg(F.sum(v * v).alias("vv"), F.sum(w * w).alias("ww"), F.sum(v * w).alias("vw"))
    return out.select("model", "condition", F.sqrt("vv").alias("norm"), F.sqrt("ww").alias("predicted_norm"), F.try_divide(F.col("vw"), F.sqrt("vv") * F.sqrt("ww")).alias("cosine"))


def summarise(per_cell: DataFrame, dprime: str | None = None) -> DataFrame:
    """norm_r2, Pearson of norms, mean and least cosine, and Spearman of predicted norms with d'."""
    mean = F.avg("norm").over(Window.partitionBy(F.lit(0)))
    rows = per_cell.withColumn("_m", mean)
    error, whole = F.sum(F.pow(F.col("norm") - F.col("predicted_norm"), 2)), F.sum(F.pow(F.col("norm") - F.col("_m"), 2))
    out = rows.agg((1 - F.try_divide(error, whole)).alias("norm_r2"), pearson(F.col("norm"), F.col("predicted_norm")).alias("norm_r"), F.avg("cosine").alias("mean_cosine"), F.min("cosine").alias("min_cosine"))
    return out.crossJoin(spearman(per_cell, [], "predicted_norm", dprime)) if dprime else out
