"""Gates on fixed views of pairs: prefix identity, recovered tokens, pair counts and minima; refits against released values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gates
from .gates import _key, _rows
from .views import recovered

SIDES = ("human", "generated")


def _first(ids: str, required: int) -> Column:
    return F.slice(ids, 1, required)


def analysis_views(pairs: DataFrame, key: list[str], required: int, gate: str = "analysis view") -> DataFrame:
    """Violations of pairs (key, human_ids, generated_ids, human_view, generated_view) in one scan, and of repeated keys.

    Both sides need ``required`` tokens, and a side that has them needs just its first tokens as its view; one that
    hasn't needs a null view.
    """
    rules: dict[str, tuple[Column, Column]] = {}
    for side in SIDES:
        n = F.size(f"{side}_ids")
        rules[f"{side} tokens"] = (n >= required, n)
        wanted = F.when(n >= required, _first(f"{side}_ids", required))
        rules[f"{side} prefix"] = (F.col(f"{side}_view").eqNullSafe(wanted), F.size(f"{side}_view"))
    return gates.gather(gates.unique(pairs, gate, key), gates.compiled(pairs, gate, key, rules))


def pair_minima(pairs: DataFrame, required: int, by: list[str] | None = None) -> DataFrame:
    """One row (of each group): pairs, least tokens of either side and of both, pairs that are too short, and the status."""
    human, made = F.size("human_ids"), F.size("generated_ids")
    both = F.least(human, made)
    out = pairs.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("pairs"), F.min(human).alias("human_min"), F.min(made).alias("generated_min"), F.min(both).alias("pair_min"), F.count_if(~F.coalesce(both >= required, F.lit(False))).alias("short"))
    return out.withColumn("status", F.when(F.col("short") == 0, "ok").otherwise("failed"))


def paired_views(views: DataFrame, key: list[str], cell: list[str], required: int, sources: int, gate: str = "paired view") -> DataFrame:
    """Views with boundaries (key, human_ids, human_mask, human_view, and the same of generated), as a model gets them.

    The mask keeps just ``required`` places, the ids at these places are the view again, ids and mask are of one length,
    and a cell has ``sources`` pairs of different sources.
    """
    rules: dict[str, tuple[Column, Column] | Column] = {}
    for side in SIDES:
        ids, mask, view = F.col(f"{side}_ids"), F.col(f"{side}_mask"), F.col(f"{side}_view")
        kept = F.size(F.filter(mask, lambda m: m))
        rules[f"{side} mask"] = (kept == required, kept)
        rules[f"{side} length"] = (F.size(ids) == F.size(mask), F.size(ids))
        rules[f"{side} recovered"] = recovered(ids, mask) == view
    counted = views.groupBy(*cell).agg(F.count(F.lit(1)).alias("_pairs"), F.count_distinct(*key).alias("_different"))
    pairs = gates.compiled(counted, gate, cell, {"pairs": ((F.col("_pairs") == sources) & (F.col("_different") == sources), F.col("_pairs"))})
    return gates.gather(gates.compiled(views, gate, key, rules), pairs)


def refit(now: DataFrame, released: DataFrame, key: list[str], values: list[str], within: float = 0.0, gate: str = "refit") -> DataFrame:
    """Values that were fitted again against released ones: just the same keys, and each value equal, bit for bit.

    With ``within`` a difference of that size passes. Nulls and NaN equal themselves only; 0.0 and -0.0 are equal.
    """
    other = released.select(*key, F.struct(*values).alias("_released"))
    met = now.join(other, key)
    rules = {}
    for v in values:
        a, b = F.col(v), F.col("_released")[v]
        near = F.coalesce(F.abs(a - b) <= within, F.lit(False)) if within > 0 else F.lit(False)
        rules[v] = (a.eqNullSafe(b) | near, F.concat_ws(" ", F.coalesce(a.cast("string"), F.lit("null")), F.coalesce(b.cast("string"), F.lit("null"))))
    return gates.gather(gates.unique(now, gate, key), gates.unique(released, gate, key), gates.coverage(released, now, gate, key), gates.compiled(met, gate, key, rules))


def same_humans(rewrites: DataFrame, generations: DataFrame, fields: list[str], gate: str = "rewrite panel") -> DataFrame:
    """Sources of a rewrite panel against those of the panel that they were drawn from: the same ones, with equal fields."""
    own = rewrites.select("source_id", *fields).distinct()
    other = generations.select("source_id", *fields).distinct()
    met = own.join(other.select("source_id", F.struct(*fields).alias("_other")), "source_id")
    rules = {f: (F.col(f).eqNullSafe(F.col("_other")[f]), F.col(f)) for f in fields}
    split = own.groupBy("source_id").count().where("count > 1")
    return gates.gather(gates.coverage(generations, rewrites, gate, ["source_id"]), gates.compiled(met, gate, ["source_id"], rules), _rows(split, gate, "one identity", _key(["source_id"]), F.col("count")))
