"""Configurations as VARIANT columns: leaves as rows, fields replaced, canonical JSON again, and what differs by path.

A path is the array of names from the root to a leaf; arrays and scalars are leaves. Objects are taken apart level by
level and put together from their leaves upward, so documents may have any fields, and any depth up to ``DEPTH``.
A document is one value, so all its names fit a task; documents are spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

DEPTH = 32


def _is_object(v: Column) -> Column:
    """Objects with a field; an empty one is a leaf."""
    kind = F.schema_of_variant(v)
    return F.coalesce(kind.startswith("OBJECT<") & (kind != "OBJECT<>"), F.lit(False))


def leaves(documents: DataFrame, key: list[str], config: str) -> DataFrame:
    """key, path and value (JSON text) of every leaf of a VARIANT column; a null document has no leaves."""
    spark = documents.sparkSession
    level = documents.where(F.col(config).isNotNull()).select(*key, F.array().cast("array<string>").alias("path"), F.col(config).alias("_v"))
    found = None
    for _ in range(DEPTH + 1):
        own = level.where(~_is_object(F.col("_v"))).select(*key, "path", F.to_json("_v").alias("value"))
        found = own if found is None else found.unionByName(own)
        nested = level.where(_is_object(F.col("_v"))).select(*key, F.col("path").alias("_above"), F.col("_v").alias("_object"))
        if nested.isEmpty():
            return found
        parts = nested.lateralJoin(spark.tvf.variant_explode(F.col("_object").outer()))
        level = cut(parts.select(*key, F.concat("_above", F.array("key") if "key" not in key else F.array(parts["key"])).alias("path"), F.col("value").alias("_v")))
    raise ValueError(f"a document is deeper than {DEPTH} levels")


def documents_of(found: DataFrame, key: list[str], name: str = "config") -> DataFrame:
    """key and the canonical JSON text (sorted names, no spaces) of documents from their leaves.

    A path that is a leaf and an object at once can't be: the job stops.
    """
    rows = found.select(*key, "path", "value")
    depth = rows.agg(F.max(F.size("path"))).first()[0]
    for d in range(depth or 0, 0, -1):
        here = rows.where(F.size("path") == d)
        quoted = F.to_json(F.array(F.element_at("path", -1)))
        field = F.struct(F.element_at("path", -1).alias("n"), F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":"), "value").alias("t"))
        fields = F.array_sort(F.collect_list(field))
        names = F.transform(fields, lambda x: x["n"])
        text = F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda x: x["t"]), ","), F.lit("}"))
        text = F.when(F.size(F.array_distinct(names)) < F.size(names), F.raise_error("a path is a leaf and an object, or is there twice")).otherwise(text)
        made = here.groupBy(*key, F.slice("path", 1, d - 1).alias("path")).agg(text.alias("value"))
        rows = rows.where(F.size("path") < d).unionByName(made)
    return rows.groupBy(*key).agg(F.when(F.count(F.lit(1)) > 1, F.raise_error("a document is a leaf and an object")).otherwise(F.max("value")).alias(name))


def replaced(documents: DataFrame, key: list[str], config: str, values: dict[tuple[str, ...], Column]) -> DataFrame:
    """``documents`` with a VARIANT column in which the fields at some paths are set to JSON texts, as a VARIANT column.

    What was at or below a path goes; objects on the way to it are made where they lack. A path below a scalar
    replaces it. Null documents stay null. ``values`` may use columns of ``documents``.
    """
    found = leaves(documents, key, config)
    paths = [F.array(*map(F.lit, p)) for p in values]

    def related(path: Column) -> Column:
        """Whether one of the set paths is a beginning of the leaf's path, or the other way round."""
        out = F.lit(False)
        for p in paths:
            n = F.least(F.size(path), F.size(p))
            out = out | (F.slice(path, 1, n) == F.slice(p, 1, n))
        return out

    kept = found.where(~related(F.col("path")))
    put = F.explode(F.array(*(F.struct(p.alias("path"), v.cast("string").alias("value")) for p, v in zip(paths, values.values(), strict=True)))).alias("s")
    new = documents.where(F.col(config).isNotNull()).select(*key, put).select(*key, "s.path", "s.value")
    made = documents_of(kept.unionByName(new), key, "_made")
    return documents.join(made, key, "left").withColumn(config, F.parse_json("_made")).drop("_made")


def differences(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """key, path, left and right value of the leaves that differ between two tables of leaves; a null is a missing leaf."""
    a = left.select(*key, "path", F.col("value").alias("left"))
    b = right.select(*key, "path", F.col("value").alias("right"))
    return a.join(b, [*key, "path"], "full").where(~F.col("left").eqNullSafe(F.col("right")))
