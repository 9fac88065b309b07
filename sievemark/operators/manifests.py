"""Source manifests, cohorts, queues and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import render, sha256_text, source_id, word_bounds, word_count
from ..session import cut
from . import locks
from .ranking import running_total


def indexed(rows: DataFrame, order: str, name: str = "compact_index") -> DataFrame:
    """Rows numbered from 0 by a unique ordering column, without sorting the table in one task."""
    numbered = running_total(cut(rows.select(order)), [], order, {name: F.lit(1).cast("long")})
    return rows.join(numbered, order)


def source_manifest(rows: DataFrame, text: str = "text") -> DataFrame:
    """Identity, hash, words and word bounds of every source (compact_index, text, ...)."""
    out = rows.withColumn("source_id", source_id("compact_index")).withColumn("human_sha256", sha256_text(text)).withColumn("human_word_count", word_count(text))
    low, high = word_bounds("human_word_count")
    return out.withColumn("low_words", low).withColumn("high_words", high)


def split_of(key: Column, train: float = 0.704, val: float = 0.138) -> Column:
    """A split by hash in the shares of the panel's 352, 69 and 79 sources."""
    u = F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(1000)) / 1000.0
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order; Spark keeps n rows a partition, so nothing is sorted whole."""
    return rows.orderBy(*order).limit(n)


def main_cohort(manifest: DataFrame, low: int = 0, high: int = 499) -> DataFrame:
    return manifest.where(F.col("compact_index").between(low, high)).withColumn("cohort", F.lit("main"))


def pilot_cohort(manifest: DataFrame, exemplars: DataFrame, n: int = 50, least: int = 500) -> DataFrame:
    """The first n train sources from ``least`` on that aren't exemplars."""
    free = manifest.where((F.col("compact_index") >= least) & (F.col("split_origin") == "train")).join(exemplars.select("source_id"), "source_id", "left_anti")
    return first_n(free, n, "compact_index").withColumn("cohort", F.lit("pilot"))


def eligible(manifest: DataFrame, split: str, include: str, low: int, high: int) -> DataFrame:
    return manifest.where((F.col("split_origin") == split) & (F.lower(F.trim(include)) == "true") & F.col("human_word_count").between(low, high))


def with_source_text(queued: DataFrame, humans: DataFrame, text: str = "text") -> DataFrame:
    """Queue rows with their source's text; a hash that differs stops the job."""
    met = queued.join(humans.select("source_id", F.col(text).alias("source_text")), "source_id")
    bad = sha256_text("source_text") != F.col("human_sha256")
    return met.withColumn("source_text", F.when(bad, F.raise_error(F.concat(F.lit("hash of "), "source_id"))).otherwise(F.col("source_text")))


def prompts(queued: DataFrame, template: str, examples: Column, **more: Column) -> DataFrame:
    """Queue rows with ``prompt`` and its hash; the template names {examples}, {topic} and what else is given."""
    return queued.withColumn("prompt", render(template, examples=examples, topic=F.col("topic"), **more)).withColumn("prompt_sha256", sha256_text("prompt"))


def without_near_copies(rows: DataFrame, texts: DataFrame, excluded: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Rows whose text isn't one of the texts of excluded keys: a semi-join, then an anti-join on text."""
    bad = texts.join(excluded.select(*key).distinct(), key, "left_semi").select(text).distinct()
    return rows.join(bad, text, "left_anti")


def first_match(rows: DataFrame, lookup: DataFrame, on: str, value: str, order: str, missing: int = -1) -> DataFrame:
    """``value`` of the first lookup row (by ``order``) with the same text, else ``missing``."""
    first = lookup.groupBy(on).agg(F.min_by(value, order).alias(value))
    return rows.join(first, on, "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def ordered_ids(rows: DataFrame, group: list[str], item: str, order: str) -> DataFrame:
    """group, n and the hash of its ids in order; lists may be of any length."""
    return locks.ordered_lists(rows, group, item, order)


def last_value(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """One row per key: the value of its last row, as a dictionary keeps it."""
    return rows.groupBy(*key).agg(F.max_by(value, order).alias(value))


def numbered_in_group(rows: DataFrame, group: list[str], order: list[str], name: str = "number") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
