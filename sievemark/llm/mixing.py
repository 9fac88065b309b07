"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in a shuffled order (by a seeded hash) and their words cut into blocks of
``block_words``. The schedule is a row of slots: slot i has the golden-ratio point frac(i * phi), computed in
31-bit integers, and the point's place in the cumulative weights names the slot's source, so every stretch of the
schedule holds the sources near their weights. The rank of a slot among its source's slots names the block it
takes, starting over when the source is used up. A source's slots end where its target is reached, the last one
in the middle of a block if need be; should a source's ranks stop short of that, the missing ranks (as many as
the discrepancy, a logarithm of the number of slots) follow at the end. So each source yields its target rounded
down to whole words, and no word is taken more than twice.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating; they share ``share`` of all words, a target
stops at twice its source's words, and what is above is shared again by weight among the others.

Ranks and word positions come from two levels of running sums, first within chunks of slots or buckets of
documents, then over them, so no source is collected in one task: a source with a third of all documents is
spread over its buckets. Only the table of sources (a row for each) is summed in one task. Slots meet sources in
1,024 bins of the unit interval, so a heavy source's slots are spread as well.

A null text has size 0. A document without words gets ``taken`` 0. Repeated rows are documents of their own. An
empty table gives an empty result. Columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from . import bytescan as bs

BLOCK_WORDS = 64
SHARE = 1.5
REPEATS = 2
WEIGHTS = (3, 1, 2)
SEED = 17
_BITS = 31
#: The odd integer nearest to 2**31 divided by the golden ratio.
_STEP = 1327217885
_BINS = 1024
_CHUNK = 1 << 16
_BUCKET = 1 << 14


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words between ASCII white space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for _, data, starts in bs.slices(batch.column("text")):
                a, _ = bs.word_bounds(data, bs.SPACE_WORDS)
                sizes.append(np.diff(bs.per_document(bs.documents_of(starts, a), len(starts) - 1)))
            size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(size, pa.int64())], names=["doc_id", "source", "size"])

    return docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(count, "doc_id long, source string, size long")


def targets(sized: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: number, name, size and target.

    Sharing the excess again by weight until none is above ends at one level for all open sources:
    target = min(repeats * size, level * weight). Sources are taken by the level at which they stop.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("number", number.cast("long")).withColumn("weight", weight)
    rows = rows.withColumn("most", F.lit(float(repeats)) * F.col("source_size"))
    stop = Window.orderBy(F.col("most") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("full", F.coalesce(F.sum("most").over(stop), F.lit(0.0))).withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(stop), F.lit(0.0)))
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.col("full")) / F.col("open"))
    # the level is that of the first source that it doesn't fill; filled sources before it stop at their most
    unfilled = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    all_in_order = Window.orderBy(F.col("most") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", F.coalesce(F.first(unfilled, True).over(all_in_order), F.max(F.col("most") / F.col("weight")).over(whole)))
    return rows.select("number", "source", "source_size", "weight", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def _running(df: DataFrame, group: list[str], chunk: str, order: list[str | Column], value: Column, name: str) -> DataFrame:
    """``value`` summed over the rows of ``group`` before each row, by chunks and then over chunks."""
    own = Window.partitionBy(*group, chunk)
    df = df.withColumn(name, F.coalesce(F.sum(value).over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, chunk).agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    return df.join(sums, [*group, chunk]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def schedule(spark: SparkSession, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots: number, slot, rank, block, and how many words of the block the slot takes."""
    wanted = F.floor("target").cast("long")
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    rows = sources.where("source_size > 0").withColumn("wanted", wanted).withColumn("blocks", blocks)
    rest = F.col("wanted") % F.col("source_size")
    need = F.expr("wanted div source_size") * F.col("blocks") + F.ceil(rest / block_words).cast("long")
    rows = rows.withColumn("need", need).where("need > 0")
    order = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("low", F.coalesce(F.sum("need").over(order), F.lit(0)) / F.sum("need").over(whole)).withColumn("high", F.col("low") + F.col("need") / F.sum("need").over(whole))
    rows = cut(rows)
    slots = rows.agg(F.sum("need")).first()[0] or 0
    point = (F.pmod(F.col("id"), F.lit(1 << _BITS)) * _STEP % (1 << _BITS)) / float(1 << _BITS)
    line = spark.range(slots + 64 if slots else 0).select(F.col("id").alias("slot"), point.alias("point")).withColumn("bin", F.floor(F.col("point") * _BINS).cast("int"))
    bins = rows.select("number", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * _BINS).cast("int"), F.least(F.floor(F.col("high") * _BINS), F.lit(_BINS - 1)).cast("int"))).alias("bin"))
    placed = line.join(bins, "bin").where("point >= low AND point < high").select("slot", "number").withColumn("chunk", F.floor(F.col("slot") / _CHUNK))
    ranked = _running(placed, ["number"], "chunk", ["slot"], F.lit(1).cast("long"), "rank").select("number", "slot", "rank")
    have = ranked.groupBy("number").agg((F.max("rank") + 1).alias("have"))
    short = rows.join(have, "number", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
    tail = short.select("number", F.lit(slots + 64).alias("slot"), F.explode(F.sequence("have", F.col("need") - 1)).alias("rank"))
    ranked = ranked.unionByName(tail).join(rows.select("number", "wanted", "blocks", "source_size"), "number")
    ranked = ranked.withColumn("block", F.col("rank") % F.col("blocks"))
    before = F.expr("rank div blocks") * F.col("source_size") + F.col("block") * block_words
    return ranked.withColumn("words", F.least(F.lit(block_words), F.col("wanted") - before)).where("words > 0").select("number", "slot", "rank", "block", "words")


def mix(spark: SparkSession, docs: DataFrame, block_words: int = BLOCK_WORDS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (both of its source), taken."""
    sized = cut(word_counts(docs))
    sources = cut(targets(sized, share))
    buckets = max(1, -(-sized.count() // _BUCKET))
    key = F.xxhash64("doc_id", F.lit(seed))
    rows = sized.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
    rows = rows.select("doc_id", "size", "number", "source_size", "target", key.alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("number", "bucket").orderBy("key", "doc_id", "size")))
    rows = _running(rows, ["number"], "bucket", ["nth"], F.col("size"), "start")
    stop = F.col("start") + F.col("size") - 1
    span = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block_words}"), F.floor(stop / block_words).cast("long")))
    pieces = rows.withColumn("block", F.explode_outer(span)).withColumn("a", F.greatest(F.lit(0), F.col("start") - F.col("block") * block_words)).withColumn("b", F.least(F.lit(block_words), F.col("start") + F.col("size") - F.col("block") * block_words))
    slots = schedule(spark, sources, block_words).select("number", "block", "words")
    met = pieces.join(slots, ["number", "block"], "left")
    got = F.greatest(F.lit(0), F.least("b", "words") - F.col("a"))
    own = ["number", "bucket", "nth", "doc_id", "size", "source_size", "target"]
    return met.groupBy(*own).agg(F.coalesce(F.sum(F.when(F.col("words").isNotNull(), got)), F.lit(0)).cast("long").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")
