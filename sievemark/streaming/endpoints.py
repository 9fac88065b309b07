"""Endpoint files as a stream: first attempts by key, late files bounded by a watermark, counts by cell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import ENDPOINT

KEY = ["suite", "cell", "source_id"]


def endpoint_stream(spark: SparkSession, path: str, schema: str = ENDPOINT, files_each: int = 1000) -> DataFrame:
    """New endpoint files of a tree, with the time they were written."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).option("recursiveFileLookup", True).json(path)
    return rows.withColumn("written", F.col("_metadata.file_modification_time"))


def first_of_key(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per key; keys are forgotten when the watermark has passed them."""
    return rows.withWatermark("written", delay).dropDuplicatesWithinWatermark(KEY)


def gated(rows: DataFrame, gate: Callable[[DataFrame], DataFrame], good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Write rows without violations and the violations of the others, batch by batch, and end with the input."""

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        found = gate(df).withColumn("batch", F.lit(number))
        found.persist()
        key = F.concat_ws("|", *KEY)
        df.join(found.select(F.col("key").alias("_key")).distinct(), key == F.col("_key"), "left_anti").write.mode("append").parquet(good)
        found.write.mode("append").parquet(bad)
        found.unpersist()
        df.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
