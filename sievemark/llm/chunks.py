"""Documents dealt by hash to chunks of bounded size, which several passes read from one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text of a chunk.
CHUNK_BYTES = 8 << 20
_STEP = 4096


def deal(docs: DataFrame, size: int, chunk_bytes: int = CHUNK_BYTES, nameless: bool = False) -> DataFrame:
    """doc_id, text, tag, copies and chunk of the rows with a doc_id (``nameless``: of all rows); tag tells texts of one doc_id apart.

    ``size`` is the number of bytes of all texts. Where no doc_id is repeated, tag is zero, which packs to nothing. Else
    repeated rows are counted before they are dealt, so that no chunk gets many of them.
    """
    own = (docs if nameless else docs.where("doc_id IS NOT NULL")).select(F.col("doc_id").cast("long"), "text")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    if own.groupBy("doc_id").count().where("count > 1").isEmpty():
        none = F.lit(0).cast("long")
        tag = F.when(F.col("doc_id").isNull(), text_hash).otherwise(none) if nameless else none
        own = own.select("doc_id", "text", tag.alias("tag"), F.lit(1).cast("long").alias("copies"))
    else:
        own = own.groupBy("doc_id", "text", text_hash.alias("tag")).agg(F.count(F.lit(1)).alias("copies"))
    return own.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(max(1, -(-size // chunk_bytes)))).cast("int"))


def repeat(rows: DataFrame) -> DataFrame:
    """A row for each of ``copies``, in steps, so that no array holds many."""
    columns = [c for c in rows.columns if c != "copies"]
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), "copies", F.lit(_STEP).cast("long"))))
    return rows.withColumn("copy", F.explode(F.sequence("step", F.least(F.col("step") + (_STEP - 1), "copies")))).select(columns)
