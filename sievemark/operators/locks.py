"""Locks: Merkle trees over the rows of a table, proofs that a row is in one, what changed, and hashes of ordered lists.

Rows are numbered by a sort over ranges, whose parts are counted, and a node hashes the up to ``FANOUT`` nodes below it
in order. So no array grows with the table, and a level has a sixteenth of the rows of the one below. A list's hash is
of one text, which only a pass in order can give: its items are packed by place, and a task passes over the packs of a
list without holding them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, written

FANOUT = 16
#: Items of a list that are packed to one text.
PACK = 1024
#: Nodes of a level, about 100 bytes each, that may be broadcast.
BROADCAST_NODES = 1 << 16


def placed(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their number from 0 in an order, nulls first; equal rows get numbers of their own."""
    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = parts.groupBy(part.alias("_part")).count()
    # a row for each part of the sort
    before = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = parts.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.select(*[F.col(c) for c in rows.columns], (F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)).alias(name))


def _hashed(batches: Iterator[pa.RecordBatch], keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    key, state, n = None, None, 0
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in (*keys, "_items", "_n")]
        for *own, items, count in zip(*columns, strict=True):
            if key is not None and own == key:
                state.update(b"," + items.encode())
                n += count
                continue
            if key is not None:
                out.append((*key, n, state, b"]"))
            key, state, n = own, hashlib.sha256(b"[" + items.encode()), count
        if out:
            yield _closed(out, schema)
    if key is not None:
        yield _closed([(*key, n, state, b"]")], schema)


def _closed(lists: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    rows = []
    for *key, n, state, end in lists:
        state.update(end)
        rows.append((*key, n, state.hexdigest()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def ordered_lists(rows: DataFrame, group: list[str], item: str, order: str) -> DataFrame:
    """group, n and the SHA-256 of the canonical JSON of the group's items (strings) in order, for lists of any length."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType

    numbered = placed(rows.select(*group, F.col(item).alias("_item"), F.col(order).alias("_order")), [*group, "_order", "_item"], "_place")
    json = F.to_json(F.array("_item"))
    json = F.substring(json, F.lit(2), F.length(json) - 2)
    packs = numbered.groupBy(*group, F.floor(F.col("_place") / PACK).alias("_pack")).agg(F.count(F.lit(1)).alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", json.alias("json")))), lambda x: x["json"]), ",").alias("_items"))
    schema = packs.select(*group).schema.add("n", LongType()).add("ids_sha256", StringType())
    arrow = to_arrow_schema(schema)
    return packs.repartition(*group).sortWithinPartitions(*group, "_pack").mapInArrow(lambda b: _hashed(b, group, arrow), schema)


def leaf(path: Column, digest: Column) -> Column:
    """Hash of a row; the word before tells it from a node's."""
    return F.sha2(F.concat(F.lit("leaf:"), F.to_json(F.struct(path.alias("path"), digest.alias("digest")), {"ignoreNullFields": "false"})), 256)


def node(children: Column) -> Column:
    """Hash of the hashes below a node, in order."""
    return F.sha2(F.concat(F.lit("node:"), F.array_join(children, ",")), 256)


@dataclass
class Lock:
    """A tree: ``levels`` from the leaves (place, hash, path) to the root (place, hash), and the number of leaves."""

    levels: list[DataFrame]
    n: int

    def root(self) -> DataFrame:
        """lock_sha256 and n; a table without rows has a root of its own."""
        top = self.levels[-1].agg(F.max("hash").alias("h"))
        return top.select(F.coalesce("h", F.sha2(F.lit("empty:"), 256)).alias("lock_sha256"), F.lit(self.n).cast("long").alias("n"))

    def save(self, path: str) -> None:
        """All levels as one table, to be read with ``load``."""
        for k, level in enumerate(self.levels):
            columns = ["place", "hash", F.col("path") if k == 0 else F.lit(None).cast("string").alias("path")]
            level.select(F.lit(k).alias("level"), *columns).write.mode("overwrite" if k == 0 else "append").partitionBy("level").parquet(path)


def load(spark: SparkSession, path: str) -> Lock:
    table = spark.read.parquet(path)
    n = table.groupBy("level").count().orderBy("level").collect()
    return Lock([table.where(F.col("level") == r["level"]).drop("level") for r in n] or [table], n[0]["count"] if n else 0)


def _families(level: DataFrame) -> DataFrame:
    """place of the node above and the hashes below it, sixteen at most."""
    below = F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"])
    return level.groupBy(F.floor(F.col("place") / FANOUT).alias("place")).agg(below.alias("children"))


def build(rows: DataFrame, path: str = "path", digest: str = "digest", keep: bool = True) -> Lock:
    """The tree over (path, digest) rows in the order of path, then of digest; repeated rows are leaves of their own.

    Levels are written, to be read often; without ``keep`` only leaves are, for where just the root is asked for.
    """
    own = rows.select(F.col(path).cast("string").alias("path"), leaf(F.col(path).cast("string"), F.col(digest)).alias("hash"))
    levels = [written(placed(own, ["path", "hash"]).select("place", "hash", "path"))]
    n = many = levels[0].count()
    while many > 1:
        level = _families(levels[-1]).select("place", node(F.col("children")).alias("hash"))
        levels.append(written(level) if keep else level)
        many = -(-many // FANOUT)
    return Lock(levels, n)


def proofs(lock: Lock, wanted: DataFrame | None = None) -> DataFrame:
    """path, place, hash and ``families``: for each level the hashes that are hashed together, the row's own among them.

    ``wanted`` has the paths of interest; without it every leaf gets its proof.
    """
    rows = lock.levels[0] if wanted is None else lock.levels[0].join(wanted.select("path").distinct(), "path", "left_semi")
    rows = rows.select("path", "place", "hash", F.array().cast("array<array<string>>").alias("families"))
    many = lock.n
    for k, level in enumerate(lock.levels[:-1]):
        families = _families(level).withColumnRenamed("place", "_up")
        many = -(-many // FANOUT)
        families = F.broadcast(families) if many <= BROADCAST_NODES else families
        up = F.floor(F.col("place") / FANOUT ** (k + 1)).cast("long")
        rows = rows.withColumn("_up", up).join(families, "_up").select("path", "place", "hash", F.concat("families", F.array("children")).alias("families"))
    return rows


def proved(place: Column, own: Column, families: Column, root: Column) -> Column:
    """Whether a proof leads from a row's hash to the root: at each level its place holds the hash so far."""
    start = F.struct(own.alias("hash"), place.cast("long").alias("at"), F.lit(True).alias("ok"))

    def up(a: Column, children: Column) -> Column:
        here = F.get(children, (a["at"] % FANOUT).cast("int")).eqNullSafe(a["hash"])
        return F.struct(node(children).alias("hash"), F.floor(a["at"] / FANOUT).cast("long").alias("at"), (a["ok"] & here).alias("ok"))

    end = F.aggregate(families, start, up)
    return end["ok"] & end["hash"].eqNullSafe(root) & (end["at"] == 0)


def changed(old: Lock, new: Lock) -> DataFrame:
    """place, old_path, new_path of the leaves that differ: only below nodes that differ are nodes compared.

    Trees of one height are compared from the root down. A row that came or went moves those behind it, which then
    differ too; ``gates.coverage`` names such rows. Trees of different height are compared by their leaves alone.
    """
    depth = len(old.levels)
    same = depth == len(new.levels)
    differ = None
    for k in range(depth - 1 if same else 0, -1, -1):
        extra = ["path"] if k == 0 else []
        a = old.levels[k].select("place", F.col("hash").alias("old_hash"), *(F.col(c).alias(f"old_{c}") for c in extra))
        b = new.levels[k].select("place", F.col("hash").alias("new_hash"), *(F.col(c).alias(f"new_{c}") for c in extra))
        if differ is not None:
            above = differ.select(F.col("place").alias("_up"))
            a, b = (x.withColumn("_up", F.floor(F.col("place") / FANOUT)).join(above, "_up", "left_semi").drop("_up") for x in (a, b))
        differ = cut(a.join(b, "place", "full").where(~F.col("old_hash").eqNullSafe(F.col("new_hash"))))
    return differ.select("place", "old_path", "new_path")
