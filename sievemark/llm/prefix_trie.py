"""The trie of conversations' prefixes, and sums over its subtrees by heavy-path decomposition.

1. Turns are reduced to digests before they move. A sort by ranges of (conv_id, turn) numbers them, so that one
   conversation may be longer than a task. The first turns of a family's conversation are put before each of its own.
2. A prefix is told by its depth and by two 64-bit XORs of keyed hashes of its turns, which add up over blocks of
   ``BLOCK`` turns. Nodes are groups of equal prefixes. A node is then named by its smallest member and its depth, as
   the nodes that one conversation is the smallest member of lie one below the other.
3. The heavy child of a node is the one with most members. Stretches of nodes of one name that are heavy below each
   other, ``BLOCK`` at most, are pieces; pieces find the top of their path by pointers that double their reach.
4. Below a light child are at most half of its parent's members, so paths nest to a logarithm only. Paths without open
   light paths give their sums to the nodes that they hang on, round by round, until none is left.
5. Sums from the end run along pieces, and over the pieces of a path.

Nothing is collected: a round is joins of one row with one, and sums that are combined before they move. Joins of
children with their parent, which may have a third of all nodes below it, are plain and may be split by AQE. Members
that end at a node are hashed as a stream: ids are packed by ranges of ``IDS`` ids, and a task passes over a node's
packs in order without holding them.

Rows without a conv_id belong to no conversation and are left out. Null role or text is empty; so are the bytes of such
a text. Turns of one number are taken in the order of the SHA-256 of "<length of role>:<role><text>", repeated rows
one after another. An empty table has no nodes, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, written

#: Turns of a conversation that a window holds at most.
BLOCK = 1024
#: Width of the ranges of conv_ids whose members are packed to one text.
IDS = 4096
#: Conversations of a family share first turns of its smallest one, up to MOST_SHARED - 1.
FAMILY = 5
MOST_SHARED = 9


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place from 0, digest and n_bytes of every turn, by a sort over ranges and the counts of its parts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("digest"), F.col("row")]
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "n_bytes", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).count()
    # a row for each part of the sort
    before = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = rows.withColumn("part", part).join(F.broadcast(before), "part").select("conv_id", (F.col("before") + F.col("at") - F.shiftleft("part", 33)).alias("at"), "digest", "n_bytes")
    firsts = placed.groupBy("conv_id").agg(F.min("at").alias("first"))
    return placed.join(firsts, "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("place"), "digest", "n_bytes")


def rebuilt_turns(turns: DataFrame, family: int = FAMILY, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, length, digest, n_bytes) after sharing, and all conversations (conv_id, length).

    A conversation c takes its first h turns from c - c % family, where h = crc32(c) % most, and goes on with its own
    turns after h.
    """
    turns = cut(turns)
    own = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    heads = sizes.select("conv_id", "n", (own - own % family).alias("base"), (F.crc32(own.cast("string").cast("binary")) % most).alias("h"))
    base = sizes.select(own.alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    plans = heads.join(base, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    plans = cut(plans)
    rest = turns.join(plans, "conv_id").where("place >= h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth"), "length", "digest", "n_bytes")
    # few turns of a conversation for each of its family
    shared = turns.where(F.col("place") < most - 1).withColumnRenamed("conv_id", "base").join(plans, "base").where("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "length", "digest", "n_bytes")
    return cut(rest.unionByName(shared)), plans.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with the two halves of its prefix's hash (p, q) and of the prefix before it (before_p, before_q)."""
    rows = turns.withColumns({"f": F.xxhash64(F.lit(0), "depth", "digest"), "g": F.xxhash64(F.lit(1), "digest", "depth"), "block": F.floor((F.col("depth") - 1) / BLOCK)})
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.where(F.col("length") > BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("f").alias("f"), F.bit_xor("g").alias("g"))
    carried = blocks.select("conv_id", "block", F.bit_xor("f").over(earlier).alias("carry_f"), F.bit_xor("g").over(earlier).alias("carry_g")).where("block > 0")
    rows = rows.withColumns({"p": F.bit_xor("f").over(upto), "q": F.bit_xor("g").over(upto)}).join(carried, ["conv_id", "block"], "left")
    rows = rows.withColumns({x: F.col(x).bitwiseXOR(F.coalesce(c, F.lit(0).cast("long"))) for x, c in (("p", "carry_f"), ("q", "carry_g"))})
    return rows.select("conv_id", "depth", "length", "n_bytes", "p", "q", F.col("p").bitwiseXOR(F.col("f")).alias("before_p"), F.col("q").bitwiseXOR(F.col("g")).alias("before_q"))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the packs of a node, in order; a node's last pack may be in the next batch."""
    key, state = None, None
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["depth", "p", "q", "ends_sha256"])

    for batch in batches:
        for d, p, q, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "p", "q", "ids")), strict=True):
            if (d, p, q) == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = (d, p, q), hashlib.sha256(ids.encode())
        if out:
            yield batch_of(out)
            out = []
    if key is not None:
        yield batch_of([(*key, state.hexdigest())])


def ends_of(ended: DataFrame) -> DataFrame:
    """depth, p, q and ends_sha256 of the nodes that conversations (conv_id, depth, p, q) end at."""
    packs = ended.groupBy("depth", "p", "q", F.floor(F.col("conv_id") / IDS).alias("pack")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return packs.repartition("depth", "p", "q").sortWithinPartitions("depth", "p", "q", "pack").mapInArrow(_stream, "depth long, p long, q long, ends_sha256 string")


def _paths(pieces: DataFrame) -> DataFrame:
    """conv_id, piece and the top piece (path_conv, path_top) of its path; pointers reach twice as far each round."""
    tops = pieces.where("NOT heavy").select("conv_id", "piece", F.col("conv_id").alias("path_conv"), F.col("piece").alias("path_top"), F.lit(True).alias("done"))
    ends = pieces.select(F.col("conv_id").alias("parent_conv_id"), (F.col("end") + 1).alias("piece"), F.col("piece").alias("path_top"), (~F.col("heavy")).alias("done"))
    lower = pieces.where("heavy").join(ends, ["parent_conv_id", "piece"]).select("conv_id", "piece", F.col("parent_conv_id").alias("path_conv"), "path_top", "done")
    known = written(tops.unionByName(lower))
    while not known.where("NOT done").isEmpty():
        # no two open pieces of a path point at the same piece, so rows meet one by one
        to = known.select(F.col("conv_id").alias("path_conv"), F.col("piece").alias("path_top"), F.col("path_conv").alias("far_conv"), F.col("path_top").alias("far_top"), F.col("done").alias("far_done"))
        open_ = known.where("NOT done").join(to, ["path_conv", "path_top"]).select("conv_id", "piece", F.col("far_conv").alias("path_conv"), F.col("far_top").alias("path_top"), F.col("far_done").alias("done"))
        known = written(known.where("done").unionByName(open_))
    return known.select("conv_id", "piece", "path_conv", "path_top")


def _whole(paths: DataFrame) -> DataFrame:
    """path_conv, path_top, parent_conv_id and the sums (value, leaves) of all below the tops of paths.

    A path is closed when all light paths that hang on it are; closed ones give their sums to the paths above.
    """
    light = paths.where("up_conv IS NOT NULL").groupBy(F.col("up_conv").alias("path_conv"), F.col("up_top").alias("path_top")).agg(F.count(F.lit(1)).alias("waits"))
    open_ = written(paths.join(light, ["path_conv", "path_top"], "left").withColumn("waits", F.coalesce("waits", F.lit(0))))
    closed = []
    while True:
        ready = open_.where("waits = 0")
        closed.append(ready.select("path_conv", "path_top", "parent_conv_id", "value", "leaves"))
        left = open_.where("waits > 0")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, closed)
        given = ready.groupBy(F.col("up_conv").alias("path_conv"), F.col("up_top").alias("path_top")).agg(F.sum("value").alias("more"), F.sum("leaves").alias("more_leaves"), F.count(F.lit(1)).alias("came"))
        met = left.join(given, ["path_conv", "path_top"], "left")
        plus = lambda c, m: F.col(c) + F.coalesce(m, F.lit(0))
        open_ = written(met.withColumns({"value": plus("value", "more"), "leaves": plus("leaves", "more_leaves"), "waits": F.col("waits") - F.coalesce("came", F.lit(0))}).drop("more", "more_leaves", "came"))


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, n_children, n_leaves and the sum of ``value`` over the subtree of every node of a trie.

    ``nodes`` has conv_id and depth, which name a node, parent_conv_id (null for the root), n_convs and value.
    """
    name = ["conv_id", "depth"]
    weight = F.struct("n_convs", (-F.col("conv_id")).alias("least"))
    below = nodes.where("parent_conv_id IS NOT NULL").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"), F.max_by("conv_id", weight).alias("heavy_conv"))
    below = cut(below)
    heavy = below.select(F.col("heavy_conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.lit(True).alias("heavy"))
    tree = nodes.join(below.drop("heavy_conv"), name, "left").join(heavy, name, "left").na.fill({"n_children": 0, "heavy": False})
    starts = ~F.col("heavy") | ~F.col("parent_conv_id").eqNullSafe(F.col("conv_id")) | (F.col("depth") % BLOCK == 0)
    upto = Window.partitionBy("conv_id", F.floor(F.col("depth") / BLOCK)).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    tree = written(tree.withColumn("piece", F.max(F.when(starts, F.col("depth"))).over(upto)))
    pieces = tree.groupBy("conv_id", "piece").agg(F.max("depth").alias("end"), F.min_by("parent_conv_id", "depth").alias("parent_conv_id"), F.min_by("heavy", "depth").alias("heavy"))
    tree = written(tree.join(_paths(written(pieces)), ["conv_id", "piece"]))

    childless = F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(0)
    sums = tree.groupBy("path_conv", "path_top").agg(F.sum("value").alias("value"), F.sum(childless).alias("leaves"))
    tops = tree.where((F.col("conv_id") == F.col("path_conv")) & (F.col("depth") == F.col("path_top"))).select("path_conv", "path_top", "parent_conv_id", (F.col("depth") - 1).alias("up_depth"))
    up = tree.select(F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("up_depth"), F.col("path_conv").alias("up_conv"), F.col("path_top").alias("up_top"))
    paths = _whole(tops.join(up, ["parent_conv_id", "up_depth"], "left").drop("up_depth").join(sums, ["path_conv", "path_top"]))

    hung = paths.where("parent_conv_id IS NOT NULL").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("path_top") - 1).alias("depth")).agg(F.sum("value").alias("hung"), F.sum("leaves").alias("hung_leaves"))
    tree = tree.join(hung, name, "left").select(*name, "n_children", "piece", "path_conv", "path_top", (F.col("value") + F.coalesce("hung", F.lit(0))).alias("value"), (childless + F.coalesce("hung_leaves", F.lit(0))).alias("leaves"))
    tree = written(tree)
    down = Window.partitionBy("conv_id", "piece").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("path_conv", "path_top").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    of_piece = tree.groupBy("path_conv", "path_top", "conv_id", "piece").agg(F.sum("value").alias("value"), F.sum("leaves").alias("leaves"))
    after = of_piece.select("conv_id", "piece", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in ("value", "leaves")))
    out = tree.withColumns({c: F.sum(c).over(down) for c in ("value", "leaves")}).join(after, ["conv_id", "piece"])
    return out.select(*name, "n_children", (F.col("leaves") + F.col("later_leaves")).alias("n_leaves"), (F.col("value") + F.col("later_value")).alias("value"))


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt_turns(numbered_turns(conversations))
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), "length", zero.alias("n_bytes"), zero.alias("p"), zero.alias("q"), zero.alias("before_p"), zero.alias("before_q"))
    rows = cut(prefixes(turns).unionByName(roots))
    key = ["depth", "p", "q"]
    nodes = rows.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("before_p").alias("before_p"), F.max("before_q").alias("before_q"))
    nodes = cut(nodes)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("before_p"), F.col("q").alias("before_q"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(parents, ["depth", "before_p", "before_q"], "left").select(*key, "conv_id", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("value"))
    nodes = written(nodes.join(ends_of(rows.where("depth = length").select("conv_id", *key)), key, "left"))
    sums = subtree_sums(nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "value"))
    out = nodes.drop("value").join(sums, ["conv_id", "depth"])
    ends = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))
    return out.select(*_long("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves"), F.col("value").cast("long").alias("saved_tokens"), ends.alias("ends_sha256"))
