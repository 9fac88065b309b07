"""Connected components of a link table: links are replaced by links to smaller nodes until all are stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Nodes whose smallest neighbours, 16 bytes each, may be broadcast; beyond that they meet links in shuffled joins.
BROADCAST_NODES = 1 << 19


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b), where component is the smallest node reachable.

    A round has two steps. First a node's larger neighbours are linked with the smallest node around it instead; then
    its smaller neighbours and itself are. Both keep what is connected and add no links, and chains of n links get
    short in a number of rounds that is logarithmic in practice, whatever the order of their ids. Links are written to
    the shared checkpoint folder between rounds, and read with the size that they have.
    """
    high, low = F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")
    stars = written(links.where("a <> b").select(high, low).distinct())
    lone = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    small = stars.select(F.explode(F.array("high", "low")).alias("node")).distinct().count() <= BROADCAST_NODES
    hint = lambda df: F.broadcast(df) if small else df
    while True:
        ends = stars.select("high", F.lit(1).alias("up"), F.lit(0).alias("down")).union(stars.select("low", F.lit(0), F.lit(1)))
        if ends.groupBy("high").agg(F.sum("up").alias("ups"), F.max("down").alias("downs")).where("ups + downs > 1 AND ups > 0").isEmpty():
            own = stars.select(F.col("low").alias("node"), F.col("low").alias("component"))
            return stars.select(F.col("high").alias("node"), F.col("low").alias("component")).union(own).union(lone).groupBy("node").agg(F.min("component").alias("component"))
        both = stars.select(F.col("high").alias("node"), F.col("low").alias("other")).union(stars.select("low", "high"))
        nearest = both.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))
        wide = both.join(hint(nearest), "node").where("other > node").select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()
        wide = written(wide)
        nearest = wide.groupBy("high").agg(F.min("low").alias("least"))
        down = wide.join(hint(nearest), "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        stars = written(down.union(nearest.select("high", F.col("least").alias("low"))).distinct())
