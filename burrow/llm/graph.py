"""Connected components by alternating large-star and small-star steps; nothing but a flag reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b``, longs) but the roots themselves; a root is its component's smallest node.

    Each node is tied to the smallest node in reach; the number of steps grows with the logarithm of the longest
    path. A node of many edges is summed up before the shuffle, and joined back to its edges by a broadcast. No edges give
    no rows; loops and repeated edges do no harm. Steps end once every node has one tie, to a node without any.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        up, down = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        met = up.unionAll(down).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        edges, open_ = met.agg(F.sum("up"), F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()
        if not open_:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._burrow_path = now._burrow_path
            return out
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = stored(joined(both.where("v > u"), least, edges).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = joined(large, small, edges).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tied = stored(moved.unionAll(small.select("u", F.col("m").alias("v"))).distinct())
        drop(now)
        drop(large)
        now = tied


def joined(rows: DataFrame, sums: DataFrame, edges: int) -> DataFrame:
    """``u, v, m``: rows with the sum of their node. Nodes of over 1/256 of the edges, fewer than 1,024, are broadcast; the rest is shuffled."""
    most = max(16, edges // 256)
    hot, cold = F.broadcast(sums.where(F.col("n") > most).select("u", "m")), sums.where(F.col("n") <= most).select("u", "m")
    return rows.join(hot, "u").unionAll(rows.join(hot.select("u"), "u", "left_anti").join(cold, "u"))
