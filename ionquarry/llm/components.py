"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionquarry.llm.common import cut

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the undirected graph with ``edges`` (u, v): root is the smallest node reachable.

    Each round hangs every neighbour on the smallest one of its star; the rounds grow with the logarithm of the longest path. A node's
    star is reduced by a map-side minimum and joined back, so that no task holds a whole star. Nodes of any orderable
    type; loops, repeated edges and nulls are left out, and only nodes with an edge to another are returned.
    """
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), small=True)
    rows, before = edges.count(), None
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.filter("u <> m")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # no edge of a round comes of more than one edge of the one before, nor a node's own of none
        edges = cut(small.union(least).distinct(), 3 * rows)
        # done when every node hangs on one root and no root hangs on another
        now = edges.agg(F.count(F.lit(1)), F.count_distinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        rows, before = now[0], now
    raise RuntimeError(f"no components after {MOST_ROUNDS} rounds")
