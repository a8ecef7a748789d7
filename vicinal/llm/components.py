"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is an aggregate and an equi-join on the edge table; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import join_table
from vicinal.runtime import materialise, release


def _star(edges: DataFrame, total: int) -> DataFrame:
    """Each neighbour v of u linked to the least of u and its neighbours. A hub's edges stay spread over tasks."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_table(edges, least, "u", "n", total).select("u", "v", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) bigint edges to (node, root): root is the least node of the component, roots included.

    Self-loops and repeated edges do no harm; null ends are left out; no edges give no rows. The number of
    rounds grows with the logarithm of the longest chain.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = materialise(e, "edges"), None
    while True:
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        # large star: every larger neighbour points at the least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = _star(both, 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(larger, "large")
        # small star: every smaller neighbour, and the node itself, points at the least of them
        hops = _star(large, mark[0])
        small = hops.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hops.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = materialise(small, "small")
        release(e, large)
        e = nxt
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
