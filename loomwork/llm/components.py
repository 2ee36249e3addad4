"""Connected components of an edge table, on the executors: alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import stored


def connected(edges: DataFrame, scratch: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the component's least node.

    Each step replaces a node's edges by edges to the least node it sees, so hubs are only ever one side of a join,
    and the number of steps grows with the logarithm of the component's size. Self-loops and repeated edges are ignored.
    scratch notes the tables that the result is read from; rows bounds the edges."""
    now = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", scratch, rows)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges", scratch, rows)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        state = tuple(seen)
