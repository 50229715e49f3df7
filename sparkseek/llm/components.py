"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm.common import cut, scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b): component is the smallest node that it is connected with.

    Edges in any direction, repeated, or of a node with itself are fine; edges with a null end are left out. A node of
    any degree is spread over tasks: minima are pre-aggregated, and the table of minima is written out before it is
    joined, so that a skewed join can be split. Rounds grow with the logarithm of the nodes."""
    with scratch(edges.sparkSession) as keep:
        nodes_alone = edges.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"))
        forest = cut(
            edges.where(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
        state = None
        while True:
            now = forest.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
            if now == state or now[0] == 0:
                break
            state = now
            both = forest.union(forest.select("b", "a"))
            least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m")))
            large = cut(both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
            least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
            small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            forest = cut(small.union(least).distinct())
        roots = forest.select(F.col("b").alias("node")).union(nodes_alone).distinct().join(forest.select(F.col("a").alias("node")), "node", "left_anti")
        return keep(forest.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component"))))
