"""Connected components of an edge table, by alternating star contractions.

A round links all larger neighbours of a node to its least neighbour, then all smaller ones. Only
minima are grouped, with map-side combination, so a node of any degree is fine; the join that brings a
minimum back to the edges has one row a node on one side and may be split by adaptive execution. The
driver sees two numbers a round. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); a component is named by its least node.

    Loops and edges with a null end are left out; a node with no other edge does not appear. Repeated
    edges do no harm. An empty table gives an empty result.
    """
    current = cut_lineage(edges.toDF("a", "b").where("a != b").distinct())
    mark = None
    while True:
        current = cut_lineage(_small_star(_large_star(current)))
        seen = current.select(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
        ).first()
        if seen == mark:
            break
        mark = seen
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.toDF("node", "component").union(roots)
