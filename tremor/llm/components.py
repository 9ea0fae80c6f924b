"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; edges are written to the shared folder after each round, so lineage stays
short and a lost executor costs one round.  Nothing but two numbers of a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import blocks as B


def _large(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Kept as a table, both sides of the join are plain exchanges, and adaptive execution can split a node with many edges.
    least = B.stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Edges run from larger a to smaller b."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    joined = e.join(least, "a")
    return joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root (smallest node of its component) for every node of an edge; edges: columns a and b, both long.

    Null ends and loops are ignored; repeated edges don't matter; no edges give an empty result.  RuntimeError if the
    labels still move after ``most`` rounds (they settle in about the logarithm of the longest path).
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = B.stored(e), None
    for _ in range(most):
        e = B.stored(_small(_large(e).distinct()).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            root = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return root.union(root.select(F.col("root").alias("node"), "root").distinct())
        before = now
    raise RuntimeError(f"components have not settled after {most} rounds")
