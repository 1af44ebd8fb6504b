"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them. Edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node that has an edge to a smaller one; component is the smallest node reachable.

    edges: a, b (bigint, any order, repeats allowed). Each round's edges are
    written to the shared folder and the round before is deleted; rounds end
    when the edges no longer change, which their count and a sum of hashes
    tell. All work is by shuffles of edges; the driver sees two numbers a round.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = scratch.write(edges.select(a.alias("a"), b.alias("b")).filter("a <> b").distinct(), f"{name}0")
    seen, n = None, 0
    while True:
        sign = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if sign == seen or not sign[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen, n = sign, n + 1
        now = scratch.write(_small_star(_large_star(now)), f"{name}{n}")
        scratch.drop(f"{name}{n - 1}")
