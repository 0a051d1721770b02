"""Connected components by alternating star steps on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import saved

ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the edges (a, b) can reach.
    Nodes that are their own root are left out."""
    edges = saved(edges.select("a", "b").filter("a <> b"), "component-edges")
    before = None
    for _ in range(ROUNDS):
        edges = saved(_small_star(_large_star(edges)), "component-edges")
        mark = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
    raise RuntimeError("components did not settle")
