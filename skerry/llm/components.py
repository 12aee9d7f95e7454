"""Connected components of an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import forget, materialise


def state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of the edges (a, b) with the smallest node that it reaches.

    Each round is a few joins and groupings by node, written to the shared folder, where it replaces the one before;
    nothing but two sums reaches the driver. Edges with a null end, and those from a node to itself, count for nothing;
    without edges there are no nodes.
    """
    edges = materialise(edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "edges")
    before = state(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m")
        large = both.join(least, "a").filter("b > a").selectExpr("b a", "m b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").selectExpr("greatest(b, m) a", "least(b, m) b").unionByName(least.selectExpr("a", "m b")).distinct()
        older, edges = edges, materialise(small, "edges")
        forget(older)
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).selectExpr("a node", "component")
    return stars.unionByName(edges.select(F.col("b").alias("node")).distinct().join(edges.select(F.col("a").alias("node")), "node", "left_anti").selectExpr("node", "node component"))
