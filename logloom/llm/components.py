"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations with map-side combining and joins on the node; no neighbourhood
is ever collected into one row. Rounds are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged, unstaged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v). Large star: neighbours above u move to the least of u's neighbourhood; small star: those below, and u."""
    near = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:  # u: the larger end
        near = near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("u", "m"))
    joined = near.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of edges (u, v); component is the least node reachable."""
    now = staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = print_of(now)
    for _ in range(rounds):
        last, now = now, staged(_star(_star(now, True), False), label)
        unstaged(last)
        mark = print_of(now)
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
    raise RuntimeError(f"no fixed point in {rounds} rounds")
