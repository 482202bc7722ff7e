"""Reachability over edge tables: sets by frontier, hops with a shared visited set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut

#: Rounds after which what is known is written as one table again.
PARTS = 8


def reach(edges: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(seed, node, depth): all nodes each seed reaches over edges (src, dst), itself included at depth 0.

    One frontier join per round against what is already known; cycles end by themselves. Only the new pairs travel.
    """
    known = cut(seeds.select("seed", "node").distinct().withColumn("depth", F.lit(0)))
    frontier = known
    steps = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    for depth in range(1, max_rounds + 1):
        new = frontier.join(steps, frontier.node == steps.src).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(new.join(known, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            return known
        known = known.union(frontier) if depth % PARTS else cut(known.union(frontier))
    raise RuntimeError(f"still growing after {max_rounds} rounds")


def neighbourhood(edges: DataFrame, origins: DataFrame, upstream: int, downstream: int) -> tuple[DataFrame, DataFrame]:
    """((origin, node, depth), (origin, edge)): out over ``downstream`` hops, then in over ``upstream`` hops from the origin, with one visited set: what the first walk found is not walked from again."""
    spark = edges.sparkSession
    start = origins.select("origin", F.col("origin").alias("node"), F.lit(0).alias("depth"))
    nodes, touched = start, spark.createDataFrame([], "origin string, edge string")
    e = edges.select(F.col("id").alias("edge"), "source", "target")
    for near, far, hops in (("source", "target", downstream), ("target", "source", upstream)):
        frontier = start
        for depth in range(1, hops + 1):
            met = frontier.join(e, F.col("node") == F.col(near)).select("origin", "edge", F.col(far).alias("node"))
            touched = touched.union(met.select("origin", "edge"))
            frontier = cut(met.select("origin", "node").distinct().join(nodes, ["origin", "node"], "left_anti").withColumn("depth", F.lit(depth)))
            nodes = nodes.union(frontier)
    return nodes, touched.distinct()
