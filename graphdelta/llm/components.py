"""Connected components of an edge table by alternating large and small stars, in Spark alone.

Each round is two grouped passes over the edges; edges and labels never leave the executors. Rounds grow with the logarithm
of the longest path. A hub's least neighbour comes from partial aggregation, and goes back to its edges by a broadcast of the hubs
(hub_join), so that they never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdelta.llm._common import discard, hub_join, materialize


def _star(edges: DataFrame, small: bool, total: int) -> DataFrame:
    """Large star: each vertex links its larger neighbours to the least of itself and all its neighbours. Small star: each
    vertex links its smaller neighbours and itself to the least of them."""
    if small:
        both = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("n"))
    else:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("n")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("n")))
    least = both.groupBy("v").agg(F.min("n").alias("m"), F.count("*").alias("times")).select("v", F.least("v", "m").alias("m"), "times")
    joined = hub_join(both, least, ["v"], "times", 2 * total)
    if small:
        out = joined.select(F.col("n").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.where(F.col("n") > F.col("v")).select(F.col("n").alias("a"), F.col("m").alias("b"))
    return out.where(F.col("a") != F.col("b"))  # repeats may stay: the next star groups them


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id and component (the least id reachable) for every id of the edges (a, b); ids without an edge are not listed.
    Edges of a null or of an id with itself are ignored."""
    now = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen, total = None, now.count()
    for _ in range(most_rounds):
        large = materialize(_star(now, False, total).distinct(), "edges")  # no star gives more edges than it takes
        after = materialize(_star(large, True, total).distinct(), "edges")
        discard(now, large)
        now = after
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        total = state[0]
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("id"), F.col("b").alias("component")))
