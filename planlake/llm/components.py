"""Connected components of an edge table that may not fit one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlake.llm.common import cut, joinable, scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the least of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(joinable(least, "least-neighbours"), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its smaller neighbours, and itself, on the least of them."""
    least = joinable(edges.groupBy("a").agg(F.min("b").alias("m")), "least-neighbours")
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that is not the least of its component.

    edges: long columns a and b, any order, repeats and loops allowed, no nulls. component is the least node reachable.
    Alternates large and small stars until the edges stop changing. Minima are pre-aggregated before the shuffle and written before they
    are joined back, so a hot node's rows need not meet in one task and no neighbourhood is
    ever gathered. Each round ends in a reliable checkpoint.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = cut(now), None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        with scratch(edges.sparkSession):
            now = cut(_small_star(_large_star(now)))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
