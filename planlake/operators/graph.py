"""Graphs that are tables of edges, of any size: layers, cycles, widths and longest ways, by joins of a frontier with the edges.

What ``plan`` does within a row for graphs of some tens of nodes, these do for graphs whose edges fill many files, and for many graphs at once. A layer holds
the nodes all of whose parents are in earlier ones. Each round takes the frontier out and counts, with partial aggregation, how many parents each child has lost; a
child that has lost all is in the next. Nodes that never come free are on or behind a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlake.functions.nested import ratio
from planlake.sources.folders import written


def layers(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1_000_000) -> DataFrame:
    """(graph, node, layer), layer from 0, null on or behind a cycle, for nodes (graph, node) and edges (graph, src, dst).

    Repeated nodes and edges count once; edges from unknown nodes constrain nothing, and those to unknown nodes are nobody's. A round costs the frontier and what it
    points to; there is one for each layer.
    """
    nodes = written(nodes.select("graph", "node").distinct(), "graph-nodes")
    known = nodes.select(F.col("graph").alias("k_graph"), F.col("node").alias("k_node"))
    both = edges.select("graph", "src", "dst").distinct()
    both = both.join(known, (F.col("graph") == F.col("k_graph")) & (F.col("src") == F.col("k_node")), "left_semi")
    both = written(both.join(known, (F.col("graph") == F.col("k_graph")) & (F.col("dst") == F.col("k_node")), "left_semi"), "graph-edges")
    parents = written(both.groupBy("graph", F.col("dst").alias("node")).agg(F.count("*").alias("n")), "graph-parents")
    frontier = written(nodes.join(parents, ["graph", "node"], "left_anti").withColumn("layer", F.lit(0)), "graph-layer")
    placed, lost = frontier, None
    for k in range(1, max_rounds):
        front = frontier.select(F.col("graph").alias("f_graph"), F.col("node").alias("f_node"))
        freed = both.join(front, (F.col("graph") == F.col("f_graph")) & (F.col("src") == F.col("f_node"))).groupBy("graph", F.col("dst").alias("node")).agg(F.count("*").alias("less"))
        lost = freed if lost is None else lost.union(freed).groupBy("graph", "node").agg(F.sum("less").alias("less"))
        met = written(lost.join(parents, ["graph", "node"]), "graph-lost")
        frontier = written(met.where("less = n").select("graph", "node", F.lit(k).alias("layer")), "graph-layer")
        if frontier.isEmpty():
            break
        lost = met.where("less < n").select("graph", "node", "less")
        placed = placed.union(frontier)
        if k % 20 == 0:
            placed = written(placed, "graph-placed")
    return nodes.join(placed, ["graph", "node"], "left")


def measures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, n_nodes, cyclic, longest, width, parallel) of each graph; the last three are 0 for one with a cycle, as within a row."""
    placed = layers(nodes, edges)
    widths = placed.groupBy("graph", "layer").agg(F.count("*").alias("n"))
    by_graph = widths.groupBy("graph").agg(F.sum("n").alias("n_nodes"), F.bool_or(F.col("layer").isNull()).alias("cyclic"), (F.max("layer") + 1).alias("depth"), F.max("n").alias("most"))
    longest = F.when(F.col("cyclic"), 0).otherwise(F.col("depth"))
    return by_graph.select("graph", "n_nodes", "cyclic", longest.cast("long").alias("longest"), F.when(F.col("cyclic"), 0).otherwise(F.col("most")).alias("width"), (1 - ratio(longest, F.col("n_nodes"))).alias("parallel"))


def on_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, node) of the nodes on a cycle, or between two: neither forwards nor backwards does their turn come."""
    ahead = layers(nodes, edges).where("layer IS NULL").select("graph", "node")
    ahead = written(ahead, "graph-stuck")
    back = layers(ahead, edges.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return back.where("layer IS NULL").select("graph", "node")
