"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repograph.llm.hot import join_counted
from repograph.stage import staged

_EDGE = ["node", "root"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (node, root), root < node, after every node has linked its neighbours to their least.

    A large star moves the greater neighbours of a node, a small star the lesser ones and the node.
    """
    around = (edges.unionByName(edges.select(F.col("root").alias("node"),
                                             F.col("node").alias("root"))) if large else edges)
    least = around.groupBy("node").agg(F.min("root").alias("least"), F.count(F.lit(1)).alias("n"))
    # Joined on the node, of which one may be next to most others.
    moved = join_counted(around, least, ["node"], "n", max(1000, around.count()), "inner")
    lowest = F.least("node", "least")
    if large:
        out = moved.filter(F.col("root") > F.col("node")).select(
            F.col("root").alias("node"), lowest.alias("root"))
    else:
        out = moved.select(F.explode(F.array(
            F.struct(F.col("root").alias("node"), lowest.alias("root")),
            F.struct(F.col("node"), lowest.alias("root")))).alias("e")).select("e.*")
    return out.filter(F.col("node") > F.col("root")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node with an edge, other than roots; the root is the least node.

    `edges` has two columns of ids in either order; loops, repeated edges and nulls do not matter.
    Each round writes its edges to the shared folder; the number of rounds grows with the logarithm
    of the graph's size.
    """
    a, b = edges.columns
    now = staged(edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct())
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64(*_EDGE).cast("decimal(20,0)")))
    before = None
    while True:
        state = now.agg(mark).first()[0]
        if state == before or state[0] == 0:
            return now
        before = state
        now = staged(_star(staged(_star(now, True)), False))
