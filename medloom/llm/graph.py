"""Connected components by hooking and contraction, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Times that each round follows parents of parents.
JUMPS = 2


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for edges (a, b) of longs: root is the smallest node reachable.

    Each round hooks every root to its smallest smaller neighbour, follows the parents
    and contracts the edges to the new roots, until no edge is left: about the
    logarithm of the longest path. All joins are between kept tables, so AQE can split
    a root that a third of the nodes share.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    edges = scratch.keep(edges.select(hi, lo).where("hi <> lo").distinct())
    nodes = edges.select(F.col("hi").alias("node")).union(edges.select("lo")).distinct()
    labels = scratch.keep(nodes.select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        hooks = scratch.keep(edges.groupBy("hi").agg(F.min("lo").alias("up")))
        for _ in range(JUMPS):
            above = hooks.select(F.col("hi").alias("up"), F.col("up").alias("higher"))
            jumped = scratch.keep(hooks.join(above, "up", "left").select("hi", F.coalesce("higher", "up").alias("up")))
            scratch.drop(hooks)
            hooks = jumped
        moved = scratch.keep(labels.join(hooks.withColumnRenamed("hi", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        ends = edges.join(hooks.withColumnRenamed("up", "a"), "hi").select("a", "lo")
        ends = ends.join(hooks.select(F.col("hi").alias("lo"), F.col("up").alias("higher")), "lo", "left").select("a", F.coalesce("higher", "lo").alias("b"))
        contracted = scratch.keep(ends.select(hi, lo).where("hi <> lo").distinct())
        scratch.drop(hooks, labels, edges)
        labels, edges = moved, contracted
    return labels
