"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careloom.session import cut_lineage


#: Edges that a task of a round gets about: a small graph isn't spread over hundreds of tasks and files.
EDGES_PER_TASK = 8192


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of an edge.

    Loops and repeated edges are harmless; edges with a null end are left out. Every round is
    checkpointed; the rounds end when the edges no longer change, at stars around the roots.
    A node with very many neighbours is only ever a join key, which adaptive execution splits.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    loops = now.filter("a = b").select(F.col("a").alias("node"), F.col("b").alias("root"))
    now = cut_lineage(now.filter("a <> b").distinct())
    before = None
    while True:
        # an edge list is a forest of stars once no root hangs on another node
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == before or not mark[0]:
            break
        before = mark
        tasks = -(-mark[0] // EDGES_PER_TASK)
        now = cut_lineage(small_star(large_star(now.coalesce(tasks)).coalesce(tasks), tasks).coalesce(tasks))
    hung = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = hung.select(F.col("root").alias("node"), "root").distinct()
    return hung.unionByName(roots).unionByName(loops.join(hung, "node", "left_anti")).distinct()
