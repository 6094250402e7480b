"""Connected components of an edge table by alternating large and small stars.

Each round replaces edges by edges to the least neighbour seen, as in the published
large-star/small-star algorithm; it ends when no edge changes, after about log n rounds.
Every round is two aggregations and two equi-joins over the edges, staged in the shared
folder; nothing is gathered in one place.  The edges of a node that has many, as the centre of a
large star, are dealt evenly, and its least neighbour is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import shared


def _large(edges: DataFrame, rows: int) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    moved = shared.join_counted(both.filter("b > a"), least, ["a"], 2 * rows)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small(edges: DataFrame, rows: int) -> DataFrame:
    """A node and its lesser neighbours move to the least of them; here a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = shared.join_counted(edges, least, ["a"], rows).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for the nodes of ``edges`` (columns a, b): the least node that each reaches.

    Loops and repeated edges are allowed; a node with loops only is its own component and
    has no row; an edge with a null end is ignored.  More than ``max_rounds`` rounds are an error.
    """
    spark = edges.sparkSession
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = shared.stage(now, "edges")
    mark = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        large, large_path = shared.stage(_large(now, seen[0]), "edges")
        after, new_path = shared.stage(_small(large, seen[0]), "edges")
        shared.drop(spark, path)
        shared.drop(spark, large_path)
        now, path = after, new_path
    else:
        raise RuntimeError(f"components were still changing after {max_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
