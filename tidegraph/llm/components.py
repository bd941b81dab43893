"""Connected components by alternating large-star and small-star rounds.

Every round is a minimum per node (a partial aggregate, so hubs shrink before the
shuffle) and an equi-join back to the edges, whose other side is unique per node, so
adaptive execution can split a hub.  No node's neighbours are ever gathered in a row.
Rounds are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

MAX_ROUNDS = 100


def _is_star(edges: DataFrame) -> bool:
    """Whether every node with smaller neighbours has just one, which has none itself."""
    if not edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
        return False
    return edges.groupBy("u").count().where("count > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v); the component is its smallest node.

    Loops, repeated edges and null ends are ignored.
    """
    kept = edges.where(F.col("u") != F.col("v"))
    now = materialise(kept.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _is_star(now):
            break
        # large star: everything greater than a node moves to the smallest of its neighbourhood
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "edges")
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(
            moved.select("u", F.col("m").alias("v")))
        now = materialise(small.distinct(), "edges")
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
