"""Connected components over an edge table, in rounds of min-label star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _spread(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of every node to the smallest of them (large or small star)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not larger_only:
        both = both.filter("v <= u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")
    if larger_only:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges(u, v)`; component = smallest node.

    Alternates large-star and small-star until nothing moves, which takes about
    log(n) rounds. The smallest neighbour is a partial aggregate, so a node with a
    third of all edges costs one row per task, and every round is checkpointed.
    """
    current = cut_lineage(edges.select("u", "v").filter("u <> v").distinct())
    before = None
    while True:
        current = cut_lineage(_spread(_spread(current, True), False))
        after = _signature(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(roots)
