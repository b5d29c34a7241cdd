"""Connected components of an edge table, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: the neighbours of a node (those above it, or those below it) are linked to its least neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy(F.col("a").alias("_a")).agg(F.least(F.min("b"), F.col("_a")).alias("m"))
    kept = both.filter("b > a") if large else both
    linked = kept.join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        linked = linked.unionByName(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
    return linked.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): each node of edges (a, b: long) with the least node that it reaches.

    Alternating large and small star steps (Kiveris et al., 2014). A node's neighbours are only ever reduced to
    their minimum, and a hub's rows are dealt out by the join, so no task holds a hub's neighbours. Each round's
    edges are written to the shared folder, which cuts the lineage. Nulls and loops are ignored.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now, mark = written(now, "edges"), None
    for _ in range(most_rounds):
        now = written(_star(_star(now, True), False), "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = tuple(new)
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
