"""Connected components of an edge table: alternating large and small stars, each a group-by and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_by_key, materialize


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.select("a", F.col("m").alias("b")).unionByName(moved).distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """A large and a small star, written."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    low = materialize(low.select("a", F.least("a", "m").alias("m"), "n"), "least")
    total = low.agg(F.sum("n")).first()[0] or 0
    large = join_by_key(both, low, "a", "n", total).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
    out = materialize(_small_star(large), "edges")
    discard(low)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node) of every node of edges (a, b, of one type that has an order; a > b).

    Ends when each node hangs on one node that hangs on none. A node's minimum is aggregated on both
    sides of the shuffle, and the links of a node with very many neighbours are joined where they lie.
    """
    edges = materialize(edges.select("a", "b").where(F.col("a") > F.col("b")).distinct(), "edges")
    while True:
        branching = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        hanging = edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi")
        if branching.isEmpty() and hanging.isEmpty():
            break
        now = _stars(edges)
        discard(edges)
        edges = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
