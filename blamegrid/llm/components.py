"""Connected components of a graph given as a table of edges.

Alternating large-star and small-star steps: every node hands its larger (then its smaller) neighbours
to the smallest node it knows, until all edges lead straight to the smallest node of their component.
The steps are joins and minima per node; a node's neighbours are never gathered in one row, so hubs with
very many links only make a skewed join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _hand_over(edges: DataFrame, symmetric: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if symmetric:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    known = both.join(least, F.col("u") == F.col("n"))
    if symmetric:
        return known.filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = known.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return moved.filter(F.col("a") != F.col("b")).distinct()


def _is_star(edges: DataFrame) -> bool:
    """True if every node has one edge to a smaller one that has none, or only edges from larger ones."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count(F.lit(1)).alias("n"))
    return nodes.filter("up > 1 OR up = 1 AND n > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges(a, b)`` but loops; a component is named by its smallest node."""
    kept = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = materialize(kept.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_star(now):
        before, now = now, materialize(_hand_over(_hand_over(now, True), False), "edges")
        discard(before)
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
