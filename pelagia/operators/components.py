"""Distributed union-find: connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged, staged_alone


def _contracted(edges: DataFrame) -> DataFrame:
    """One round: larger neighbours move to the smallest neighbour of a node, then smaller ones do."""
    apart = lambda df: df.where("u <> v").distinct()
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = apart(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return apart(small.union(low.select("u", F.col("m").alias("v"))))


def _settled(edges: DataFrame) -> bool:
    """Whether all edges lead from a node without another one to a node that none leads from."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    odd = ends.groupBy("u").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 or (out > 0 and into > 0)")
    return not odd.take(1)


def _stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    """The staged edges (node, smallest node of its component)."""
    ends = edges.where("u is not null and v is not null and u <> v")
    now = staged(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            return now
        now = staged(_contracted(now), "contracted")
    raise RuntimeError("components did not settle")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (u, component) for the nodes of the undirected edges (u, v): ``component`` is the smallest node that can be reached.

    Nodes of any ordered type. Alternating large-star and small-star contraction as joins and grouped minima; each round is staged and
    all are deleted at the end, so nothing is gathered. Nodes without an edge to another node have no row; null ends are
    ignored. Jobs run while this is called.
    """

    def labels() -> DataFrame:
        found = _stars(edges, max_rounds).select("u", F.col("v").alias("component"))
        return found.union(found.select(F.col("component").alias("u"), "component").distinct())

    return staged_alone(labels, edges.sparkSession, "components")
