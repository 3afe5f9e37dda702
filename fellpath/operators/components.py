"""Connected components by contraction, for graphs of any shape and degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellpath.plans.staging import materialise


def _through(rows: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by its parent, where it has one."""
    look = parent.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return rows.join(look, rows[column] == look["_n"], "left").withColumn(column, F.coalesce("_r", column)).drop("_n", "_r")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Every node that has an edge to another, with the smallest node it reaches.

    ``edges`` are undirected; loops, repeats and null ends have no effect.
    Result: ``node``, ``root``, one row per node; isolated nodes are absent.

    Each round hooks every node to its smallest neighbour, follows the hooks to
    their ends by pointer jumping, and contracts the edges to those ends. Every
    round at least halves the nodes of each component that still has edges, and
    the hooks of a round are followed in a logarithmic number of joins, so long
    chains need as few rounds as stars. The smallest node of a component is
    never hooked and is thus its root.
    """
    apart = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edge = materialise(apart.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges")
    mapping = edge.select(F.col("u").alias("node")).union(edge.select("v")).distinct().select("node", F.col("node").alias("root"))
    while not edge.isEmpty():
        parent = materialise(edge.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")), "parents")
        while True:
            look = parent.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            jumped = materialise(parent.join(look, parent["root"] == look["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "jumps")
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        mapping = materialise(_through(mapping, "root", parent), "components")
        edge = materialise(_through(_through(edge, "u", parent), "v", parent).where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    return mapping
