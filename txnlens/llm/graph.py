"""Connected components on tables of links (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges ``(a, b)`` with ``a > b``.

    The least neighbour of each node is stored before the join back, so that
    the join's two sides come straight from exchanges and a node with very many
    links can be split.
    """
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    least = stored(
        around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "node"), "least"
    )
    joined = around.join(least, around["a"] == least["node"])
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("m").alias("b"))
        )
    moved = moved.where("a <> b")
    # a large step makes no more edges than it reads; repeats go with the small step
    return moved if large else moved.distinct()


def _is_flat(edges: DataFrame) -> bool:
    """Has every node one parent, and no parent a parent of its own?"""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    per_node = roles.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return per_node.where("child > 1 OR (child = 1 AND parent = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``; the component is its least node.

    The steps end when the edges are stars around least nodes, which they are
    after one round if the links are stars already.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while not _is_flat(edges):
        edges = stored(_star(stored(_star(edges, large=True), "large"), large=False), "small")
    lower = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return lower.unionByName(lower.select(F.col("component").alias("node"), "component")).distinct()
