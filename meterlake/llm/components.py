"""Connected components of large link tables by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.storage import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node of the edges (u > v) has one smaller neighbour and no larger one, or larger ones only."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1").isEmpty()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    `links` has long columns u and v. Nothing but whether a round is the last one reaches the driver; a round
    shrinks paths to their logarithm, and each round's edges are stored, so the plan stays short. Links that
    are stars already take no round.
    """
    edges = scratch.store(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(edges):
        edges = scratch.store(_small_star(_large_star(edges)), "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return scratch.store(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")


def join_components(groups: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The (node, component) of `groups` after further links (u, v) between their components or nodes outside of them."""
    moved = components(links, scratch)
    old = (groups.join(moved.select(F.col("node").alias("component"), F.col("component").alias("moved")), "component", "left")
           .select("node", F.coalesce("moved", "component").alias("component")))
    return scratch.store(old.unionByName(moved).distinct(), "components")
