"""Connected components over DataFrames by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, swept


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or the others and itself) joined to the least of all it sees."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    out = joined.where("v > u" if large else "true").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a node that has none: nothing is left to join."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    with swept(edges.sparkSession):
        return seen.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (u, v); label is the component's least node.

    Nodes are of any type with an order.  Each round is a written table, so a
    lost executor costs one round at most; the rounds grow with the logarithm
    of the longest path.  Grouping by node combines before the shuffle and the
    join back is one that Spark can split, so a node may hold any share of edges.
    """
    cur = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while not _are_stars(cur):
        done, cur = cur, materialize(_star(_star(cur, True), False), "edges")
        discard(done)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
