"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import store


def _large_star(e: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node and its neighbours; u > v before and after."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of these."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    hung = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(e: DataFrame) -> bool:
    """Has every node one smaller neighbour at most, and no node both a smaller and a larger one?"""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``links`` (columns a, b; direction and repeats don't matter).

    The component is the smallest id reachable. A round is three aggregations and two joins, written to the shared folder; the
    rounds grow with the logarithm of the longest path, and every round but the last brings ends nearer to their smallest id, so they
    end without a limit. Links with a null end are ignored.
    """
    edges = store(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _settled(edges):
        edges = store(_small_star(_large_star(edges)), "stars")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
