"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import stage, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each vertex's neighbours (large star: the greater ones; small star: all not greater) to the least."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex is either the least one of its edges or has one edge: then these name the components."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionAll(
        edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg((F.sum("up") + F.max("top")).alias("n")).where("n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Columns node, component (the least node it reaches) for all nodes of ``edges`` (a, b); loops count not.

    Each round writes its edges to the shared folder and removes those of the round before, so lineage stays short;
    rounds end once each node points to a least one, and grow with the logarithm of the longest chain.
    """
    now = stage(edges.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(now):
        turned = _star(now, large=True)
        now, old = stage(_star(turned.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), large=False)), now
        unstage(old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
