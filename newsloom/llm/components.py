"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import drop, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node points its larger (large star) or its smaller (small star) neighbours and itself to the least of them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    moved = moved.where("u <> v")
    return moved if large else moved.distinct()  # the small star that follows is not changed by repeated rows


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, which has none itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up = 1 and root = 1)").isEmpty()


def components(links: DataFrame, label: str = "cc") -> DataFrame:
    """``links``: (u bigint, v bigint). Returns (node, component) of every node that has a link to another;
    component is the smallest node reachable. Each round is a written table; a hub's neighbours meet in a map-side minimum."""
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}-edges")
    if not edges.limit(1).count():
        return edges.toDF("node", "component")
    while not _stars(edges):
        last, edges = edges, materialize(_star(_star(edges, True), False), label)
        drop(links.sparkSession, last)
    # only stars are left
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
