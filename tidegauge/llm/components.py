"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's greater (or, if not ``large``, smaller) neighbours, and itself, to its smallest neighbour."""
    if large:
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = seen.join(least, "u")
    if large:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # each smaller neighbour but the smallest, and the node itself, to the smallest
    return near.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) of each node that ``edges`` (``a``, ``b``: long) link to another."""
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    while True:  # each step shortens the ways to the smallest node, so it ends
        before, now = now, settle(_stars(_stars(now, True), False), "components")
        release(before)
        row = now.agg(F.count("*"), F.countDistinct("u")).first()
        # done when each node has one edge, and no edge ends where another begins
        if row[0] == row[1] and now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
