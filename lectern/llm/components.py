"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``large``: larger neighbours of each node move to its least one, itself
    included; else its smaller ones and itself do."""
    a, b = F.greatest("u", "v"), F.least("u", "v")
    if large:
        near = edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    else:
        near = edges.select(a.alias("u"), b.alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "_u").alias("m"))
    joined = near.join(least, F.col("u") == F.col("_u"))
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def _print(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u long, v long): the least
    node it is connected to. Loops and repeated edges change nothing."""
    at = written(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), "cc-edges")
    before = _print(at)
    while True:
        last, at = at, written(_star(_star(at, large=True), large=False), "cc-stars")
        discard(last)
        now = _print(at)
        if now == before:
            break
        before = now
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
