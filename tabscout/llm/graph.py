"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabscout.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """For each node the least of its neighbours and itself is linked to its neighbours: to the larger ones, seen
    from either end of a link (large), or to the smaller ones and the node itself (small)."""
    if large:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a")))
    else:
        near = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    # A node with very many links is a skewed key of this join, which adaptive execution splits.
    joined = near.join(least, F.col("u") == F.col("w"))
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("w"), F.col("m")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def _state(links: DataFrame) -> tuple:
    """Count and order-free check sum of the links."""
    digest = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.sum(F.shiftright(digest, 32)), F.sum(digest.bitwiseAND(0xFFFFFFFF))).first())


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) long. Returns (node, least) for every node that has a link to another: its component's least
    node. Each round is written to shared space; rounds grow with the logarithm of the nodes."""
    links = written(links.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    before = None
    while before != (before := _state(links)):
        links = written(_star(_star(links, True), False))
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("least"))
    return stars.union(stars.select(F.col("least"), F.col("least"))).distinct()
