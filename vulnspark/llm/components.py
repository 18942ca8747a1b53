"""Connected components of a link table: distributed union-find by alternating stars.

A large-star step hangs every larger neighbour of a node below the smallest
node it knows; a small-star step does so for the smaller ones. Both are a
partial minimum and an equi-join, so a node with very many links is
combined before the shuffle and its join partition can be split. They
alternate until no link changes; the rounds grow with the logarithm of the
longest chain. Every round is a written table, so a lost executor costs one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnspark.llm.common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` has v below u by size; returns links (u, v) with v the smallest known."""
    if large:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
    return moved.filter("u > v").distinct()


def _mark(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) for each node that has a link to another."""
    rows = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links")
    mark = _mark(rows)
    while mark[0]:
        rows = stored(_star(_star(rows, True), False), "links")
        before, mark = mark, _mark(rows)
        if mark == before:
            break
    return rows.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        rows.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
