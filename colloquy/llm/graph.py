"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``(a, b)``; the root is the smallest node it reaches.

    Every round is aggregated before its shuffle and written out; the end is seen by a count and a
    hash of the links. Links from a node to itself say nothing and name no node.
    """
    edges = stored(_ordered(links.select("a", "b")), "links")
    seen = _digest(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _ordered(both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")))
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        kept = least.select(F.col("m").alias("a"), "b")
        edges = stored(_ordered(small.union(kept)), "links")
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
