"""Connected components of links by alternating large and small stars: union-find without a global forest.

Each round hangs every node's larger neighbours below its smallest neighbour, then every node and its smaller
neighbours below the smallest of them; path lengths shrink as with path compression. Rounds work by joins and
minima only, whose hot keys Spark pre-aggregates or splits, and end when nothing changes. Every round is settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import settle


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of links (a, b) but the roots themselves."""
    edges = settle(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _print(edges)
    while seen[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _print(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
