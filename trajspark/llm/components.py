"""Connected components of a graph by alternating large and small stars, all on DataFrames.

Every round replaces each edge by edges to the least neighbour, so that each component becomes a star around
its least node in a few rounds, however long its chains are. Both steps aggregate before they join, and no
node's neighbours are ever collected. Rounds are cut by checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import checkpointed

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _content(edges: DataFrame) -> tuple:
    """Number of edges and two exact sums of independent hashes: equal only for the same edges (by chance 1 in 2^128)."""
    wide = lambda h: F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0))
    return tuple(edges.agg(F.count("*"), wide(F.xxhash64("u", "v")), wide(F.xxhash64("v", F.lit(1), "u"))).first())


def star_components(links: DataFrame) -> DataFrame:
    """links(u, v) of longs -> (node, component): the least node that each linked node reaches."""
    edges = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = _content(edges)
    for _ in range(MAX_ROUNDS):
        edges = checkpointed(_small_star(_large_star(edges)))
        seen, mark = mark, _content(edges)
        if seen == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
