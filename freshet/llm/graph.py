"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` (longs) -> ``node, component``: the smallest node that can be reached.

    Alternating large-star and small-star steps: each node's neighbours are hooked to the
    smallest of them, first those above the node, then those below it.  The number of rounds
    grows with the logarithm of the largest component.  Only minima are aggregated, which
    combine before the shuffle; a node with very many neighbours is split by the skew join.
    Nodes without an edge are not returned; null ends are ignored.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(
        F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))
    )
    edges = cut(edges.distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        hooked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = cut(hooked.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(
        stars.select(F.col("component").alias("node"), "component").distinct()
    )
