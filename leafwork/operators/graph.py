"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.session import cut, forget


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node of ``edges``; component is the smallest node reached.

    Alternates large-star and small-star steps, so the rounds grow with the
    logarithm of the longest path, and no step gathers a component in one task:
    each reduces a node's neighbours to their minimum first and joins that to
    the edges. Every round is written to the checkpoint folder and the one
    before it deleted; rounds end when count and hash sum of the edges stay.
    Rows with a null end and loops name no edge, though a loop still names its node;
    repeated edges change nothing; no edges give no rows.
    """
    given = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = given.select(F.col("u").alias("node")).union(given.select("v")).distinct()
    links = cut(given.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _digest(links)
    while seen[0]:
        # Large star: every larger neighbour is tied to the smallest of all neighbours.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        # Small star: the node and its smaller neighbours are tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(low, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        now = cut(small.unionByName(low.select("u", F.col("w").alias("v"))).distinct())
        forget(links)
        links, before, seen = now, seen, _digest(now)
        if seen == before:
            break
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _digest(links: DataFrame) -> tuple:
    """Count and hash sum of the edges: equal for equal sets of edges, and not for others but by a chance of 2^-64."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
