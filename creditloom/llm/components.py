"""Connected components of a link table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of a link and the smallest node of its component.

    Alternating large-star and small-star steps: each rewires neighbours to the
    smallest one seen, so links only ever shrink towards stars, and the number of
    rounds grows with the logarithm of the longest path. Every round is written
    to the shared folder, so a lost executor repeats one round at most. Only the
    count of moved links comes to the driver. Null nodes and self-links are left
    out; an empty table has no components.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u") != F.col("v"))
    stars = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    while True:
        large = _large_star(stars)
        small = materialize(_small_star(large), "stars")
        moved = small.exceptAll(stars).limit(1).count() + stars.exceptAll(small).limit(1).count()
        stars = small
        if not moved:
            break
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(
        F.min("root").alias("root"))


def _large_star(stars: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (itself included)."""
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(
        F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    joined = stars.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
