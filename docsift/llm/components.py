"""Connected components by alternating large-star and small-star steps.

Both steps replace an edge set by an equally connected one with fewer hops to
the smallest node; the number of rounds grows with the logarithm of the longest
chain. Every step is an aggregate and a join on the node, so a node with very
many edges is pre-aggregated for the minimum and split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """For each node, link its larger neighbours to the smallest in its circle."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "cc-large")
    return (both.join(least, "a").filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("x"), F.col("m").alias("y")).filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """For each node, link it and its smaller neighbours to the smallest of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "cc-small")
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b")
    return moved.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` (bigint, any order, repeats and loops allowed) ->
    (node, root), ``root`` the smallest node of the component; one row per node
    that has a link to another. No links give no rows."""
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark.n == 0 or mark == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
        seen = mark
        edges = materialize(_small_star(materialize(_large_star(edges), "cc-large-star")), "cc-edges")
