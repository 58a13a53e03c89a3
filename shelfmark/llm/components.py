"""Connected components of a link table, by rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import pin


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest one in reach."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    lower = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """Smallest node that each linked node can reach.

    ``links`` has two bigint columns ``u`` and ``v``.  Large-star and small-star rounds alternate
    until no edge changes; the number of rounds grows with the logarithm of a component's size.
    Each round is written to the shared scratch folder, so a lost executor costs one round, and
    only a count and two checksums come back to the driver.  A node of many links is summarised
    by a map-side minimum, never gathered.

    Returns ``node, root`` for every node that is not itself the smallest of its component.
    Links with a null end or from a node to itself join nothing.
    """
    edges = pin(links.select("u", "v").filter("u != v"), "links")
    seen = None
    while True:
        edges = pin(_small_star(_large_star(edges)), "star")
        now = _mark(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
