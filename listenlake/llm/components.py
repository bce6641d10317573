"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import stage


def _state(edges: DataFrame):
    # Exclusive or: a sum of hashes overflows from some millions of links on.
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``; the root is its component's smallest node.

    Links are longs in either direction, repeated or not; a link of a node to itself counts for
    nothing. Neighbours are reduced by map-side minimum before each join, so a node with a
    third of all links meets no single task but where AQE splits the join; every round is a
    written table.
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    before = None
    while (now := _state(edges)) != before:
        before = now
        # Large star: each node's larger neighbours are linked to its smallest neighbour.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        edges = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node and its smaller neighbours are linked to the smallest of them.
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), name)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
