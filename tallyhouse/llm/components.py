"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.shared import staged


def _large(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest one."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(least, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        .distinct()
    )


def _small(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    tied = pairs.join(least, "a").where(F.col("b") != F.col("m"))
    return (
        tied.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b")))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); the root is the component's smallest node.

    Loops are ignored. Each round is staged on shared storage; only a count and a checksum of it
    go to the driver. Rounds grow with the logarithm of the longest chain.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs, before = staged(pairs.distinct(), "edges"), None
    while True:
        sums = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now = tuple(pairs.agg(F.count("*"), sums).first())
        if now == before or now[0] == 0:
            break
        before, pairs = now, staged(_small(_large(pairs)), "edges")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
