"""Exact sizes, gapless slots, and counts distributed as a uniform shuffle has them."""

from collections import Counter

from pyspark.sql import functions as F

from llm_cases import EDGES
from tallyhouse.llm import shards


def test_sizes_and_slots(spark):
    df = spark.range(5003).select(F.col("id").alias("doc_id"))
    rows = shards.into_shards(df, 7, least_block=200).collect()
    assert sorted(r.doc_id for r in rows) == list(range(5003))
    sizes = Counter(r.shard for r in rows)
    assert sorted(sizes) == list(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def test_shuffle_is_uniform(spark):
    """Over seeds, each row is in each shard equally often, and order in a shard is free of it."""
    n, k, seeds = 600, 4, 3
    seen, slots = Counter(), []
    for seed in range(seeds):
        df = spark.range(n).select(F.col("id").alias("doc_id"))
        for r in shards.into_shards(df, k, seed=seed * 101, least_block=40).collect():
            seen[r.doc_id // 150, r.shard] += 1
            slots.append((r.doc_id, r.slot))
    expected = seeds * 150 / k
    assert all(abs(seen[a, s] - expected) < 5 * expected**0.5 for a in range(4) for s in range(k))
    mean = sum(s for _, s in slots) / len(slots)
    low = [s for d, s in slots if d < 150]
    assert abs(sum(low) / len(low) - mean) < 7


def test_draws_follow_the_hypergeometric_law(spark):
    u = shards.uniform(F.lit(1), F.col("id"))
    drawn = spark.range(20_000).select(
        shards.hypergeometric(F.lit(30), F.lit(12), F.lit(10), u).alias("x")
    )
    counts = {r.x: r["count"] for r in drawn.groupBy("x").count().collect()}
    from math import comb

    for x in range(11):
        p = comb(12, x) * comb(18, 10 - x) / comb(30, 10)
        assert abs(counts.get(x, 0) / 20_000 - p) < 5 * (p * (1 - p) / 20_000) ** 0.5 + 1e-4


def test_edges(documents):
    rows = shards.op2_hypergeometric_shards(documents(EDGES)).collect()
    assert len(rows) == len(EDGES)
    empty = [r for r in rows if r.doc_id in (1, 2)]
    assert {(r.size, r.text_crc32) for r in empty} == {(16, 0)}
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert shards.op2_hypergeometric_shards(documents([])).collect() == []
