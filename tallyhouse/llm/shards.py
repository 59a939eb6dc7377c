"""Uniform shuffle into shards of exact sizes by a communication matrix.

The rows of n/R input parts go to n/R target blocks. First the counts are drawn: how many
rows each part sends to each block, jointly distributed as in a uniform permutation
(multivariate hypergeometric). Then each part permutes its rows on its own and deals them out by
its row of the matrix, the rows are exchanged, and each block permutes what it got. A shard
is a run of blocks, so no task holds a whole shard. Law: ``rows`` (counts at most one apart).

Only DataFrame expressions are used. Each draw inverts the hypergeometric distribution with
a uniform number from a hash; weights are summed over nine deviations around the mode, which
is the whole distribution in double precision.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.llm.shared import bound, staged

ROW = "_row"


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on ``keys`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` rows are marked when ``marked`` of ``total`` rows are."""

    def ranged(v: Column) -> Column:
        mean = v.m * v.K / F.greatest(v.N, F.lit(1.0))
        spread = F.sqrt(
            F.greatest(
                mean * (v.N - v.K) * (v.N - v.m) / F.greatest(v.N * (v.N - 1), F.lit(1.0)),
                F.lit(0.0),
            )
        )
        mode = F.floor((v.m + 1) * (v.K + 1) / (v.N + 2)).cast("double")
        reach = F.ceil(spread * 9).cast("double") + 12
        return F.struct(
            v.K.alias("K"),
            v.m.alias("m"),
            (v.N - v.K - v.m).alias("rest"),
            F.greatest(F.lit(0.0), v.m - (v.N - v.K), mode - reach).cast("long").alias("first"),
            F.least(v.K, v.m, mode + reach).cast("long").alias("last"),
        )

    def weighed(v: Column) -> Column:
        steps = F.when(
            v.last > v.first, F.sequence(v.first, F.greatest(v.last - 1, v.first))
        ).otherwise(F.expr("cast(array() as array<bigint>)"))
        weights = F.aggregate(
            steps,
            F.array(F.lit(1.0)),
            lambda s, k: F.concat(
                s,
                F.array(
                    F.element_at(s, -1) * (v.K - k) * (v.m - k) / ((k + 1.0) * (v.rest + k + 1.0))
                ),
            ),
        )
        return F.struct(v.first.alias("first"), weights.alias("weights"))

    def inverted(v: Column) -> Column:
        goal = u * F.aggregate(v.weights, F.lit(0.0), lambda t, w: t + w)
        return v.first + F.aggregate(
            v.weights,
            F.struct(goal.alias("open"), F.lit(-1).cast("long").alias("x")),
            lambda s, w: F.struct(
                (s.open - w).alias("open"), (s.x + (s.open >= 0).cast("long")).alias("x")
            ),
            lambda s: s.x,
        )

    given = F.struct(
        total.cast("double").alias("N"),
        marked.cast("double").alias("K"),
        drawn.cast("double").alias("m"),
    )
    return bound(bound(bound(given, ranged), weighed), inverted)


def split_columns(columns: Column, drawn: Column, *keys: Column) -> Column:
    """Of ``columns`` (rows left for each block), those that go to ``drawn`` rows."""
    return F.aggregate(
        F.sequence(F.lit(0), F.size(columns) - 1),
        F.struct(
            F.aggregate(columns, F.lit(0).cast("long"), lambda a, c: a + c).alias("left"),
            drawn.alias("open"),
            F.expr("cast(array() as array<bigint>)").alias("got"),
        ),
        lambda s, j: bound(
            hypergeometric(s.left, F.get(columns, j), s.open, uniform(*keys, j)),
            lambda x: F.struct(
                (s.left - F.get(columns, j)).alias("left"),
                (s.open - x).alias("open"),
                F.concat(s.got, F.array(x)).alias("got"),
            ),
        ),
        lambda s: s.got,
    )


def communication_matrix(counts: DataFrame, blocks: Column, n_parts: int, seed: int) -> DataFrame:
    """(part, sends): rows that each part sends to each block, in block order.

    ``counts`` has (part, n). Parts are halved again and again; each half's share of every
    block is drawn from what its parent held, so nodes of one level are drawn side by side.
    """
    nodes = (
        counts.groupBy()
        .agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"))
        .where(F.size("parts") > 0)
        .select("parts", blocks.alias("columns"))
    )
    for level in range(math.ceil(math.log2(max(n_parts, 2)))):
        if level % 3 == 2:
            nodes = nodes.repartition(F.col("parts")[0].part)
        half = F.floor(F.size("parts") / 2).cast("int")
        left = F.slice("parts", F.lit(1), half)
        drawn = F.aggregate(left, F.lit(0).cast("long"), lambda a, p: a + p.n)
        nodes = nodes.withColumn(
            "got",
            F.when(
                F.size("parts") > 1,
                split_columns(
                    F.col("columns"), drawn, F.lit(seed), F.lit(level), F.col("parts")[0].part
                ),
            ),
        )
        nodes = nodes.select(
            F.explode(
                F.when(
                    F.size("parts") > 1,
                    F.array(
                        F.struct(left.alias("parts"), F.col("got").alias("columns")),
                        F.struct(
                            F.slice("parts", half + 1, F.size("parts")).alias("parts"),
                            F.zip_with("columns", "got", lambda c, g: c - g).alias("columns"),
                        ),
                    ),
                ).otherwise(F.array(F.struct("parts", "columns")))
            ).alias("node")
        ).select("node.parts", "node.columns")
    return nodes.select(F.col("parts")[0].part.alias("part"), F.col("columns").alias("sends"))


def into_shards(df: DataFrame, n_shards: int, seed: int = 42, least_block: int = 1024) -> DataFrame:
    """``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in a shard).

    The permutation of all rows is uniform and shard counts are at most one apart. A block holds
    about max(least_block, 4*sqrt(n), n/2048) rows of one shard. ``df`` is staged once on shared
    storage with a row number, so the draw, the local permutations and the exchange agree
    even if tasks are run again; give only the columns to be carried. Null keys, empty or
    null texts and repeated rows are rows like any other; an empty table gives no row.
    """
    carried = df.columns
    rows = staged(df.withColumn(ROW, F.monotonically_increasing_id()), "shards")
    n = rows.count()
    per_block = max(least_block, 4 * math.isqrt(n), n // 2048)
    per_shard = max(1, math.ceil(n / n_shards / per_block))
    n_parts = max(1, math.ceil(n / per_block))
    n_blocks = n_shards * per_shard

    block = F.col("block").cast("long")

    def shard_rows(shard: Column) -> Column:
        return F.lit(n // n_shards) + (shard < n % n_shards).cast("long")

    def block_rows(b: Column) -> Column:
        size = shard_rows(F.floor(b / per_shard))
        return F.floor(size / per_shard) + (b % per_shard < size % per_shard).cast("long")

    blocks = F.transform(
        F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")), block_rows
    )
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(ROW)), F.lit(n_parts)).cast("int")
    dealt = rows.withColumn("_part", part)
    counts = dealt.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("n"))
    matrix = staged(communication_matrix(counts, blocks, n_parts, seed + 1), "matrix")
    cells = matrix.select("part", F.posexplode("sends").alias("block", "sent"))
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        cells.withColumn("begin", F.coalesce(F.sum("sent").over(before), F.lit(0)))
        .where("sent > 0")
        .select(
            F.col("part").alias("_part"),
            F.col("block").alias("_block"),
            F.explode(F.sequence(F.col("begin") + 1, F.col("begin") + F.col("sent"))).alias("_turn"),
        )
    )
    locally = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed + 2), ROW), ROW)
    turned = dealt.withColumn("_turn", F.row_number().over(locally).cast("long"))
    arrived = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed + 3), ROW), ROW)
    block = F.col("_block").cast("long")
    shard = F.floor(block / per_shard)
    inside, size = block % per_shard, shard_rows(shard)
    begins = inside * F.floor(size / per_shard) + F.least(inside, size % per_shard)
    return (
        turned.join(places.hint("merge"), ["_part", "_turn"])  # one place a row: never broadcast
        .withColumn("_place", F.row_number().over(arrived).cast("long"))
        .select(
            *[F.col(c) for c in carried],
            shard.cast("int").alias("shard"),
            (begins + F.col("_place") - 1).cast("long").alias("slot"),
        )
    )


def op2_hypergeometric_shards(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """All ``documents`` in 40 shards, law ``rows``. A null text has size 16 and crc32 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return into_shards(facts, n_shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
