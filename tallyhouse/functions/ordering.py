"""Ordering, ranking and running totals that hold up when one key is huge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Keys are counted in so many buckets; one with more rows than ``MOST`` is not sorted in one task.
BUCKETS, MOST = 1 << 16, 1_000_000


def newest(*columns: str) -> list[Column]:
    """Descending keys with NULLs first, the order of the source system's lists."""
    return [F.col(c).desc_nulls_first() for c in columns]


def by_label(*columns: str) -> list[Column]:
    """Ascending keys with NULLs last."""
    return [F.col(c).asc_nulls_last() for c in columns]


def top_n_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key. Spark cuts every input partition to ``n``
    rows per key before the shuffle (WindowGroupLimit), so a hot key sends little."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def split_buckets(df: DataFrame, keys: list[str], segment: list[str], *measures: Column) -> DataFrame:
    """The hash buckets of keys that hold more than ``MOST`` rows: at most ``BUCKETS`` numbers, from partial
    counts. A bucket with a NULL key is listed as well, its segments are totalled apart; so is a NULL in one
    of several segment columns, or in a measure, which leaves the total open up to the segment's first value.
    A single segment column is no case apart: its NULL rows come first anyway."""
    parts = [F.col(c) for c in (*keys, *(segment if len(segment) > 1 else []))]
    blank = reduce(Column.__or__, [c.isNull() for c in (*parts, *measures)])
    return (
        df.groupBy(_bucket(keys))
        .agg(F.count(F.lit(1)).alias("_rows"), F.bool_or(blank).alias("_blank"))
        .filter(F.col("_blank") | (F.col("_rows") > MOST))
        .select("_bucket", F.lit(True).alias("_split"))
    )


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("_bucket")


def running_totals(
    df: DataFrame,
    keys: list[str],
    segment: list[str],
    order: list[str],
    **measures: Column,
) -> DataFrame:
    """Running sums per key, without sorting a huge key in one task and with one shuffle of the rows.

    ``segment`` are the leading columns of the row order. The rows of a bucket of keys are counted first.
    Where they are many, rows are windowed per (key, segment), and a second, pre-aggregated window
    over one row per segment gives the opening value of each segment: a key with a third of all rows is
    so spread over as many tasks as it has segments. All other keys are windowed whole. Where the
    result does not use the measures, Catalyst removes the joins and the windows.
    """
    split = F.broadcast(split_buckets(df, keys, segment, *measures.values()))
    placed = df.withColumn("_bucket", _bucket(keys))
    marked = placed.join(split, "_bucket", "left")
    parts = [*keys, *[f"_of_{s}" for s in segment]]
    segments = {f"_of_{s}": F.when(F.col("_split"), F.col(s)) for s in segment}
    inside = (
        Window.partitionBy(*parts)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy(*parts[len(keys) :])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = (
        placed.join(split, "_bucket", "left_semi")
        .withColumnsRenamed(dict(zip(segment, parts[len(keys) :])))
        .groupBy(*parts)
        .agg(*[F.sum(m).alias(f"_{n}_total") for n, m in measures.items()])
    )
    opening = totals.select(
        *parts, *[F.sum(f"_{n}_total").over(before).alias(f"_{n}_opening") for n in measures]
    )
    within = marked.withColumns(segments).withColumns(
        {f"_{n}_within": F.sum(m).over(inside) for n, m in measures.items()}
    )
    return within.join(opening, parts, "left").selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[f"coalesce(_{n}_opening, 0) + _{n}_within as {n}" for n in measures],
    )
