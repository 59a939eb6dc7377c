"""Joining many rows per key with one row per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def of_heads(rows: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` that have a row in ``heads`` (one per key), with its columns; a key with a third
    of all rows is split as in ``with_per_key``."""
    known = heads.withColumn("_known", F.lit(True))
    return with_per_key(rows, known, keys).filter("_known").drop("_known")


def with_per_key(rows: DataFrame, info: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left-joined with ``info``, which has at most one row per key.

    ``info`` mostly ends in an aggregate on the same keys. With plain equality the join
    would reuse the aggregate's exchange, and Spark's skew handling, which looks for joins
    of two exchanges made for the join, would leave a key with a third of all rows in one
    task. Null-safe equality makes Spark exchange the small side once more, after which
    such a key is split. NULL keys stay unmatched, as with plain equality.
    """
    known = info.filter(" and ".join(f"{k} is not null" for k in keys))
    renamed = known.withColumnsRenamed({k: f"_info_{k}" for k in keys})
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_info_{k}")) for k in keys])
    return rows.join(renamed, match, "left").drop(*[f"_info_{k}" for k in keys])
