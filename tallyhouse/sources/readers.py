"""Reading the inventory tables from Parquet or a relational database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.schemas import conform, schema
from tallyhouse.tables import Tables


def load_tables(spark: SparkSession, path: str) -> Tables:
    """Tables stored as ``<path>/<table>`` Parquet folders, with declared schemas."""
    return Tables(lambda name: spark.read.schema(schema(name)).parquet(f"{path}/{name}"))


def load_jdbc(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    split: dict[str, tuple[str, int, int, int]] | None = None,
) -> Tables:
    """Tables of a database. ``split[table] = (column, lower, upper, partitions)``
    makes Spark read a table in parallel ranges; filters and columns are pushed down."""
    ranges = split or {}

    def read(name: str) -> DataFrame:
        if name not in ranges:
            return conform(spark.read.jdbc(url, name, properties=properties), name)
        column, lower, upper, partitions = ranges[name]
        frame = spark.read.jdbc(
            url,
            name,
            column=column,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=partitions,
            properties=properties,
        )
        return conform(frame, name)

    return Tables(read)


def lookup(df: DataFrame, keys: DataFrame, on: list[str], company: int | None = 1) -> DataFrame:
    """All rows of ``df`` whose key is in ``keys``: the by-key page for many keys at once."""
    rows = df if company is None else df.filter(df["company"] == company)
    return rows.join(keys.select(*on), on, "left_semi")
