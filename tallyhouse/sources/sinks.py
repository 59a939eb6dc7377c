"""Writing results: JSON rows, month-partitioned appends, report files, publications."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyhouse.functions.values import date_text
from tallyhouse.schemas import conform, schema
from tallyhouse.tables import Tables


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON document per row, in a single ``json`` column."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def append(df: DataFrame, path: str, date: str) -> None:
    """Appends rows under ``month=yyyy-MM`` folders. Rows are rebalanced by month first:
    Spark merges small months into few files and splits a month that is too large for
    one task."""
    dated = df.withColumn("month", F.date_format(date, "yyyy-MM"))
    dated.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)


def read_appended(
    spark: SparkSession,
    path: str,
    table: str,
    month_from: str | None = None,
    month_to: str | None = None,
) -> DataFrame:
    """Rows written by ``append``; months outside the range are not read at all."""
    layout = StructType([*schema(table), StructField("month", StringType())])
    rows = spark.read.schema(layout).parquet(path)
    if month_from:
        rows = rows.filter(F.col("month") >= month_from)
    if month_to:
        rows = rows.filter(F.col("month") <= month_to)
    return conform(rows, table)


def export_report(
    df: DataFrame, path: str, fmt: str = "csv", date_style: str | None = None
) -> None:
    """A report as ``csv`` with header, ``json`` or ``parquet`` files; ``date_style``
    writes dates as text in one of the display formats."""
    if date_style:
        dates = [f.name for f in df.schema if f.dataType.typeName() in ("date", "timestamp")]
        df = df.withColumns({c: date_text(F.col(c), date_style) for c in dates})
    options = {"header": True} if fmt == "csv" else {}
    df.write.mode("overwrite").format(fmt).options(**options).save(path)


MANIFEST = "version bigint, name string, path string"


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, version: int) -> None:
    """Writes the changed ``tables`` as a new version and lists all tables of it last, so readers
    see either all of a batch or nothing of it. Tables that do not change keep their files.
    The first version has no list to carry over; later versions must have higher numbers."""
    listed = _manifest(spark, root)
    before = max((row.version for row in listed), default=None)
    if before is not None and version <= before:
        raise ValueError(f"version {version} does not follow {before}")
    kept = {row.name: row.path for row in listed if row.version == before}
    for name, rows in tables.items():
        kept[name] = f"{root}/{version}/{name}"
        rows.write.mode("overwrite").parquet(kept[name])
    rows = [(version, name, path) for name, path in kept.items()]
    current = spark.createDataFrame(rows, MANIFEST).coalesce(1)
    current.write.mode("append").parquet(f"{root}/versions")


def _manifest(spark: SparkSession, root: str) -> list:
    """One row a version and table: a few rows, whatever the data."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/versions").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def published(spark: SparkSession, root: str) -> Tables:
    """The tables of the highest published version."""
    listed = _manifest(spark, root)
    version = max(row.version for row in listed)
    paths = {row.name: row.path for row in listed if row.version == version}
    return Tables(lambda name: spark.read.schema(schema(name)).parquet(paths[name]))
