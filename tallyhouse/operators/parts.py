"""Part reports: margin report, summary and counts by category or type."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions.ordering import by_label
from tallyhouse.functions.predicates import scoped
from tallyhouse.functions.values import margin_percent, sign_label
from tallyhouse.operators.catalog import CATALOG_COLUMNS, with_labels
from tallyhouse.tables import Tables


def with_margin(parts: DataFrame) -> DataFrame:
    margin = margin_percent(F.col("pur_price"), F.col("sell_price"))
    exact = F.col("sell_price") - F.col("pur_price")
    known = F.when(margin.isNotNull(), exact)
    return parts.withColumns({"margin_percent": margin, "margin_class": sign_label(known)})


def part_margin(D: Tables) -> DataFrame:
    parts = scoped(D.part).select("part_num", "pur_price", "sell_price")
    return with_margin(parts)


def parts_report(D: Tables) -> DataFrame:
    """Company 1 parts with labels and margin, by category then description."""
    rows = with_labels(scoped(D.part), D).select(*CATALOG_COLUMNS)
    return with_margin(rows).orderBy(*by_label("part_category", "part_desc", "part_num"))


def parts_report_summary(D: Tables) -> DataFrame:
    price = F.nullif(F.col("pur_price"), F.lit(0).cast("decimal(18,2)"))
    total = F.sum(price).cast("double") / F.count(price)
    return scoped(D.part).agg(
        F.count(F.lit(1)).alias("total_parts"),
        F.count_if("active").alias("active_parts"),
        F.count_distinct(F.nullif(F.col("part_category"), F.lit(""))).alias("categories"),
        F.when(F.count(price) > 0, total).otherwise(0.0).alias("average_price"),
    )


def parts_by(D: Tables, column: str) -> DataFrame:
    """Part counts per category or type, blanks left out."""
    label = F.trim(column)
    return (
        scoped(D.part)
        .select(label.alias("label"))
        .filter("label is not null and label not in ('', '-')")
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("parts"))
    )
