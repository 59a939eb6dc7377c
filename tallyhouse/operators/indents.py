"""Indents (internal requests): register, counts, headers and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions.ordering import newest
from tallyhouse.functions.predicates import scoped
from tallyhouse.tables import Tables

HEADER_COLUMNS = [
    "company", "indent_id", "indent_dt", "department", "requested_by", "status", "remarks",
    "active", "created", "updated",
]
LINE_COLUMNS = [
    "rowid", "partnum", "part_desc", "quantity", "required_date", "remarks", "active"
]


def indent_register(D: Tables) -> DataFrame:
    """All indents, newest first, with the number of active lines."""
    lines = (
        scoped(D.indent_request_tran, active=True)
        .groupBy("indent_id")
        .agg(F.count("rowid").alias("line_items"))
    )
    return (
        scoped(D.indent_request_head)
        .join(lines, "indent_id", "left")
        .select(
            "indent_id", "indent_dt", "department", "requested_by", "status", "active",
            F.coalesce("line_items", F.lit(0)).alias("line_items"),
        )
        .orderBy(*newest("indent_dt", "indent_id"))
    )


def indent_status_counts(D: Tables) -> DataFrame:
    """Active indents in total and per status, in one pass."""
    status = F.col("status")
    return D.indent_request_head.filter("active").agg(
        F.count(F.lit(1)).alias("total_indents"),
        F.count_if(status == "PENDING").alias("pending_indents"),
        F.count_if(status == "APPROVED").alias("approved_indents"),
        F.count_if(status == "REJECTED").alias("rejected_indents"),
    )


def indent_header(D: Tables, keys: DataFrame | None = None) -> DataFrame:
    rows = scoped(D.indent_request_head)
    if keys is not None:
        rows = rows.join(keys.select("indent_id"), "indent_id", "left_semi")
    return rows.select(*HEADER_COLUMNS)


def indent_lines(D: Tables, keys: DataFrame | None = None) -> DataFrame:
    """Active lines, those of ``keys`` in form order; the description is the one stored on the line."""
    rows = scoped(D.indent_request_tran, active=True).select("indent_id", *LINE_COLUMNS)
    if keys is None:
        return rows
    return rows.join(keys.select("indent_id"), "indent_id", "left_semi").orderBy(
        "indent_id", "rowid"
    )
