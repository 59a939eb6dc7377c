"""Posting goods receipts, stock movements and adjustments to the ledger."""

from __future__ import annotations

import datetime as dt
from functools import cache

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions.joins import with_per_key
from tallyhouse.functions.predicates import scoped
from tallyhouse.operators.documents import RECEIPT
from tallyhouse.plans.batches import (
    Batch,
    Frames,
    Posting,
    accepted,
    entered_lines,
    rejected,
    unreadable,
    with_reasons,
)
from tallyhouse.plans.documents import LINE_NUMBERS, stamped
from tallyhouse.plans.numbering import assign_line_numbers, assign_numbers, numbers_of
from tallyhouse.schemas import conform
from tallyhouse.tables import Tables

MOVEMENTS = ["IN", "OUT"]
ADJUSTMENTS = ["INCREASE", "DECREASE"]


def post_receipts(D: Tables, batch: Batch, as_of: dt.date) -> Posting:
    """Receipts against purchase orders. Heads carry (submission_id, po_no, grn_date); the
    vendor comes from the order, which must exist. Each complete line becomes a receipt
    line and an ``IN`` movement dated at the receipt."""
    lines = entered_lines(batch.lines)
    orders = scoped(D.purchase_order_head).select(
        "po_no", "vendor", F.lit(True).alias("known")
    )
    forms = batch.heads.join(unreadable(lines, *LINE_NUMBERS), "submission_id", "left")
    checked = with_reasons(
        with_per_key(forms, orders, ["po_no"]),
        {
            "unknown purchase order": F.col("known").isNull(),
            "missing date": F.col("grn_date").isNull(),
            "unreadable line": F.col("unreadable"),
        },
    ).select("submission_id", "po_no", "vendor", "grn_date", "reasons")

    @cache
    def heads() -> DataFrame:
        existing = numbers_of(D, RECEIPT.head, "grn_no")
        return (
            assign_numbers(accepted(checked), "submission_id", "grn_no", existing)
            .withColumnRenamed("grn_date", "grn_dt")
            .withColumn("active", F.lit(True))
        )

    def received() -> DataFrame:
        numbers = heads().select("submission_id", "grn_no", "grn_dt", "active")
        return lines.join(numbers, "submission_id")

    def movements() -> DataFrame:
        existing = numbers_of(D, "stock_update", "update_id")
        dates = accepted(checked).select("submission_id", F.col("grn_date").alias("grn_dt"))
        return assign_line_numbers(lines, "submission_id", "rowid", "update_id", existing, forms=dates).select(
            "update_id",
            F.col("partnum").alias("part_num"),
            F.lit("IN").alias("type"),
            F.col("quantity").alias("qty"),
            F.col("grn_dt").alias("update_date"),
        )

    return Posting(
        rejects=rejected(checked, "submission_id"),
        added=Frames(
            **{
                RECEIPT.head: lambda: conform(stamped(heads(), "created_by", as_of), RECEIPT.head),
                RECEIPT.tran: lambda: conform(
                    stamped(received(), "createdby", as_of), RECEIPT.tran
                ),
                "stock_update": lambda: conform(
                    stamped(movements(), "created_by", as_of), "stock_update"
                ),
            }
        ),
    )


def post_movements(
    D: Tables, batch: DataFrame, as_of: dt.date, types: list[str] = MOVEMENTS
) -> Posting:
    """Ledger rows dated ``as_of`` from (submission_id, part_num, type, quantity)."""
    checked = with_reasons(
        batch,
        {
            "missing part": F.col("part_num").isNull(),
            "missing quantity": F.col("quantity").isNull(),
            "unknown type": ~F.coalesce(F.col("type").isin(*types), F.lit(False)),
        },
    )

    def rows() -> DataFrame:
        numbered = assign_numbers(
            accepted(checked).select("submission_id", "part_num", "type", "quantity"),
            "submission_id",
            "update_id",
            numbers_of(D, "stock_update", "update_id"),
        ).withColumns({"qty": F.col("quantity"), "update_date": F.lit(as_of)})
        return conform(stamped(numbered, "created_by", as_of), "stock_update")

    return Posting(
        rejects=rejected(checked, "submission_id"), added=Frames(stock_update=rows)
    )


def post_adjustments(D: Tables, batch: DataFrame, as_of: dt.date) -> Posting:
    """Corrections: ``INCREASE`` and ``DECREASE`` rows; the entered reason is not kept."""
    return post_movements(D, batch, as_of, ADJUSTMENTS)
