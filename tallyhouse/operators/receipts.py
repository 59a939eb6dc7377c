"""Goods receipts against purchase orders: summary, pending quantity and value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions.joins import with_per_key
from tallyhouse.functions.predicates import scoped
from tallyhouse.operators.documents import parts_with_unit
from tallyhouse.tables import Tables


def grn_summary(D: Tables, distinct: bool = False) -> DataFrame:
    """Totals above the receipt list. As published, a receipt counts once per line;
    ``distinct`` counts each receipt once."""
    lines = (
        scoped(D.goods_receipt_tran)
        .groupBy("grn_no")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum(F.when(F.col("active"), F.col("amount")).otherwise(0)).alias("value"),
        )
    )
    heads = scoped(D.goods_receipt_head).select("grn_no", "vendor", "active")
    weight = F.lit(1) if distinct else F.coalesce("lines", F.lit(1))
    without_lines = F.col("lines").isNull()
    return heads.join(lines, "grn_no", "left").agg(
        F.coalesce(F.sum(weight), F.lit(0)).alias("total_grns"),
        F.coalesce(F.sum(F.when(F.col("active"), weight)), F.lit(0)).alias("active_grns"),
        F.sum(F.when(without_lines, 0).otherwise(F.col("value"))).alias("total_value"),
        F.count_distinct("vendor").alias("unique_vendors"),
    )


def received_quantity(D: Tables, per_po: bool = False) -> DataFrame:
    """Active received quantity per part over all orders, or per order and part."""
    lines = scoped(D.goods_receipt_tran, active=True)
    total = F.sum("quantity").alias("already_received")
    if not per_po:
        return lines.groupBy("partnum").agg(total)
    heads = scoped(D.goods_receipt_head).select("grn_no", "po_no")
    per_receipt = lines.groupBy("grn_no", "partnum").agg(
        F.sum("quantity").alias("quantity")
    )
    return per_receipt.join(heads, "grn_no").groupBy("po_no", "partnum").agg(total)


def po_receipt_status(D: Tables, per_po: bool = False) -> DataFrame:
    """Active order lines with received and pending quantity. As published, receipts
    are summed per part over all orders, so pending can be negative; ``per_po`` matches
    receipts to their own order.

    Per part, labels and received quantity are put together first, so that the order lines
    are shuffled by part only once.
    """
    lines = scoped(D.purchase_order_tran, active=True).select(
        "po_no", "rowid", "partnum", "quantity", "unit_price", "amount"
    )
    parts = scoped(parts_with_unit(D)).select("partnum", "part_desc", "unit_desc")
    received = received_quantity(D, per_po)
    if per_po:
        rows = with_per_key(lines, received, ["po_no", "partnum"])
        rows = rows.join(parts, "partnum", "left")
    else:
        per_part = parts.join(received, "partnum", "full_outer")
        rows = with_per_key(lines, per_part, ["partnum"])
    received = F.coalesce("already_received", F.lit(0)).cast("decimal(28,2)")
    return (
        rows.select(
            "po_no", "rowid", "partnum", "part_desc", "quantity", "unit_price", "amount",
            "unit_desc",
            received.alias("already_received"),
            (F.col("quantity") - received).cast("decimal(28,2)").alias("pending_qty"),
        )
    )


def pending_value(D: Tables, per_po: bool = False) -> DataFrame:
    """Per order line the value still to be received, 0 where quantity or price is
    missing."""
    value = (F.col("pending_qty") * F.col("unit_price")).cast("decimal(28,2)")
    return po_receipt_status(D, per_po).select(
        "po_no",
        "rowid",
        "partnum",
        "pending_qty",
        "unit_price",
        F.coalesce(value, F.lit(0)).alias("pending_value"),
    )


def pending_value_totals(D: Tables, per_po: bool = False) -> DataFrame:
    """The receipt form's total per order."""
    return (
        pending_value(D, per_po)
        .groupBy("po_no")
        .agg(F.sum("pending_value").alias("total_pending_value"))
    )
