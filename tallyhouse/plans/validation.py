"""Entry rules of the forms: each kind's rules give rows a list of reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions.joins import with_per_key
from tallyhouse.operators.receipts import po_receipt_status
from tallyhouse.plans.batches import Batch, accepted, filled, with_reasons
from tallyhouse.tables import Tables

# Limits, patterns and choices of the entry forms.
SMALLEST, LARGEST = "0.01", "999999"
GST = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}$"
PAN = "^[A-Z]{5}[0-9]{4}[A-Z]{1}$"
PART_NAME = r"^[A-Za-z\s\-\.\(\)\/]+$"
PARTY_NAME = r"^[A-Za-z\s\-\.\(\)\/&]+$"
DEPARTMENTS = [
    "PRODUCTION", "MAINTENANCE", "QUALITY", "STORES", "ADMIN", "IT", "HR", "FINANCE"
]
REASONS = [
    "Physical Count Difference", "Damaged Goods", "Expired Items", "Lost/Stolen",
    "System Error Correction", "Other",
]
PART_TYPES = ["Raw Material", "Finished Goods", "Semi Finished", "Consumable", "Service"]
COSTING = ["FIFO", "LIFO", "Average", "Standard"]


def _number(column: str) -> Column:
    return F.col(column).cast("string").try_cast("decimal(38,6)")


def _blank(column: str) -> Column:
    text = F.col(column).cast("string")
    return text.isNull() | (text == "")


def _outside(column: str, low: str, high: str) -> Column:
    """A filled field that is no number between the limits."""
    number = _number(column)
    inside = number.between(F.lit(low).cast("decimal(38,6)"), F.lit(high).cast("decimal(38,6)"))
    return ~_blank(column) & ~F.coalesce(inside, F.lit(False))


def _unlike(column: str, pattern: str) -> Column:
    """A filled field that does not match."""
    return ~_blank(column) & ~F.col(column).rlike(pattern)


def _not_one_of(column: str, choices: list[str]) -> Column:
    return ~_blank(column) & ~F.col(column).isin(*choices)


def _party(kind: str) -> dict[str, Column]:
    return {
        f"missing {kind}_code": _blank(f"{kind}_code"),
        f"missing {kind}_name": _blank(f"{kind}_name"),
        f"bad {kind}_name": _unlike(f"{kind}_name", PARTY_NAME),
        "bad gst": _unlike("gst", GST),
        "bad pan": _unlike("pan", PAN),
    }


def rules(kind: str) -> dict[str, Column]:
    """Reason text -> broken-rule condition for one kind of form row."""
    quantity = {
        "missing quantity": _blank("quantity"),
        "quantity out of range": _outside("quantity", SMALLEST, LARGEST),
    }
    by_kind = {
        "part": lambda: {
            "missing part_num": _blank("part_num"),
            "missing part_desc": _blank("part_desc"),
            "bad part_desc": _unlike("part_desc", PART_NAME),
            "unknown part_type": _not_one_of("part_type", PART_TYPES),
            "unknown costing": _not_one_of("costing", COSTING),
        },
        "vendor": lambda: _party("vendor"),
        "customer": lambda: _party("customer"),
        "document": lambda: {
            "missing number": _blank("doc_no"),
            "missing date": _blank("doc_date"),
            "missing party": _blank("party"),
        },
        "line": lambda: {
            "missing part": _blank("part_num"),
            **quantity,
            "missing rate": _blank("rate"),
            "rate out of range": _outside("rate", SMALLEST, LARGEST),
            "tax out of range": _outside("tax_percent", "0", "100"),
        },
        "movement": lambda: {
            "missing part": _blank("part_num"),
            "missing type": _blank("type"),
            **quantity,
        },
        "adjustment": lambda: {
            "missing part": _blank("part_num"),
            "missing type": _blank("type"),
            **quantity,
            "missing reason": _blank("reason"),
            "unknown reason": _not_one_of("reason", REASONS),
        },
        "indent": lambda: {
            "missing date": _blank("indent_dt"),
            "missing department": _blank("department"),
            "unknown department": _not_one_of("department", DEPARTMENTS),
            "missing requester": _blank("requested_by"),
            "bad requester": _unlike("requested_by", PARTY_NAME),
        },
        "indent_line": lambda: {"missing part": _blank("part_num"), **quantity},
    }
    return by_kind[kind]()


def validate(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reasons``)."""
    checked = with_reasons(df, rules(kind))
    return accepted(checked), checked.filter(F.size("reasons") > 0)


def validate_documents(batch: Batch) -> tuple[DataFrame, DataFrame]:
    """Heads with all required fields and at least one complete line, and the others."""
    complete = (
        batch.lines.filter(filled("part_num", "quantity", "rate"))
        .select("submission_id")
        .distinct()
        .withColumn("has_line", F.lit(True))
    )
    checked = batch.heads.join(complete, "submission_id", "left").transform(
        with_reasons, {**rules("document"), "no complete line": F.col("has_line").isNull()}
    )
    checked = checked.drop("has_line")
    return accepted(checked), checked.filter(F.size("reasons") > 0)


def validate_receipts(D: Tables, batch: Batch, per_po: bool = False) -> tuple[DataFrame, DataFrame]:
    """Receipt forms against the pending quantity of their order: a line may not be
    negative or exceed what is pending, and one line must be positive."""
    pending = (
        po_receipt_status(D, per_po)
        .groupBy("po_no", F.col("partnum").alias("part"))
        .agg(F.max("pending_qty").alias("pending"))
    )
    received = F.coalesce(_number("quantity"), F.lit(0))
    entered = batch.lines.join(
        batch.heads.select("submission_id", "po_no"), "submission_id"
    ).withColumns({"part": F.col("part_num").try_cast("bigint"), "received": received})
    lines = (
        with_per_key(entered, pending, ["po_no", "part"])
        .groupBy("submission_id")
        .agg(
            F.max("received").alias("most"),
            F.min("received").alias("least"),
            F.bool_or(F.col("received") > F.coalesce("pending", F.lit(0))).alias("too_much"),
        )
    )
    checked = batch.heads.join(lines, "submission_id", "left").transform(
        with_reasons,
        {
            "nothing received": F.coalesce("most", F.lit(0)) <= 0,
            "negative quantity": F.col("least") < 0,
            "more than pending": F.col("too_much"),
        },
    )
    checked = checked.drop("most", "least", "too_much")
    return accepted(checked), checked.filter(F.size("reasons") > 0)
