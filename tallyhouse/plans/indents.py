"""Creating, editing and deciding indents."""

from __future__ import annotations

import datetime as dt
from functools import cache

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions.joins import with_per_key
from tallyhouse.functions.predicates import scoped
from tallyhouse.plans.batches import (
    Batch,
    Frames,
    Posting,
    accepted,
    check_numbers,
    filled,
    rejected,
    unreadable,
    with_reasons,
)
from tallyhouse.plans.documents import edited, latest_per, switched_off
from tallyhouse.plans.numbering import assign_numbers, numbers_of
from tallyhouse.schemas import conform
from tallyhouse.tables import Tables

HEAD, TRAN = "indent_request_head", "indent_request_tran"
PENDING, APPROVED, REJECTED = "PENDING", "APPROVED", "REJECTED"


def requested_lines(lines: DataFrame) -> DataFrame:
    """Lines with part and quantity, numbers read. Lines of quantity 0 or less are left
    out; a number that cannot be read stays NULL."""
    read = lines.filter(filled("part_num", "quantity")).select(
        "submission_id",
        F.col("position").cast("int").alias("rowid"),
        F.col("part_num").try_cast("int").alias("partnum"),
        "part_desc",
        F.col("quantity").try_cast("decimal(18,2)").alias("quantity"),
        F.col("required_date").try_cast("date").alias("required_date"),
        F.col("item_remarks").alias("remarks"),
    )
    return read.filter("quantity is null or quantity > 0")


def _line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("submission_id").agg(F.count("quantity").alias("valid_lines"))


def _checks() -> dict:
    return {
        "unreadable line": F.col("unreadable"),
        "no valid item": F.coalesce("valid_lines", F.lit(0)) == 0,
    }


def _facts(batch: Batch, lines: DataFrame) -> DataFrame:
    return batch.heads.join(
        unreadable(lines, "partnum", "quantity"), "submission_id", "left"
    ).join(_line_counts(lines), "submission_id", "left")


def create_indents(D: Tables, batch: Batch, now: dt.datetime) -> Posting:
    """New indents, PENDING. Heads: (submission_id, indent_id or NULL, indent_dt,
    department, requested_by, remarks). A form needs one line with a part and a positive
    quantity; an id that exists or repeats in the batch rejects the form."""
    lines = requested_lines(batch.lines)
    existing = scoped(getattr(D, HEAD)).select("indent_id")
    checked = check_numbers(_facts(batch, lines), "indent_id", existing, _checks()).drop(
        "unreadable", "valid_lines"
    )

    @cache
    def heads() -> DataFrame:
        posted = accepted(checked)
        given = posted.filter("indent_id is not null")
        numbered = assign_numbers(
            posted.filter("indent_id is null"),
            "submission_id",
            "indent_id",
            numbers_of(D, HEAD, "indent_id"),
            given.select("indent_id"),
        )
        return given.unionByName(numbered).withColumns(
            {
                "company": F.lit(1),
                "status": F.lit(PENDING),
                "active": F.lit(True),
                "created": F.lit(now),
                "updated": F.lit(now),
            }
        )

    def tran() -> DataFrame:
        numbers = heads().select("submission_id", "indent_id", "active")
        rows = lines.join(numbers, "submission_id").withColumn("company", F.lit(1))
        return conform(rows, TRAN)

    return Posting(
        rejects=rejected(checked, "submission_id"),
        added=Frames(**{HEAD: lambda: conform(heads(), HEAD), TRAN: tran}),
    )


def update_indents(D: Tables, batch: Batch, now: dt.datetime) -> Posting:
    """Edits of PENDING indents: head fields, and lines replaced as a whole. With several
    edits of one indent in a batch the last one stays active."""
    lines = requested_lines(batch.lines)
    old = getattr(D, HEAD)
    known = scoped(old).select("indent_id", F.col("status").alias("current_status"))
    checked = with_reasons(
        with_per_key(_facts(batch, lines), known, ["indent_id"]),
        {
            "not found": F.col("current_status").isNull(),
            "not pending": F.col("current_status") != PENDING,
            **_checks(),
        },
    )
    fields = ["indent_dt", "department", "requested_by", "remarks"]
    edits = accepted(checked).select("submission_id", "indent_id", *fields)
    last = latest_per(edits, "indent_id", "submission_id")
    merged = old.join(
        last.select(
            F.lit(1).alias("company"),
            "indent_id",
            F.lit(True).alias("_hit"),
            *[F.col(c).alias(f"_{c}") for c in fields],
        ),
        ["company", "indent_id"],
        "left",
    )
    values = {**{c: F.col(f"_{c}") for c in fields}, "updated": F.lit(now)}
    heads = merged.withColumns(
        {c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}
    )
    final = last.select("indent_id", F.col("submission_id").alias("last_submission"))
    applied = with_per_key(edits, final, ["indent_id"]).select(
        "submission_id",
        "indent_id",
        (F.col("submission_id") == F.col("last_submission")).alias("active"),
    )
    new_lines = lines.join(applied, "submission_id").withColumn("company", F.lit(1))
    off = switched_off(getattr(D, TRAN), last, "indent_id")
    return edited(
        rejected(checked, "submission_id"),
        {HEAD: heads, TRAN: off},
        {TRAN: conform(new_lines, TRAN)},
    )


def transition_indents(D: Tables, decisions: DataFrame, strict: bool = False) -> Posting:
    """Approvals and rejections from (indent_id, status, updated). As published, any indent
    takes the last decision; ``strict`` accepts only the first decision on a PENDING one."""
    old = getattr(D, HEAD)
    known = scoped(old).select("indent_id", F.col("status").alias("current_status"))
    facts = with_per_key(decisions, known, ["indent_id"])
    rules = {
        "not found": F.col("current_status").isNull(),
        "unknown status": ~F.coalesce(F.col("status").isin(APPROVED, REJECTED), F.lit(False)),
    }
    if strict:
        rules["not pending"] = F.col("current_status") != PENDING
    checked = with_reasons(facts, rules)
    if strict:
        first = accepted(checked).groupBy("indent_id").agg(
            F.min(F.struct("updated", "status")).alias("first")
        )
        late = (F.size("reasons") == 0) & (F.struct("updated", "status") != F.col("first"))
        checked = with_per_key(checked, first, ["indent_id"]).withColumn(
            "reasons", F.when(late, F.array(F.lit("not pending"))).otherwise(F.col("reasons"))
        )
    taken = accepted(checked).groupBy("indent_id").agg(
        F.max(F.struct("updated", "status")).alias("last")
    )
    merged = old.join(
        taken.select(
            F.lit(1).alias("company"),
            "indent_id",
            F.col("last.status").alias("_status"),
            F.col("last.updated").alias("_updated"),
            F.lit(True).alias("_hit"),
        ),
        ["company", "indent_id"],
        "left",
    )
    heads = merged.withColumns(
        {
            "status": F.coalesce("_status", "status"),
            "updated": F.when(F.col("_hit"), F.col("_updated")).otherwise(F.col("updated")),
        }
    )
    return edited(rejected(checked, "indent_id", "status", "updated"), {HEAD: heads})
