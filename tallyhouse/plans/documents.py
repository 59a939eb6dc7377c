"""Posting and editing purchase orders and sales invoices, and soft deletes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection, Mapping
from functools import cache

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions.joins import with_per_key
from tallyhouse.functions.predicates import scoped
from tallyhouse.operators.catalog import LOOKUPS
from tallyhouse.operators.documents import KINDS, DocumentKind
from tallyhouse.plans.batches import (
    Batch,
    Frames,
    Posting,
    accepted,
    check_numbers,
    entered_lines,
    rejected,
    unreadable,
    with_reasons,
)
from tallyhouse.plans.numbering import assign_numbers, numbers_of
from tallyhouse.schemas import columns, conform
from tallyhouse.tables import Tables

USER = "admin"
LINE_NUMBERS = ["partnum", "quantity", "unit_price"]


def head_rules() -> dict:
    return {
        "missing date": F.col("doc_date").isNull(),
        "missing party": F.col("party").isNull(),
        "unreadable line": F.col("unreadable"),
    }


def stamped(df: DataFrame, user_column: str, as_of: dt.date) -> DataFrame:
    return df.withColumns(
        {"company": F.lit(1), user_column: F.lit(USER), "updated": F.lit(as_of)}
    )


def line_rows(
    lines: DataFrame, heads: DataFrame, kind: DocumentKind, as_of: dt.date, *others: str
) -> DataFrame:
    """Line table rows of the accepted forms, with the ``others`` of their columns; ``heads`` has (submission_id,
    number, active), one row per form."""
    return conform(
        stamped(lines.join(heads, "submission_id"), "createdby", as_of), kind.tran, *others
    )


def post_documents(D: Tables, kind: DocumentKind, batch: Batch, as_of: dt.date) -> Posting:
    """New documents. A form without a number gets the next one; a number that exists or
    that an earlier accepted form of the batch has taken rejects the form."""
    lines = entered_lines(batch.lines)
    existing = scoped(kind.heads(D)).select(F.col(kind.number).alias("doc_no"))
    forms = batch.heads.join(unreadable(lines, *LINE_NUMBERS), "submission_id", "left")
    checked = check_numbers(forms, "doc_no", existing, head_rules()).drop("unreadable")

    @cache
    def heads() -> DataFrame:
        posted = accepted(checked)
        given = posted.filter("doc_no is not null")
        numbered = assign_numbers(
            posted.filter("doc_no is null"),
            "submission_id",
            "doc_no",
            numbers_of(D, kind.head, kind.number),
            given.select("doc_no"),
        )
        names = {"doc_no": kind.number, "doc_date": kind.date, "party": kind.party}
        rows = given.unionByName(numbered).withColumnsRenamed(names)
        return rows.withColumn("active", F.lit(True))

    def tran() -> DataFrame:
        numbers = heads().select("submission_id", kind.number, "active")
        return line_rows(lines, numbers, kind, as_of)

    return Posting(
        rejects=rejected(checked, "submission_id"),
        added=Frames(
            **{
                kind.head: lambda: conform(stamped(heads(), "created_by", as_of), kind.head),
                kind.tran: tran,
            }
        ),
    )


def switched_off(
    rows: DataFrame, keys: DataFrame, on: str, as_of: dt.date | None = None
) -> DataFrame:
    """``rows`` with those of company 1 whose key is in ``keys`` (distinct) switched off and
    marked by ``_hit``, with the ``_dated`` of their key if it has one."""
    dated = [c for c in keys.columns if c == "_dated"]
    listed = keys.select(F.lit(1).alias("company"), on, F.lit(True).alias("_hit"), *dated)
    marked = with_per_key(rows, listed, ["company", on])
    changes = {"active": F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("active"))}
    if as_of is not None:
        changes["updated"] = F.when(F.col("_hit"), F.lit(as_of)).otherwise(F.col("updated"))
    return marked.withColumns(changes)


def edited(
    rejects: DataFrame,
    marked: dict[str, DataFrame],
    new: dict[str, DataFrame] | None = None,
    months: Mapping[str, Collection[str]] | None = None,
) -> Posting:
    """The posting of tables whose changed rows are marked by ``_hit``, and of ``new`` rows that
    belong to changed documents. Both have ``_dated`` in tables of which just some ``months`` were read."""
    new, months = new or {}, months or {}

    def content(table: str, rows: DataFrame) -> DataFrame:
        old = rows.select(*columns(table))
        return old.unionByName(new[table].select(*columns(table))) if table in new else old

    def rewritten(table: str) -> DataFrame:
        added = new[table].withColumns({"month": F.lit(None).cast("string"), "_hit": F.lit(True)})
        return marked[table].select(*added.columns).unionByName(added)

    cut = [t for t in new if t in months]
    return Posting(
        rejects=rejects,
        state={t: content(t, rows) for t, rows in marked.items()},
        changed={t: content(t, rows.filter("_hit")) for t, rows in marked.items()},
        rewritten={t: rewritten(t) for t in cut},
        months={t: months[t] for t in cut},
    )


def latest_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key as one mergeable aggregate, no sort per key."""
    others = [c for c in df.columns if c != key and c not in order]
    newest_row = F.max(F.struct(*order, *others)).alias("row")
    return df.groupBy(key).agg(newest_row).select(key, "row.*")


def replace_documents(D: Tables, kind: DocumentKind, batch: Batch, as_of: dt.date) -> Posting:
    """Edits: the head takes the last form's values, all earlier lines are switched off
    and the form's lines added. With several edits of one document in a batch, the lines
    of all but the last are added switched off."""
    lines = entered_lines(batch.lines)
    known = scoped(kind.heads(D)).select(
        F.col(kind.number).alias("doc_no"), F.lit(True).alias("known")
    )
    forms = batch.heads.join(unreadable(lines, *LINE_NUMBERS), "submission_id", "left")
    checked = with_reasons(
        with_per_key(forms, known, ["doc_no"]),
        {"unknown document": F.col("known").isNull(), **head_rules()},
    )
    edits = accepted(checked).select(
        "submission_id", F.col("doc_no").alias(kind.number), "doc_date", "party", "remarks",
        "active",
    )
    last = latest_per(edits, kind.number, "submission_id")
    old = kind.heads(D)
    merged = old.join(
        last.select(
            F.lit(1).alias("company"),
            kind.number,
            F.lit(True).alias("_hit"),
            *[F.col(c).alias(f"_{c}") for c in ("doc_date", "party", "remarks", "active")],
        ),
        ["company", kind.number],
        "left",
    )
    new_values = {
        kind.date: F.col("_doc_date"),
        kind.party: F.col("_party"),
        "remarks": F.col("_remarks"),
        "active": F.col("_active"),
        "updated": F.lit(as_of),
    }
    heads = merged.withColumns(
        {c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in new_values.items()}
    )
    dated = F.col("doc_date").alias("_dated")
    final = last.select(kind.number, F.col("submission_id").alias("last_submission"), dated)
    applied = with_per_key(edits, final, [kind.number]).select(
        "submission_id",
        kind.number,
        (F.col("submission_id") == F.col("last_submission")).alias("active"),
        "_dated",
    )
    off = switched_off(kind.lines(D), last.select(kind.number, dated), kind.number, as_of)
    return edited(
        rejected(checked, "submission_id"),
        {kind.head: heads, kind.tran: off},
        {kind.tran: line_rows(lines, applied, kind, as_of, "_dated")},
        D.months,
    )


def soft_delete(D: Tables, kind: str, keys: DataFrame, as_of: dt.date) -> Posting:
    """Switches off the listed master rows, or documents with all their lines."""
    if kind in KINDS:
        number = KINDS[kind].number
        tables = [KINDS[kind].head, KINDS[kind].tran]
    else:
        number, tables = LOOKUPS[kind][0], [kind]
    wanted = keys.select(number).distinct()
    known = scoped(getattr(D, tables[0])).select(number)
    unknown = wanted.join(known, number, "left_anti").withColumn(
        "reasons", F.array(F.lit("not found"))
    )
    return edited(
        unknown, {t: switched_off(getattr(D, t), wanted, number, as_of) for t in tables}
    )
