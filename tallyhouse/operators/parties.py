"""Vendor and customer pages for all partners at once, and part buying history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions.joins import of_heads
from tallyhouse.functions.ordering import newest, top_n_per
from tallyhouse.functions.predicates import scoped
from tallyhouse.operators.documents import PURCHASE, SALES, DocumentKind
from tallyhouse.tables import Tables


def active_value(D: Tables, kind: DocumentKind) -> DataFrame:
    """Active lines and their value per document of company 1."""
    return (
        scoped(kind.lines(D), active=True)
        .groupBy(kind.number)
        .agg(F.count(F.lit(1)).alias("line_items"), F.sum("amount").alias("value"))
    )


def scorecard(D: Tables, kind: DocumentKind) -> DataFrame:
    """Per partner: documents, active ones, value of the active ones, last date.
    Partners without documents show 0, 0, 0 and NULL."""
    totals = (
        scoped(kind.heads(D))
        .select(kind.number, kind.party, kind.date, "active")
        .join(active_value(D, kind).select(kind.number, "value"), kind.number, "left")
        .groupBy(kind.party)
        .agg(
            F.count(F.lit(1)).alias("total_documents"),
            F.count_if("active").alias("active_documents"),
            F.sum(F.when(F.col("active"), F.col("value"))).alias("total_value"),
            F.max(kind.date).alias("last_date"),
        )
    )
    zeros = ["total_documents", "active_documents", "total_value"]
    return (
        scoped(getattr(D, kind.party_table))
        .select(F.col(kind.party_code).alias(kind.party))
        .join(totals, kind.party, "left")
        .select(
            F.col(kind.party).alias(kind.party_code),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in zeros],
            "last_date",
        )
    )


def recent_documents(D: Tables, kind: DocumentKind, n: int = 10) -> DataFrame:
    """The newest ``n`` documents of each partner with active line count and value.
    The rank needs heads only, so lines join the few documents that remain."""
    heads = scoped(kind.heads(D)).select(kind.number, kind.date, kind.party, "active")
    recent = top_n_per(heads, [kind.party], newest(kind.date, kind.number), n)
    return recent.join(active_value(D, kind), kind.number, "left").select(
        F.col(kind.party).alias(kind.party_code),
        kind.number,
        kind.date,
        "active",
        F.coalesce("line_items", F.lit(0)).alias("line_items"),
        F.coalesce("value", F.lit(0)).alias("total_amount"),
    )


def top_parts(D: Tables, kind: DocumentKind, n: int = 5) -> DataFrame:
    """Each partner's ``n`` parts of highest value. Lines whose part is unknown form
    one unnamed part, as in a grouping on the joined part columns."""
    sums = ["purchase_count", "total_quantity", "total_value"]
    bought = (
        scoped(kind.lines(D), active=True)
        .groupBy(kind.number, "partnum")
        .agg(
            F.count(F.lit(1)).alias(sums[0]),
            F.sum("quantity").alias(sums[1]),
            F.sum("amount").alias(sums[2]),
        )
    )
    heads = scoped(kind.heads(D)).select(kind.number, kind.party)
    bought = (
        of_heads(bought, heads, [kind.number])
        .groupBy(kind.party, "partnum")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    parts = scoped(D.part).select(F.col("part_num").alias("partnum"), "part_num", "part_desc")
    named = (
        bought.join(parts, "partnum", "left")
        .groupBy(kind.party, "part_num", "part_desc")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    order = [*newest("total_value"), F.col("part_num").asc_nulls_last()]
    return top_n_per(named, [kind.party], order, n).select(
        F.col(kind.party).alias(kind.party_code), "part_num", "part_desc", *sums
    )


def part_recent_documents(D: Tables, kind: DocumentKind, n: int = 5) -> DataFrame:
    """The newest ``n`` active lines of each part with document and partner."""
    lines = scoped(kind.lines(D), active=True).select(
        kind.number, "rowid", "partnum", "quantity", "unit_price", "amount"
    )
    heads = scoped(kind.heads(D)).select("company", kind.number, kind.date, kind.party)
    order = [*newest(kind.date, kind.number), F.col("rowid")]
    recent = top_n_per(of_heads(lines, heads, [kind.number]), ["partnum"], order, n)
    return recent.join(kind.parties(D), ["company", kind.party], "left").select(
        F.col("partnum").alias("part_num"),
        kind.number,
        kind.date,
        kind.party_name,
        "quantity",
        "unit_price",
        "amount",
    )


def vendor_scorecard(D: Tables) -> DataFrame:
    return scorecard(D, PURCHASE)


def customer_scorecard(D: Tables) -> DataFrame:
    return scorecard(D, SALES)


def recent_pos_by_vendor(D: Tables, n: int = 10) -> DataFrame:
    return recent_documents(D, PURCHASE, n)


def recent_invoices_by_customer(D: Tables, n: int = 10) -> DataFrame:
    return recent_documents(D, SALES, n)


def top_parts_by_vendor(D: Tables, n: int = 5) -> DataFrame:
    return top_parts(D, PURCHASE, n)


def top_parts_by_customer(D: Tables, n: int = 5) -> DataFrame:
    return top_parts(D, SALES, n)


def part_recent_purchases(D: Tables, n: int = 5) -> DataFrame:
    return part_recent_documents(D, PURCHASE, n)


def part_recent_sales(D: Tables, n: int = 5) -> DataFrame:
    return part_recent_documents(D, SALES, n)
