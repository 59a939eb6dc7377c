"""Line-level purchase and sales history with filters, and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions.joins import of_heads
from tallyhouse.functions.ordering import newest
from tallyhouse.functions.predicates import contains_pattern, in_range, scoped
from tallyhouse.operators.documents import PURCHASE, SALES, DocumentKind, parts_with_unit
from tallyhouse.tables import Tables


def _heads(D: Tables, kind: DocumentKind, date_from, date_to) -> DataFrame:
    heads = scoped(kind.heads(D)).select("company", kind.number, kind.date, kind.party)
    dates = in_range(kind.date, date_from, date_to)
    return heads if dates is None else heads.filter(dates)


def history(
    D: Tables,
    kind: DocumentKind,
    *,
    party: str | None = None,
    part: str | None = None,
    date_from=None,
    date_to=None,
    limit: int | None = 100,
) -> DataFrame:
    """Active lines, newest document first. The filters are name patterns on partner
    and part and an inclusive date range; the page keeps the newest ``limit`` lines.

    Labels come from left joins on unique keys and add no rows. Without a name filter
    the newest lines are therefore cut before the labels are joined; with one, the
    filtered labels are joined first and cut down the heads and the lines.
    """
    order = [*newest(kind.date, kind.number), F.col("rowid")]
    lines = scoped(kind.lines(D), active=True).select(
        "company", kind.number, "rowid", "partnum", "quantity", "unit_price", "amount"
    )
    heads = _heads(D, kind, date_from, date_to)
    parties, parts = kind.parties(D), parts_with_unit(D)
    wanted_party = contains_pattern(kind.party_name, party)
    wanted_part = contains_pattern("part_desc", part)
    if wanted_party is not None:
        heads = heads.join(parties.filter(wanted_party), ["company", kind.party])
    if wanted_part is not None:
        lines = lines.join(parts.filter(wanted_part), ["company", "partnum"])
    rows = of_heads(lines, heads, ["company", kind.number])
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    if wanted_party is None:
        rows = rows.join(parties, ["company", kind.party], "left")
    if wanted_part is None:
        rows = rows.join(parts, ["company", "partnum"], "left")
    return rows.orderBy(*order).select(
        kind.number,
        kind.date,
        kind.party_name,
        "part_num",
        "part_desc",
        "quantity",
        "unit_price",
        "amount",
        "unit_desc",
    )


def matching_documents(
    D: Tables,
    kind: DocumentKind,
    *,
    party: str | None = None,
    part: str | None = None,
    date_from=None,
    date_to=None,
) -> DataFrame:
    """Lines, quantity and value per document with a line under the history filters. Name filters act
    as semi joins on the small side; lines are summed per document before they meet the heads, so
    a huge document is one row."""
    lines = scoped(kind.lines(D), active=True).select(
        "company", kind.number, "partnum", "quantity", "amount"
    )
    heads = _heads(D, kind, date_from, date_to)
    wanted_party = contains_pattern(kind.party_name, party)
    wanted_part = contains_pattern("part_desc", part)
    if wanted_party is not None:
        heads = heads.join(
            kind.parties(D).filter(wanted_party), ["company", kind.party], "left_semi"
        )
    if wanted_part is not None:
        lines = lines.join(
            parts_with_unit(D).filter(wanted_part), ["company", "partnum"], "left_semi"
        )
    return (
        lines.groupBy("company", kind.number)
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum("quantity").alias("quantity"),
            F.sum("amount").alias("amount"),
        )
        .join(heads, ["company", kind.number], "left_semi")
        .groupBy(kind.number)
        .agg(*[F.sum(c).alias(c) for c in ("lines", "quantity", "amount")])
    )


def summed(documents: DataFrame) -> DataFrame:
    """The summary of rows with (documents, lines, quantity, amount); quantity and value are NULL
    without rows."""
    return documents.agg(
        F.coalesce(F.sum("documents"), F.lit(0)).alias("total_documents"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("total_line_items"),
        F.sum("quantity").alias("total_quantity"),
        F.sum("amount").alias("total_value"),
    )


def history_summary(D: Tables, kind: DocumentKind, **filters) -> DataFrame:
    """Documents, lines, quantity and value under the history filters; the sums are
    NULL when no line matches."""
    return summed(matching_documents(D, kind, **filters).withColumn("documents", F.lit(1)))


def purchase_history(D: Tables, **filters) -> DataFrame:
    return history(D, PURCHASE, **filters)


def sales_history(D: Tables, **filters) -> DataFrame:
    return history(D, SALES, **filters)


def purchase_summary(D: Tables, **filters) -> DataFrame:
    return history_summary(D, PURCHASE, **filters)


def sales_summary(D: Tables, **filters) -> DataFrame:
    return history_summary(D, SALES, **filters)
