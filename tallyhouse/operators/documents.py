"""Purchase orders, sales invoices and goods receipts: headers, lines, registers.

Line tables are summed per document before they meet the heads, so a document with a
third of all lines costs one partial sum per map task and the join is one to one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallyhouse.functions.ordering import newest
from tallyhouse.functions.predicates import scoped
from tallyhouse.functions.values import amount_with_tax
from tallyhouse.tables import Tables


@dataclass(frozen=True)
class DocumentKind:
    """Names that differ between the document families."""

    head: str
    tran: str
    number: str
    date: str
    party: str
    price: str = "pur_price"

    @property
    def party_table(self) -> str:
        return self.party

    @property
    def party_code(self) -> str:
        return f"{self.party}_code"

    @property
    def party_name(self) -> str:
        return f"{self.party}_name"

    def heads(self, D: Tables) -> DataFrame:
        return getattr(D, self.head)

    def lines(self, D: Tables) -> DataFrame:
        return getattr(D, self.tran)

    def parties(self, D: Tables, *columns: str) -> DataFrame:
        """The trading partners keyed like the document head."""
        rows = getattr(D, self.party_table)
        return rows.select(
            "company", F.col(self.party_code).alias(self.party), self.party_name, *columns
        )


PURCHASE = DocumentKind(
    "purchase_order_head", "purchase_order_tran", "po_no", "po_date", "vendor"
)
SALES = DocumentKind(
    "sales_invoice_head", "sales_invoice_tran", "inv_no", "inv_dt", "customer", "sell_price"
)
RECEIPT = DocumentKind("goods_receipt_head", "goods_receipt_tran", "grn_no", "grn_dt", "vendor")
KINDS = {"purchase": PURCHASE, "sales": SALES, "receipt": RECEIPT}

PARTY_CONTACT = ["address1", "city", "state", "phone", "email"]


def _only(df: DataFrame, keys: DataFrame | None, number: str) -> DataFrame:
    return df if keys is None else df.join(keys.select(number), number, "left_semi")


def parts_with_unit(D: Tables) -> DataFrame:
    """Parts keyed for a line join, with the unit label of the same company."""
    parts = D.part.select(
        "company", F.col("part_num").alias("partnum"), "part_num", "part_desc", "unit_id"
    )
    units = D.unit.select("company", "unit_id", "unit_desc")
    return parts.join(units, ["company", "unit_id"], "left").drop("unit_id")


def document_header(D: Tables, kind: DocumentKind, keys: DataFrame | None = None) -> DataFrame:
    """Heads with the partner's contact columns; receipts also carry the order date."""
    heads = _only(scoped(kind.heads(D)), keys, kind.number)
    rows = heads.join(kind.parties(D, *PARTY_CONTACT), ["company", kind.party], "left")
    if kind is RECEIPT:
        orders = D.purchase_order_head.select("company", "po_no", "po_date")
        rows = rows.join(orders, ["company", "po_no"], "left")
    return rows


def document_lines(D: Tables, kind: DocumentKind, keys: DataFrame | None = None) -> DataFrame:
    """Active lines with part and unit labels; those of the documents in ``keys`` in form
    order, all of them in no order (one sort over every document serves no page)."""
    lines = _only(scoped(kind.lines(D), active=True), keys, kind.number)
    rows = lines.join(parts_with_unit(D), ["company", "partnum"], "left").select(
        kind.number, "rowid", "partnum", "quantity", "unit_price", "amount",
        "part_desc", "unit_desc",
    )
    return rows if keys is None else rows.orderBy(kind.number, "rowid")


def lines_per_document(D: Tables, kind: DocumentKind) -> DataFrame:
    """One row per document of company 1: its active lines and their value."""
    active = F.col("active")
    return (
        scoped(kind.lines(D))
        .groupBy(kind.number)
        .agg(
            F.count_if(active).alias("line_items"),
            F.sum(F.when(active, F.col("amount")).otherwise(0)).alias("total_amount"),
        )
    )


def document_register(D: Tables, kind: DocumentKind) -> DataFrame:
    """All documents, newest first, with partner name, active line count and value."""
    extra = ["po_no"] if kind is RECEIPT else []
    unmatched = F.col("line_items").isNull()
    return (
        scoped(kind.heads(D))
        .select("company", kind.number, kind.date, kind.party, "active", *extra)
        .join(kind.parties(D), ["company", kind.party], "left")
        .join(lines_per_document(D, kind), kind.number, "left")
        .select(
            kind.number,
            kind.date,
            *extra,
            kind.party_name,
            "active",
            F.coalesce("line_items", F.lit(0)).alias("line_items"),
            F.when(unmatched, 0).otherwise(F.col("total_amount")).alias("total_amount"),
        )
        .orderBy(*newest(kind.date, kind.number))
    )


def po_register(D: Tables) -> DataFrame:
    return document_register(D, PURCHASE)


def invoice_register(D: Tables) -> DataFrame:
    return document_register(D, SALES)


def grn_register(D: Tables) -> DataFrame:
    return document_register(D, RECEIPT)


def po_header(D: Tables, keys: DataFrame | None = None) -> DataFrame:
    return document_header(D, PURCHASE, keys)


def invoice_header(D: Tables, keys: DataFrame | None = None) -> DataFrame:
    return document_header(D, SALES, keys)


def grn_header(D: Tables, keys: DataFrame | None = None) -> DataFrame:
    return document_header(D, RECEIPT, keys)


def open_pos_for_receipt(D: Tables) -> DataFrame:
    """Active orders that have active lines, newest first, offered for receipt."""
    lines = (
        scoped(D.purchase_order_tran, active=True)
        .groupBy("po_no")
        .agg(F.count(F.lit(1)).alias("total_items"), F.sum("amount").alias("total_amount"))
    )
    return (
        scoped(D.purchase_order_head, active=True)
        .select("company", "po_no", "po_date", "vendor", "active")
        .join(PURCHASE.parties(D), ["company", "vendor"], "left")
        .join(lines, "po_no")
        .select("po_no", "po_date", "vendor_name", "active", "total_items", "total_amount")
        .orderBy(*newest("po_date", "po_no"))
    )


def register_stats(register: DataFrame) -> DataFrame:
    """Totals shown above a register: documents, active, inactive, value."""
    return register.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("active").alias("active"),
        F.count_if(~F.coalesce("active", F.lit(False))).alias("inactive"),
        F.coalesce(F.sum("total_amount"), F.lit(0)).alias("total_value"),
    )


def document_stats(D: Tables, kind: DocumentKind) -> DataFrame:
    """``register_stats`` of all documents, from heads and summed lines alone."""
    heads = scoped(kind.heads(D)).select(kind.number, "active")
    return register_stats(heads.join(lines_per_document(D, kind), kind.number, "left"))


def document_totals(D: Tables, kind: DocumentKind) -> DataFrame:
    """Per document: active lines, quantity and amount; zeros without lines."""
    lines = (
        scoped(kind.lines(D), active=True)
        .groupBy(kind.number)
        .agg(
            F.count(F.lit(1)).alias("line_count"),
            F.round(F.sum("quantity"), 2).alias("total_quantity"),
            F.sum("amount").alias("total_amount"),
        )
    )
    sums = ["line_count", "total_quantity", "total_amount"]
    return (
        scoped(kind.heads(D))
        .select(kind.number)
        .join(lines, kind.number, "left")
        .select(kind.number, *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])
    )


def po_item_check(D: Tables) -> DataFrame:
    """Per purchase order: whether it has lines, inactive ones included, and how many."""
    counts = (
        scoped(D.purchase_order_tran)
        .groupBy("po_no")
        .agg(F.count(F.lit(1)).alias("item_count"))
    )
    items = F.coalesce("item_count", F.lit(0))
    return (
        scoped(D.purchase_order_head)
        .select("po_no")
        .join(counts, "po_no", "left")
        .select("po_no", (items > 0).alias("has_items"), items.alias("item_count"))
    )


def line_amount_with_tax(lines: DataFrame, D: Tables, kind: DocumentKind) -> DataFrame:
    """Form lines with the tax-inclusive amount. A missing rate defaults to the part's
    purchase price (orders) or sales price (invoices); tax comes from the part."""
    parts = scoped(D.part, active=True).select(
        "company",
        F.col("part_num").alias("partnum"),
        F.col(kind.price).alias("default_rate"),
        F.col("tax_percent").alias("part_tax"),
    )
    rate = F.coalesce(F.col("unit_price"), F.col("default_rate"), F.lit(0).cast("decimal(18,2)"))
    return (
        lines.join(parts, ["company", "partnum"], "left")
        .withColumn("rate", rate)
        .withColumn(
            "amount_incl_tax", amount_with_tax(F.col("quantity"), F.col("rate"), F.col("part_tax"))
        )
        .drop("default_rate")
        .withColumnRenamed("part_tax", "tax_percent")
    )


def document_total_with_tax(lines: DataFrame, D: Tables, kind: DocumentKind) -> DataFrame:
    """Tax-inclusive total per document."""
    return (
        line_amount_with_tax(lines, D, kind)
        .groupBy(kind.number)
        .agg(F.sum("amount_incl_tax").alias("total_incl_tax"))
    )
