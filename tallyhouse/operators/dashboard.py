"""Dashboard figures: money, partners, operations. Dates are relative to ``as_of``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions.ordering import newest, top_n_per
from tallyhouse.operators.documents import PURCHASE, SALES, DocumentKind
from tallyhouse.tables import Tables

VALUE = "decimal(28,2)"

# The labels of the dashboard document.
PARTNER_LABELS = {"Vendor": "🏢 %s (Vendor)", "Customer": "👥 %s (Customer)"}
MONEY_LABELS = {
    "sales_revenue": "Sales Revenue",
    "purchase_costs": "Purchase Costs",
    "profit": "Profit",
}
OPERATION_LABELS = [
    "Active Purchase Orders",
    "Pending GRNs",
    "Active Sales Invoices",
    "Completed Operations (30d)",
]


def entity_counts(D: Tables) -> DataFrame:
    """Active rows of the five main entities of all companies."""
    tables = ["part", "vendor", "customer", "purchase_order_head", "sales_invoice_head"]
    counts = [
        getattr(D, t).filter("active").agg(F.count(F.lit(1)).alias("active_count"))
        .select(F.lit(t.removesuffix("_head")).alias("entity"), "active_count")
        for t in tables
    ]
    return _stack(counts)


def value_by_party(
    D: Tables, kind: DocumentKind, as_of: dt.date, months: int = 6
) -> DataFrame:
    """Value of active lines of active documents of the window, per partner."""
    since = F.add_months(F.lit(as_of), -months)
    heads = kind.heads(D).filter(F.col("active") & (F.col(kind.date) >= since))
    totals = (
        kind.lines(D)
        .filter("active")
        .groupBy("company", kind.number)
        .agg(F.sum("amount").alias("amount"))
    )
    return (
        totals.join(heads.select("company", kind.number, kind.party), ["company", kind.number])
        .groupBy("company", kind.party)
        .agg(F.sum("amount").cast(VALUE).alias("value"))
    )


def value_by_name(
    D: Tables, kind: DocumentKind, as_of: dt.date, months: int = 6
) -> DataFrame:
    """The same value per partner name; ``known`` is false for partners that are not in
    the partner table."""
    parties = kind.parties(D).withColumn("known", F.lit(True))
    return (
        value_by_party(D, kind, as_of, months)
        .join(parties, ["company", kind.party], "left")
        .groupBy(
            F.coalesce("known", F.lit(False)).alias("known"),
            F.col(kind.party_name).alias("name"),
        )
        .agg(F.sum("value").cast(VALUE).alias("value"))
    )


def _profit(sales: DataFrame, costs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast(VALUE)
    both = sales.select(
        F.col("value").alias("sales_revenue"), zero.alias("purchase_costs")
    ).unionByName(
        costs.select(zero.alias("sales_revenue"), F.col("value").alias("purchase_costs"))
    )
    totals = both.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast(VALUE).alias(c)
            for c in ("sales_revenue", "purchase_costs")
        ]
    )
    net = F.col("sales_revenue") - F.col("purchase_costs")
    return totals.select(
        "*", F.greatest(net, F.lit(0)).cast(VALUE).alias("profit"), net.cast(VALUE).alias("net")
    )


def _top(values: DataFrame, n: int) -> DataFrame:
    """The ``n`` known names of highest value. Known names sort first and are filtered
    after the cut, which keeps the aggregate below identical wherever it is used, so
    that Spark computes it once per plan."""
    return (
        values.orderBy(F.col("known").desc(), *newest("value"), "name")
        .limit(n)
        .filter("known")
        .select("name", F.col("value").alias("total_value"))
    )


def _labelled(top: DataFrame, role: str) -> DataFrame:
    return top.select(
        F.lit(role).alias("role"),
        "name",
        F.format_string(PARTNER_LABELS[role], F.col("name")).alias("label"),
        F.coalesce("total_value", F.lit(0)).cast(VALUE).alias("value"),
    )


def revenue_vs_expense(D: Tables, as_of: dt.date, months: int = 6) -> DataFrame:
    """Sales, purchases, profit clamped at 0, and the unclamped net."""
    return _profit(
        value_by_party(D, SALES, as_of, months), value_by_party(D, PURCHASE, as_of, months)
    )


def top_vendors(D: Tables, as_of: dt.date, n: int = 3) -> DataFrame:
    return _top(value_by_name(D, PURCHASE, as_of), n)


def top_customers(D: Tables, as_of: dt.date, n: int = 3) -> DataFrame:
    return _top(value_by_name(D, SALES, as_of), n)


def top_partners(D: Tables, as_of: dt.date, n: int = 3) -> DataFrame:
    """Top vendors and top customers with their role and display label."""
    return _labelled(top_vendors(D, as_of, n), "Vendor").unionByName(
        _labelled(top_customers(D, as_of, n), "Customer")
    )


def pending_grns(D: Tables) -> DataFrame:
    """Active orders for which no receipt exists, active or not."""
    return (
        D.purchase_order_head.filter("active")
        .join(D.goods_receipt_head.select("company", "po_no"), ["company", "po_no"], "left_anti")
        .agg(F.count(F.lit(1)).alias("pending_grns"))
    )


def completed_operations(D: Tables, as_of: dt.date, days: int = 30) -> DataFrame:
    """Inactive orders, invoices and receipts dated in the last ``days`` days."""
    since = F.date_sub(F.lit(as_of), days)

    def closed(heads: DataFrame, date: str) -> DataFrame:
        return heads.filter(~F.col("active") & (F.col(date) >= since)).select(
            F.lit(1).alias("one")
        )

    return (
        closed(D.purchase_order_head, "po_date")
        .unionByName(closed(D.sales_invoice_head, "inv_dt"))
        .unionByName(closed(D.goods_receipt_head, "grn_dt"))
        .agg(F.count(F.lit(1)).alias("completed_operations"))
    )


def _orders_with_receipts(D: Tables, as_of: dt.date) -> DataFrame:
    """Orders, with whether no receipt exists and how many of their receipts were closed lately; receipts
    without an order stand beside."""
    lately = F.date_sub(F.lit(as_of), 30)
    received = D.goods_receipt_head.groupBy("company", "po_no").agg(
        F.count_if(~F.col("active") & (F.col("grn_dt") >= lately)).alias("extra_closed")
    )
    orders = D.purchase_order_head.select("company", "po_no", "po_date", "vendor", "active")
    pending = F.col("active") & F.col("extra_closed").isNull()
    return orders.join(received, ["company", "po_no"], "full_outer").withColumn(
        "extra_pending", pending.cast("int")
    )


def operational_status(D: Tables, as_of: dt.date) -> DataFrame:
    """Four labelled counts of open and completed work; each head table is read once."""
    lately = F.date_sub(F.lit(as_of), 30)

    def counts(heads: DataFrame, **values: Column) -> DataFrame:
        found = heads.agg(*[F.coalesce(v, F.lit(0)).alias(k) for k, v in values.items()])
        entries = [
            F.struct(F.lit(OPERATION_LABELS[int(k[1:])]).alias("label"), F.col(k).alias("value")) for k in values
        ]
        return found.select(F.inline(F.array(*entries)))

    orders = counts(
        _orders_with_receipts(D, as_of),
        n0=F.count_if("active"),
        n1=F.sum("extra_pending"),
        n3=F.count_if(~F.col("active") & (F.col("po_date") >= lately))
        + F.coalesce(F.sum("extra_closed"), F.lit(0)),
    )
    invoices = counts(
        D.sales_invoice_head,
        n2=F.count_if("active"),
        n3=F.count_if(~F.col("active") & (F.col("inv_dt") >= lately)),
    )
    return orders.unionByName(invoices).groupBy("label").agg(F.sum("value").alias("value"))


def recent_transactions(D: Tables, n: int = 5) -> DataFrame:
    """The newest active purchase orders that have a vendor."""
    return (
        D.purchase_order_head.filter("active")
        .join(PURCHASE.parties(D), ["company", "vendor"])
        .orderBy(*newest("po_date", "po_no"))
        .limit(n)
        .select(
            F.lit("Purchase Order").alias("type"),
            F.col("po_no").alias("doc_no"),
            F.col("po_date").alias("doc_date"),
            F.col("vendor_name").alias("party_name"),
        )
    )


def _figures(heads: DataFrame, D: Tables, kind: DocumentKind, as_of: dt.date) -> DataFrame:
    """Per partner of one side: its role and name, value and documents of the money window, and counts of active
    and of lately closed documents. Heads and lines are read once. ``heads`` may carry ``extra``, counted
    beside."""
    since, lately = F.add_months(F.lit(as_of), -6), F.date_sub(F.lit(as_of), 30)
    totals = (
        kind.lines(D)
        .filter("active")
        .groupBy("company", kind.number)
        .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("lines"))
    )
    date = F.col(kind.date)
    counted = F.col("active") & (date >= since) & F.col("lines").isNotNull()
    per_party = (
        heads.join(totals, ["company", kind.number], "left")
        .groupBy("company", kind.party)
        .agg(
            F.sum(F.when(counted, F.col("amount"))).cast(VALUE).alias("value"),
            F.count_if(counted).alias("counted"),
            F.count_if("active").alias("active_documents"),
            F.count_if(~F.col("active") & (date >= lately)).alias("closed"),
            F.sum("extra_pending").alias("pending"),
            F.sum("extra_closed").alias("more_closed"),
        )
    )
    parties = kind.parties(D).withColumn("known", F.lit(True))
    return per_party.join(parties, ["company", kind.party], "left").select(
        F.lit(kind.party.capitalize()).alias("role"),
        F.col(kind.party_name).alias("name"),
        F.coalesce("known", F.lit(False)).alias("known"),
        "value", "counted", "active_documents", "closed", "pending", "more_closed",
    )


def dashboard_stats(D: Tables, as_of: dt.date) -> DataFrame:
    """The whole dashboard as (section, label, value) rows of one plan.

    Each table is read once: the figures per partner are expanded to one row a section they count
    in, and one aggregate and one top-n serve all sections."""
    invoices = D.sales_invoice_head.select("company", "inv_no", "inv_dt", "customer", "active")
    none = F.lit(None).cast("bigint")
    invoices = invoices.withColumns({"extra_pending": none, "extra_closed": none})
    figures = _figures(invoices, D, SALES, as_of).unionByName(
        _figures(_orders_with_receipts(D, as_of), D, PURCHASE, as_of)
    )
    bought = F.col("role") == "Vendor"
    money, operations = list(MONEY_LABELS.values()), OPERATION_LABELS
    value = F.coalesce("value", F.lit(0)).cast(VALUE)

    def entry(section: str, label: str, amount: Column) -> Column:
        text = F.lit(None).cast("string")
        return F.struct(
            F.lit(section).alias("section"), F.lit(label).alias("label"),
            text.alias("name"), amount.cast(VALUE).alias("value"),
        )

    def either(vendor: Column | int, customer: Column | int) -> Column:
        return F.when(bought, vendor).otherwise(customer)

    fixed = [
        entry("revenue_expense", money[0], either(F.lit(0), value)),
        entry("revenue_expense", money[1], either(value, F.lit(0))),
        entry("revenue_expense", money[2], either(-value, value)),
        entry("operational_status", operations[0], either(F.col("active_documents"), F.lit(0))),
        entry("operational_status", operations[1], either(F.coalesce("pending", F.lit(0)), F.lit(0))),
        entry("operational_status", operations[2], either(F.lit(0), F.col("active_documents"))),
        entry("operational_status", operations[3], F.col("closed") + F.coalesce("more_closed", F.lit(0))),
    ]
    partner = F.struct(
        F.lit("top_partners").alias("section"), F.col("role").alias("label"), "name", F.col("value")
    )
    every = F.array(*fixed)
    rows = figures.select(
        F.inline(F.when(F.col("known") & (F.col("counted") > 0), F.array_append(every, partner)).otherwise(every))
    )
    # All labels have a row, also where there is no document.
    rows = rows.unionByName(
        rows.sparkSession.range(1).select(
            F.inline(
                F.array(
                    *[entry("revenue_expense", m, F.lit(0)) for m in money],
                    *[entry("operational_status", o, F.lit(0)) for o in operations],
                )
            )
        )
    )
    totals = rows.groupBy("section", "label", "name").agg(F.sum("value").cast(VALUE).alias("value"))
    first = top_n_per(totals, ["section", "label"], [*newest("value"), F.col("name")], 3)
    total = F.coalesce("value", F.lit(0))
    label = F.when(F.col("section") != "top_partners", F.col("label"))
    for role, text in PARTNER_LABELS.items():
        label = label.when(F.col("label") == role, F.format_string(text, F.col("name")))
    clamped = F.when(F.col("label") == money[2], F.greatest(total, F.lit(0))).otherwise(total)
    return first.select("section", label.alias("label"), clamped.cast(VALUE).alias("value"))


def dashboard_json(D: Tables, as_of: dt.date) -> DataFrame:
    """The dashboard as JSON, one document {label: value} per section (a dozen rows)."""
    entries = F.collect_list(F.struct("label", "value"))
    return (
        dashboard_stats(D, as_of)
        .groupBy("section")
        .agg(F.to_json(F.map_from_entries(F.sort_array(entries))).alias("json"))
    )


def _stack(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first
