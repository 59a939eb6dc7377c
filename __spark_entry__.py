
from __future__ import annotations

import datetime as dt
import importlib.util
import sys
import uuid
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from oracle_posts import POSTS  # noqa: E402
from oracle_reads import READS  # noqa: E402
from oracle_stored import STORED_TEXT  # noqa: E402
from oracle_views import with_views  # noqa: E402
from tallyhouse.functions import predicates as P, values as V  # noqa: E402
from tallyhouse.operators import (  # noqa: E402
    catalog,
    dashboard,
    documents,
    history,
    indents,
    parties,
    parts,
    receipts,
    stock,
)
from tallyhouse.plans import (  # noqa: E402
    documents as post_docs,
    indents as post_indents,
    masters as post_masters,
    stock as post_stock,
    validation,
)
from tallyhouse.plans.batches import Batch, Posting  # noqa: E402
from tallyhouse.sources import star_batches as forms  # noqa: E402
from tallyhouse.sources.readers import load_tables, lookup  # noqa: E402
from tallyhouse.sources.checkpoints import shared_folder  # noqa: E402
from tallyhouse.sources.sinks import (  # noqa: E402
    append,
    export_report,
    publish,
    published,
    read_appended,
    to_json_rows,
)
from tallyhouse.sources.star import star_tables  # noqa: E402
from tallyhouse.sources.summaries import keep_sums, stored_summary  # noqa: E402
from tallyhouse.sources.store import Manifest, Store, balance_between, keep_levels  # noqa: E402
from tallyhouse.tables import Tables  # noqa: E402

AS_OF = dt.date(2001, 8, 1)
NOW = dt.datetime(2001, 8, 1, 12)
FILTERS = {
    "party": "00",
    "part": "w_dg",
    "date_from": "1996-01-01",
    "date_to": "1999-12-31",
}


def _doubles(df: DataFrame) -> DataFrame:
    """Decimal results as DOUBLE, the type both engines are compared in."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if f.dataType.typeName() == "decimal"
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _po_list_filtered(D: Tables) -> DataFrame:
    rows = P.search(documents.po_register(D), "00", ["po_no", "vendor_name"])
    rows = P.status_filter(rows, True)
    return P.date_filter(rows, "po_date", from_="1996-01-01", to="2000-06-30")


def _grn_list_on_day(D: Tables) -> DataFrame:
    rows = P.status_filter(documents.grn_register(D), False)
    return P.date_filter(rows, "grn_dt", exact="1997-03-15")


def _vendors_by_state(D: Tables) -> DataFrame:
    rows = P.facet_filter(catalog.vendor_directory(D), "state", "tion_1")
    rows = P.search(rows, "SUPPLIER", ["vendor_code", "vendor_name"])
    return rows.select("vendor_code", "vendor_name", "state")


def _header(df: DataFrame, kind: documents.DocumentKind, *extra: str) -> DataFrame:
    return df.select(
        kind.number, kind.date, kind.party, "active", kind.party_name, "city", "state", *extra
    )


def _indent_header(D: Tables) -> DataFrame:
    return indents.indent_header(D).select(
        "indent_id", "indent_dt", "department", "requested_by", "status", "active",
        V.date_text(F.col("created"), "minute").alias("created_text"),
    )


def _document_codes(D: Tables) -> DataFrame:
    return D.purchase_order_head.select(
        "po_no",
        V.display_code("purchase_order", F.col("po_no"), dashed=True).alias("code"),
        V.date_text(F.col("po_date"), "day_first").alias("day_first"),
        V.date_text(F.col("po_date"), "short").alias("short_date"),
    )


def _form_lines(D: Tables, kind: documents.DocumentKind) -> DataFrame:
    """Entered lines of which every third has no rate yet."""
    lines = P.scoped(kind.lines(D), active=True)
    return lines.withColumn("unit_price", F.when(F.col("rowid") % 3 != 0, F.col("unit_price")))


def _with_tax(D: Tables, kind: documents.DocumentKind) -> DataFrame:
    return documents.line_amount_with_tax(_form_lines(D, kind), D, kind).select(
        kind.number, "rowid", "partnum", "quantity", "rate", "tax_percent", "amount_incl_tax"
    )


def _project_stock(D: Tables) -> DataFrame:
    moves = D.stock_update.select(
        "update_id", "part_num", "type", F.col("qty").alias("quantity")
    )
    return stock.project_stock(moves, D)


def _orders_with_vendors(D: Tables) -> DataFrame:
    ordered = D.purchase_order_head.filter("active").select(F.col("vendor").alias("vendor_code"))
    return lookup(D.vendor, ordered, ["vendor_code"]).select(
        "vendor_code", "vendor_name", "state", "active"
    )


PO, SI, GR = documents.PURCHASE, documents.SALES, documents.RECEIPT

REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    "part_catalog": catalog.part_catalog,
    "vendor_directory": catalog.vendor_directory,
    "customer_directory": catalog.customer_directory,
    "active_units": lambda D: catalog.active_lookup(D, "unit"),
    "active_taxes": lambda D: catalog.active_lookup(D, "tax"),
    "active_vendors": lambda D: catalog.active_lookup(D, "vendor"),
    "active_customers": lambda D: catalog.active_lookup(D, "customer"),
    "active_parts": lambda D: catalog.active_lookup(D, "part"),
    "part_detail": lambda D: catalog.entity_detail(D, "part").select(
        "part_num", "part_desc", "part_type", "part_category", "unit_id", "pur_price",
        "sell_price", "hsn_code", "tax_id", "tax_percent", "active", "unit_desc", "tax_desc",
    ),
    "vendor_detail": lambda D: catalog.entity_detail(D, "vendor").select(
        "vendor_code", "vendor_name", "city", "state", "gst", "pan", "active"
    ),
    "customer_detail": lambda D: catalog.entity_detail(D, "customer").select(
        "customer_code", "customer_name", "city", "state", "active"
    ),
    "part_price_lookup": catalog.part_price_lookup,
    "vendors_of_active_orders": _orders_with_vendors,
    "po_list_filtered": _po_list_filtered,
    "grn_list_on_day": _grn_list_on_day,
    "vendors_by_state": _vendors_by_state,
    "stock_low": lambda D: P.stock_level_filter(stock.stock_on_hand(D), "low"),
    "stock_zero": lambda D: P.stock_level_filter(stock.stock_on_hand(D), "zero"),
    "stock_available": lambda D: P.stock_level_filter(stock.stock_on_hand(D), "available"),
    "po_header": lambda D: _header(documents.po_header(D), PO),
    "invoice_header": lambda D: _header(documents.invoice_header(D), SI),
    "grn_header": lambda D: _header(documents.grn_header(D), GR, "po_no", "po_date"),
    "indent_header": _indent_header,
    "po_lines": lambda D: documents.document_lines(D, PO),
    "invoice_lines": lambda D: documents.document_lines(D, SI),
    "grn_lines": lambda D: documents.document_lines(D, GR),
    "indent_lines": lambda D: indents.indent_lines(D).drop("remarks"),
    "document_codes": _document_codes,
    "part_codes": lambda D: D.part.select(
        "part_num", V.display_code("part", F.col("part_num")).alias("code")
    ),
    "po_register": documents.po_register,
    "invoice_register": documents.invoice_register,
    "grn_register": documents.grn_register,
    "indent_register": indents.indent_register,
    "open_pos_for_receipt": documents.open_pos_for_receipt,
    "po_register_stats": lambda D: documents.document_stats(D, PO),
    "invoice_register_stats": lambda D: documents.document_stats(D, SI),
    "po_totals": lambda D: documents.document_totals(D, PO),
    "invoice_totals": lambda D: documents.document_totals(D, SI),
    "grn_totals": lambda D: documents.document_totals(D, GR),
    "po_item_check": documents.po_item_check,
    "po_item_check_json": lambda D: to_json_rows(documents.po_item_check(D)),
    "purchase_history": history.purchase_history,
    "sales_history": history.sales_history,
    "purchase_history_filtered": lambda D: history.purchase_history(D, **FILTERS),
    "sales_history_filtered": lambda D: history.sales_history(
        D, party="1", date_to="1998-12-31"
    ),
    "purchase_history_all": lambda D: history.purchase_history(D, limit=None),
    "purchase_summary": history.purchase_summary,
    "sales_summary": history.sales_summary,
    "purchase_summary_filtered": lambda D: history.purchase_summary(D, **FILTERS),
    "sales_summary_none": lambda D: history.sales_summary(D, party="no such name"),
    "vendor_scorecard": parties.vendor_scorecard,
    "customer_scorecard": parties.customer_scorecard,
    "recent_pos_by_vendor": parties.recent_pos_by_vendor,
    "recent_invoices_by_customer": parties.recent_invoices_by_customer,
    "top_parts_by_vendor": parties.top_parts_by_vendor,
    "top_parts_by_customer": parties.top_parts_by_customer,
    "part_recent_purchases": parties.part_recent_purchases,
    "part_recent_sales": parties.part_recent_sales,
    "entity_counts": dashboard.entity_counts,
    "revenue_vs_expense": lambda D: dashboard.revenue_vs_expense(D, AS_OF),
    "top_vendors": lambda D: dashboard.top_vendors(D, AS_OF),
    "top_customers": lambda D: dashboard.top_customers(D, AS_OF),
    "top_partners": lambda D: dashboard.top_partners(D, AS_OF),
    "pending_grns": dashboard.pending_grns,
    "completed_operations": lambda D: dashboard.completed_operations(D, AS_OF),
    "operational_status": lambda D: dashboard.operational_status(D, AS_OF),
    "recent_transactions": dashboard.recent_transactions,
    "dashboard_stats": lambda D: dashboard.dashboard_stats(D, AS_OF),
    "dashboard_json": lambda D: dashboard.dashboard_json(D, AS_OF),
    "indent_status_counts": indents.indent_status_counts,
    "grn_summary": receipts.grn_summary,
    "grn_summary_distinct": lambda D: receipts.grn_summary(D, distinct=True),
    "po_receipt_status": receipts.po_receipt_status,
    "po_receipt_status_per_po": lambda D: receipts.po_receipt_status(D, per_po=True),
    "pending_value": receipts.pending_value,
    "pending_value_totals": receipts.pending_value_totals,
    "stock_on_hand": stock.stock_on_hand,
    "stock_on_hand_adjusted": lambda D: stock.stock_on_hand(D, sign="adjusted"),
    "part_stock_info": stock.part_stock_info,
    "stock_kpis": stock.stock_kpis,
    "stock_kpis_adjusted": lambda D: stock.stock_kpis(D, sign="adjusted"),
    "stock_valuation": stock.stock_valuation,
    "stock_value_total": stock.stock_value_total,
    "stock_running_balance": stock.stock_running_balance,
    "stock_running_balance_adjusted": lambda D: stock.stock_running_balance(D, sign="adjusted"),
    "movement_summary": stock.movement_summary,
    "project_stock": _project_stock,
    "part_margin": parts.part_margin,
    "parts_report": parts.parts_report,
    "parts_report_summary": parts.parts_report_summary,
    "parts_by_category": lambda D: parts.parts_by(D, "part_category"),
    "parts_by_type": lambda D: parts.parts_by(D, "part_type"),
    "part_directory_stats": lambda D: catalog.directory_stats(D, "part"),
    "vendor_directory_stats": lambda D: catalog.directory_stats(D, "vendor"),
    "customer_directory_stats": lambda D: catalog.directory_stats(D, "customer"),
    "vendor_states": lambda D: catalog.facet_values(D.vendor, "state"),
    "part_categories": lambda D: catalog.facet_values(D.part, "part_category"),
    "po_lines_with_tax": lambda D: _with_tax(D, PO),
    "invoice_lines_with_tax": lambda D: _with_tax(D, SI),
    "po_total_with_tax": lambda D: documents.document_total_with_tax(_form_lines(D, PO), D, PO),
}


def _reasons(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.concat_ws("; ", "reasons").alias("reasons"))


def _invoices(D: Tables) -> Posting:
    return post_docs.post_documents(D, SI, forms.invoice_forms(D), AS_OF)


def _order_edits(D: Tables) -> Posting:
    return post_docs.replace_documents(D, PO, forms.order_edits(D), AS_OF)


def _store(D: Tables, *names: str) -> tuple[Store, Manifest]:
    """The named tables as the first version of a new store."""
    spark = D.vendor.sparkSession
    store = Store(spark, _new_path(spark, "store"))
    return store, store.create(D, names)


def _stored_order_edits(D: Tables) -> Tables:
    """Orders stored, edited in the months that hold an edited order, and read back."""
    store, base = _store(D, PO.head, PO.tran)
    entered = forms.order_edits(store.tables(base))
    with store.staged(entered.heads, entered.lines) as files:
        edits = Batch(*files)
        near = store.around(base, PO.head, edits.heads.select(F.col("doc_no").alias("po_no")))
        posting = post_docs.replace_documents(near, PO, edits, AS_OF)
        return store.tables(store.commit(posting, "edits", base))


def _stored_deletions(D: Tables) -> Tables:
    """Invoices of inactive customers switched off in the store."""
    store, base = _store(D, SI.head, SI.tran)
    inactive = P.scoped(D.customer).filter("not active").select(
        F.col("customer_code").alias("customer")
    )
    keys = D.sales_invoice_head.join(inactive, "customer", "left_semi").select("inv_no")
    with store.listed(keys) as listed:
        near = store.around(base, SI.head, listed)
        posting = post_docs.soft_delete(near, "sales", listed, AS_OF)
        return store.tables(store.commit(posting, "deletions", base))


def _stored_receipts(D: Tables) -> Tables:
    """A batch of receipts saved as one version: heads, lines and ledger."""
    store, _ = _store(D, PO.head, GR.head, GR.tran, "stock_update")
    return store.tables(_receive(store, forms.receipt_forms(D)))


def _receive(store: Store, batch: Batch) -> Manifest:
    with store.staged(batch.heads, batch.lines) as files:
        return store.post(
            lambda base: post_stock.post_receipts(store.tables(base), Batch(*files), AS_OF), "receipts"
        )


def _stored_movements(D: Tables) -> Tables:
    """A batch of movements numbered after the stored highest number."""
    store, _ = _store(D, "stock_update")
    with store.staged(forms.movement_forms(D)) as (batch,):
        return store.tables(
            store.post(lambda base: post_stock.post_movements(store.tables(base), batch, AS_OF), "movements")
        )


def _stored_indents(D: Tables) -> Tables:
    """Decisions on stored indents, the batch sent twice."""
    store, _ = _store(D, "indent_request_head")
    decisions = forms.indent_decisions(D)
    for _ in range(2):
        current = store.post(
            lambda base: post_indents.transition_indents(store.tables(base), decisions), "decisions"
        )
    return store.tables(current)


def _stored_vendors(D: Tables) -> Tables:
    """Vendors of inactive orders switched off in the store."""
    store, base = _store(D, "vendor")
    return store.tables(store.commit(_deleted_vendors(D), "deletions", base))


def _deleted_orders(D: Tables) -> Posting:
    """The orders of inactive vendors."""
    inactive = D.vendor.filter("not active").select(F.col("vendor_code").alias("vendor"))
    keys = D.purchase_order_head.join(inactive, "vendor", "left_semi")
    return post_docs.soft_delete(D, "purchase", keys, AS_OF)


def _deleted_vendors(D: Tables) -> Posting:
    """The vendors of inactive orders; some of the keys are unknown."""
    keys = D.purchase_order_head.filter("not active").selectExpr(
        "case when po_no % 30 = 0 then -vendor else vendor end as vendor_code"
    )
    return post_docs.soft_delete(D, "vendor", keys, AS_OF)


def _receipts(D: Tables) -> Posting:
    return post_stock.post_receipts(D, forms.receipt_forms(D), AS_OF)


def _movements(D: Tables) -> Posting:
    return post_stock.post_movements(D, forms.movement_forms(D), AS_OF)


def _new_indents(D: Tables) -> Posting:
    return post_indents.create_indents(D, forms.new_indents(D), NOW)


def _indent_edits(D: Tables) -> Posting:
    return post_indents.update_indents(D, forms.indent_edits(D), NOW)


def _decisions(D: Tables, strict: bool = False) -> Posting:
    return post_indents.transition_indents(D, forms.indent_decisions(D), strict)


def _orders(D: Tables) -> Posting:
    return post_docs.post_documents(D, PO, forms.order_forms(D), AS_OF)


def _invoice_edits(D: Tables) -> Posting:
    return post_docs.replace_documents(D, SI, forms.invoice_edits(D), AS_OF)


def _deleted_invoices(D: Tables) -> Posting:
    """The invoices of inactive customers."""
    inactive = P.scoped(D.customer).filter("not active").select(
        F.col("customer_code").alias("customer")
    )
    keys = D.sales_invoice_head.join(inactive, "customer", "left_semi")
    return post_docs.soft_delete(D, "sales", keys, AS_OF)


def _deleted_customers(D: Tables) -> Posting:
    """The customers of inactive invoices."""
    keys = D.sales_invoice_head.filter("not active").selectExpr("customer as customer_code")
    return post_docs.soft_delete(D, "customer", keys, AS_OF)


def _deleted_parts(D: Tables) -> Posting:
    """The parts of inactive order lines."""
    keys = D.purchase_order_tran.filter("not active").selectExpr("partnum as part_num")
    return post_docs.soft_delete(D, "part", keys, AS_OF)


def _parts(D: Tables) -> Posting:
    return post_masters.upsert_master(D, "part", forms.part_forms(D), AS_OF)


LEDGER = ["update_id", "part_num", "type", "qty", "update_date"]


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _append_ledger(D: Tables) -> DataFrame:
    """The ledger appended by month and read back whole."""
    return _appended(D).select(*LEDGER)


def _append_ledger_years(D: Tables) -> DataFrame:
    """The same, read back for the months of three years only."""
    return _appended(D, "1996-01", "1998-12").select(*LEDGER)


def _appended(D: Tables, *months: str) -> DataFrame:
    rows = D.stock_update
    path = _new_path(rows.sparkSession, "ledger")
    append(rows, path, "update_date")
    return read_appended(rows.sparkSession, path, "stock_update", *months)


def _published(D: Tables) -> DataFrame:
    """Vendors and parts published, then the vendors after a deletion; the parts carry over."""
    spark = D.vendor.sparkSession
    path = _new_path(spark, "publication")
    publish(spark, {"vendor": D.vendor, "part": D.part}, path, 9)
    publish(spark, {"vendor": _deleted_vendors(D).state["vendor"]}, path, 10)
    current = published(spark, path)
    return current.vendor.selectExpr("'vendor' as entity", "vendor_code as code", "active").unionByName(
        current.part.selectExpr("'part' as entity", "part_num as code", "active")
    )


def _export_register(D: Tables) -> DataFrame:
    """The order register exported as CSV with display dates and read back."""
    register = documents.po_register(D)
    path = _new_path(register.sparkSession, "register")
    export_report(register, path, "csv", "day_first")
    layout = register.withColumn("po_date", F.lit("")).schema
    return register.sparkSession.read.csv(path, header=True, schema=layout)


def _loaded_register(D: Tables) -> DataFrame:
    """The order register of tables written as Parquet folders and loaded again."""
    spark = D.vendor.sparkSession
    path = _new_path(spark, "tables")
    for name in ("vendor", PO.head, PO.tran):
        getattr(D, name).write.parquet(f"{path}/{name}")
    return documents.po_register(load_tables(spark, path))


POSTINGS: dict[str, Callable[[Tables], DataFrame]] = {
    "post_invoices_heads": lambda D: _invoices(D).added[SI.head].select(
        "inv_no", "inv_dt", "customer", "active", "updated"
    ),
    "post_invoices_lines": lambda D: _invoices(D).added[SI.tran].select(
        "inv_no", "rowid", "partnum", "quantity", "unit_price", "amount", "active"
    ),
    "post_invoices_rejects": lambda D: _reasons(_invoices(D).rejects, "submission_id"),
    "post_orders_heads": lambda D: _orders(D).added[PO.head].select(
        "po_no", "po_date", "vendor", "active", "updated"
    ),
    "post_orders_lines": lambda D: _orders(D).added[PO.tran].select(
        "po_no", "rowid", "partnum", "quantity", "unit_price", "amount", "active"
    ),
    "post_orders_rejects": lambda D: _reasons(_orders(D).rejects, "submission_id"),
    "replace_invoices_heads": lambda D: _invoice_edits(D).state[SI.head].select(
        "inv_no", "inv_dt", "customer", "remarks", "active"
    ),
    "replace_invoices_lines": lambda D: _invoice_edits(D).state[SI.tran].select(
        "inv_no", "rowid", "partnum", "quantity", "amount", "active"
    ),
    "replace_invoices_rejects": lambda D: _reasons(_invoice_edits(D).rejects, "submission_id"),
    "delete_invoices_heads": lambda D: _deleted_invoices(D).state[SI.head].select(
        "inv_no", "active"
    ),
    "delete_invoices_lines": lambda D: _deleted_invoices(D).state[SI.tran].select(
        "inv_no", "rowid", "active"
    ),
    "delete_customers": lambda D: _deleted_customers(D).state["customer"].select(
        "customer_code", "active"
    ),
    "delete_parts": lambda D: _deleted_parts(D).state["part"].select("part_num", "active"),
    "upsert_customers": lambda D: post_masters.upsert_master(
        D, "customer", forms.customer_forms(D), AS_OF
    ).state["customer"].select("customer_code", "customer_name", "active"),
    "replace_orders_heads": lambda D: _order_edits(D).state[PO.head].select(
        "po_no", "po_date", "vendor", "remarks", "active"
    ),
    "replace_orders_lines": lambda D: _order_edits(D).state[PO.tran].select(
        "po_no", "rowid", "partnum", "quantity", "amount", "active"
    ),
    "replace_orders_rejects": lambda D: _reasons(_order_edits(D).rejects, "submission_id"),
    "delete_orders_heads": lambda D: _deleted_orders(D).state[PO.head].select("po_no", "active"),
    "delete_orders_lines": lambda D: _deleted_orders(D).state[PO.tran].select(
        "po_no", "rowid", "active"
    ),
    "delete_vendors": lambda D: _deleted_vendors(D).state["vendor"].select(
        "vendor_code", "active"
    ),
    "delete_vendors_rejects": lambda D: _reasons(_deleted_vendors(D).rejects, "vendor_code"),
    "post_receipts_heads": lambda D: _receipts(D).added[GR.head].select(
        "grn_no", "grn_dt", "po_no", "vendor", "active"
    ),
    "post_receipts_lines": lambda D: _receipts(D).added[GR.tran].select(
        "grn_no", "rowid", "partnum", "quantity", "unit_price", "amount"
    ),
    "post_receipts_movements": lambda D: _receipts(D).added["stock_update"].select(*LEDGER),
    "post_receipts_rejects": lambda D: _reasons(_receipts(D).rejects, "submission_id"),
    "post_receipts_on_hand": lambda D: stock.ledger_level(_receipts(D).apply(D)),
    "post_movements": lambda D: _movements(D).added["stock_update"].select(*LEDGER),
    "post_movements_rejects": lambda D: _reasons(_movements(D).rejects, "submission_id"),
    "post_adjustments": lambda D: post_stock.post_adjustments(
        D, forms.movement_forms(D), AS_OF
    ).added["stock_update"].select(*LEDGER),
    "create_indents_heads": lambda D: _new_indents(D).added["indent_request_head"].select(
        "indent_id", "indent_dt", "department", "requested_by", "status", "active"
    ),
    "create_indents_lines": lambda D: _new_indents(D).added["indent_request_tran"].select(
        "indent_id", "rowid", "partnum", "part_desc", "quantity", "required_date", "active"
    ),
    "create_indents_rejects": lambda D: _reasons(_new_indents(D).rejects, "submission_id"),
    "update_indents_heads": lambda D: _indent_edits(D).state["indent_request_head"].select(
        "indent_id", "indent_dt", "department", "remarks", "status"
    ),
    "update_indents_lines": lambda D: _indent_edits(D).state["indent_request_tran"].select(
        "indent_id", "rowid", "quantity", "active"
    ),
    "update_indents_rejects": lambda D: _reasons(_indent_edits(D).rejects, "submission_id"),
    "transition_indents": lambda D: _decisions(D).state["indent_request_head"].select(
        "indent_id", "status"
    ),
    "transition_indents_strict": lambda D: _decisions(D, True).state[
        "indent_request_head"
    ].select("indent_id", "status"),
    "transition_indents_rejects": lambda D: _reasons(
        _decisions(D).rejects, "indent_id", "status"
    ),
    "upsert_parts": lambda D: _parts(D).state["part"].select(
        "part_num", "part_desc", "part_category", "pur_price", "active"
    ),
    "upsert_parts_rejects": lambda D: _reasons(_parts(D).rejects, "submission_id"),
    "upsert_vendors": lambda D: post_masters.upsert_master(
        D, "vendor", forms.vendor_forms(D), AS_OF
    ).state["vendor"].select("vendor_code", "vendor_name", "gst", "active"),
    "validate_indent_heads": lambda D: _reasons(
        validation.validate(forms.indent_heads(D), "indent")[1], "indent_id"
    ),
    "validate_indent_heads_accepted": lambda D: validation.validate(
        forms.indent_heads(D), "indent"
    )[0].select("indent_id"),
    "validate_lines_accepted": lambda D: validation.validate(forms.tax_lines(D), "line")[
        0
    ].select("submission_id", "position"),
    "validate_vendors_accepted": lambda D: validation.validate(
        forms.shared_vendor_names(D), "vendor"
    )[0].select("vendor_code"),
    "validate_adjustments_accepted": lambda D: validation.validate(
        forms.movement_forms(D), "adjustment"
    )[0].select("submission_id"),
    "validate_documents_accepted": lambda D: validation.validate_documents(
        forms.invoice_forms(D)
    )[0].select("submission_id"),
    "validate_receipts_accepted": lambda D: validation.validate_receipts(
        D, forms.receipt_forms(D), per_po=True
    )[0].select("submission_id"),
    "validate_lines": lambda D: _reasons(
        validation.validate(forms.tax_lines(D), "line")[1], "submission_id", "position"
    ),
    "validate_vendors": lambda D: _reasons(
        validation.validate(forms.shared_vendor_names(D), "vendor")[1], "vendor_code"
    ),
    "validate_adjustments": lambda D: _reasons(
        validation.validate(forms.movement_forms(D), "adjustment")[1], "submission_id"
    ),
    "validate_indents": lambda D: _reasons(
        validation.validate(D.indent_request_head, "indent")[1], "indent_id"
    ),
    "validate_documents": lambda D: _reasons(
        validation.validate_documents(forms.invoice_forms(D))[1], "submission_id"
    ),
    "validate_receipts": lambda D: _reasons(
        validation.validate_receipts(D, forms.receipt_forms(D), per_po=True)[1], "submission_id"
    ),
}

ENTRIES = {
    "part": (forms.part_entries, ["submission_id"]),
    "customer": (forms.customer_entries, ["submission_id"]),
    "movement": (forms.movement_entries, ["submission_id"]),
    "indent_line": (forms.indent_line_entries, ["submission_id", "position"]),
}


def _entries(kind: str) -> dict[str, Callable[[Tables], DataFrame]]:
    """The entry checks of one kind: rows with reasons, and rows that pass."""
    entered, keys = ENTRIES[kind]
    return {
        f"validate_{kind}_entries": lambda D: _reasons(validation.validate(entered(D), kind)[1], *keys),
        f"validate_{kind}_entries_accepted": lambda D: validation.validate(entered(D), kind)[0].select(*keys),
    }


for _kind in ENTRIES:
    POSTINGS |= _entries(_kind)


def _registered(report: Callable[[Tables], DataFrame]):
    return lambda spark, sf_dir: _doubles(report(star_tables(spark, sf_dir)))


def _kept_levels(D: Tables) -> tuple[Store, Manifest]:
    """The stored ledger with the levels at the end of two years kept."""
    store, _ = _store(D, "part", "unit", PO.head, "stock_update")
    keep_levels(store, "1996-12")
    return store, keep_levels(store, "1999-12")


def _late_levels(D: Tables) -> DataFrame:
    """Levels after a batch of receipts of which most are dated before the kept levels."""
    store, _ = _kept_levels(D)
    return stock.ledger_level(store.tables(_receive(store, forms.receipt_forms(D))))


def _stored_summary(D: Tables, kind: documents.DocumentKind, **filters) -> DataFrame:
    """A history summary of stored documents from monthly sums."""
    store, _ = _store(D, "part", "unit", kind.party_table, kind.head, kind.tran)
    return stored_summary(store, keep_sums(store, kind), kind, **filters)


def _found_vendors(D: Tables) -> DataFrame:
    """Vendors of active orders, found in the store by key."""
    store, current = _store(D, "vendor")
    ordered = D.purchase_order_head.filter("active").select(F.col("vendor").alias("vendor_code"))
    return store.find(current, "vendor", ordered).select("vendor_code", "vendor_name", "state", "active")


def _found_orders(D: Tables) -> DataFrame:
    """The lines of the orders of one vendor in a hundred, found in the store by order number."""
    store, current = _store(D, PO.head, PO.tran)
    keys = D.purchase_order_head.filter("vendor % 100 = 7").select("po_no")
    return store.find(current, PO.tran, keys).select("po_no", "rowid", "partnum", "amount", "active")


def _stored_history(D: Tables) -> DataFrame:
    """The filtered purchase history of stored orders, which reads the months asked for."""
    store, current = _store(D, "part", "unit", "vendor", PO.head, PO.tran)
    near = store.between(current, FILTERS["date_from"], FILTERS["date_to"])
    return history.purchase_history(near, **FILTERS)


STORED: dict[str, Callable[[Tables], DataFrame]] = {
    "stored_order_edits_heads": lambda D: _stored_order_edits(D).purchase_order_head.select(
        "po_no", "po_date", "vendor", "remarks", "active"
    ),
    "stored_order_edits_lines": lambda D: _stored_order_edits(D).purchase_order_tran.select(
        "po_no", "rowid", "partnum", "quantity", "amount", "active"
    ),
    "stored_deletions_heads": lambda D: _stored_deletions(D).sales_invoice_head.select(
        "inv_no", "active"
    ),
    "stored_deletions_lines": lambda D: _stored_deletions(D).sales_invoice_tran.select(
        "inv_no", "rowid", "active"
    ),
    "stored_receipts_heads": lambda D: _stored_receipts(D).goods_receipt_head.select(
        "grn_no", "grn_dt", "po_no", "vendor", "active"
    ),
    "stored_receipts_lines": lambda D: _stored_receipts(D).goods_receipt_tran.select(
        "grn_no", "rowid", "partnum", "quantity", "unit_price", "amount"
    ),
    "stored_receipts_ledger": lambda D: _stored_receipts(D).stock_update.select(*LEDGER),
    "stored_movements": lambda D: _stored_movements(D).stock_update.select(*LEDGER),
    "stored_stock_on_hand": lambda D: stock.stock_on_hand(_kept_levels(D)[0].tables()),
    "stored_levels_late": _late_levels,
    "stored_balance_years": lambda D: balance_between(*_kept_levels(D), "1997-01", "1998-12"),
    "stored_purchase_summary": lambda D: _stored_summary(D, PO),
    "stored_purchase_summary_filtered": lambda D: _stored_summary(D, PO, **FILTERS),
    "stored_sales_summary_days": lambda D: _stored_summary(
        D, SI, part="bolt", date_from="1996-01-15", date_to="1998-03-10"
    ),
    "stored_vendor_lookup": _found_vendors,
    "stored_order_lookup": _found_orders,
    "stored_purchase_history": _stored_history,
    "stored_indent_decisions": lambda D: _stored_indents(D).indent_request_head.select(
        "indent_id", "status"
    ),
    "stored_vendor_deletions": lambda D: _stored_vendors(D).vendor.select("vendor_code", "active"),
}

SINKS = {
    "loaded_po_register": _loaded_register,
    "append_ledger": _append_ledger,
    "append_ledger_years": _append_ledger_years,
    "published_tables": _published,
    "export_po_register": _export_register,
}


ALL = {**REPORTS, **POSTINGS, **STORED, **SINKS}


def _llm() -> tuple[dict, dict]:
    """Queries and DuckDB text of the training-data operators, where that subpackage is installed."""
    if importlib.util.find_spec("tallyhouse.llm") is None:
        return {}, {}
    import corpus_pipeline
    from tallyhouse.llm import queries as llm

    return {**llm.QUERIES, "pipeline": corpus_pipeline.run}, llm.ORACLE


def entry(spark: SparkSession) -> DataFrame:
    """The purchase order register over the smallest data set."""
    return _doubles(documents.po_register(star_tables(spark, "/root/testdata/sf0.001")))


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _registered(report) for name, report in ALL.items()}


def core_oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in {**READS, **POSTS, **STORED_TEXT}.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core_queries() | _llm()[0]


def oracle_sql() -> dict[str, str]:
    return core_oracle_sql() | _llm()[1]
