"""DuckDB text of what stored tables hold after their batches."""

from oracle_posts import POSTS, RECEIPT_FORMS
from oracle_reads import READS, SI, _summary, d

STORED_TEXT = {
    "loaded_po_register": READS["po_register"],
    "stored_order_edits_heads": POSTS["replace_orders_heads"],
    "stored_order_edits_lines": POSTS["replace_orders_lines"],
    "stored_deletions_heads": POSTS["delete_invoices_heads"],
    "stored_deletions_lines": POSTS["delete_invoices_lines"],
    "stored_receipts_heads": f"""with {RECEIPT_FORMS}
        select grn_no, grn_dt, po_no, vendor, active from goods_receipt_head_t
        union all select grn_no, grn_dt, po_no, vendor, true from posted""",
    "stored_receipts_lines": f"""with {RECEIPT_FORMS}
        select grn_no, rowid, partnum, {d("quantity")}, {d("unit_price")}, {d("amount")}
        from goods_receipt_tran_t
        union all select grn_no, rowid, partnum, quantity, unit_price,
            cast(quantity * unit_price as decimal(18,2)) from received""",
    "stored_receipts_ledger": f"""with {RECEIPT_FORMS}
        select update_id, part_num, type, {d("qty")}, update_date from stock_update_t
        union all select update_id, partnum, 'IN', quantity, grn_dt from received""",
    "stored_movements": f"""
        select update_id, part_num, type, {d("qty")}, update_date from stock_update_t
        union all select * from ({POSTS["post_movements"]}) x""",
    "stored_stock_on_hand": READS["stock_on_hand"],
    "stored_levels_late": POSTS["post_receipts_on_hand"],
    "stored_balance_years": f"""select * from ({READS["stock_running_balance"]}) b
        where update_date between DATE '1997-01-01' and DATE '1998-12-31'""",
    "stored_purchase_summary": READS["purchase_summary"],
    "stored_purchase_summary_filtered": READS["purchase_summary_filtered"],
    "stored_sales_summary_days": _summary(
        SI,
        "and p.part_desc ilike '%bolt%' and h.inv_dt >= DATE '1996-01-15' and h.inv_dt <= DATE '1998-03-10'",
    ),
    "stored_vendor_lookup": READS["vendors_of_active_orders"],
    "stored_order_lookup": f"""
        select t.po_no, t.rowid, t.partnum, {d("t.amount")}, t.active
        from purchase_order_tran_t t join purchase_order_head_t h on t.po_no = h.po_no
        where h.vendor % 100 = 7""",
    "stored_purchase_history": READS["purchase_history_filtered"],
    "stored_indent_decisions": POSTS["transition_indents"],
    "stored_vendor_deletions": POSTS["delete_vendors"],
}
