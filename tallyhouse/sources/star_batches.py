"""Batches of submitted forms derived from the star schema, one form per source row or
document, with the faults a posting must handle: blank and unreadable fields, unknown
and repeated numbers, missing dates, forms without a valid line."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhouse.plans.batches import Batch
from tallyhouse.tables import Tables


def _shaped(df: DataFrame, **expressions: str) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in expressions.items()])


def invoice_forms(D: Tables) -> Batch:
    """Every invoice entered again as a new form."""
    heads = _shaped(
        D.sales_invoice_head,
        submission_id="inv_no",
        doc_no="""case when inv_no % 13 = 0 then inv_no
            when inv_no % 11 = 0 then -inv_no
            when inv_no % 17 = 0 then -1 - customer % 5 end""",
        doc_date="case when inv_no % 19 <> 0 then inv_dt end",
        party="customer",
        remarks="cast(null as string)",
    )
    return Batch(heads, _entered(D.sales_invoice_tran, "inv_no"))


def order_forms(D: Tables) -> Batch:
    """Every purchase order entered again as a new form."""
    heads = _shaped(
        D.purchase_order_head,
        submission_id="po_no",
        doc_no="""case when po_no % 13 = 0 then po_no when po_no % 11 = 0 then -po_no
            when po_no % 17 = 0 then -1 - vendor % 5 end""",
        doc_date="case when po_no % 19 <> 0 then po_date end",
        party="vendor",
        remarks="cast(null as string)",
    )
    return Batch(heads, _entered(D.purchase_order_tran, "po_no"))


def invoice_edits(D: Tables) -> Batch:
    """Every invoice edited once under its own number, every thirty-first under an unknown one."""
    heads = _shaped(
        D.sales_invoice_head,
        submission_id="inv_no",
        doc_no="case when inv_no % 31 = 0 then -inv_no - 1 else inv_no end",
        doc_date="date_add(inv_dt, 1)",
        party="customer",
        remarks="'edited'",
        active="inv_no % 2 = 0",
    )
    lines = _shaped(
        D.sales_invoice_tran,
        submission_id="inv_no",
        position="rowid",
        part_num="cast(partnum as string)",
        quantity="case when partnum % 8 = 3 then '' else cast(quantity as string) end",
        rate="cast(unit_price as string)",
    )
    return Batch(heads, lines)


def customer_forms(D: Tables) -> DataFrame:
    """Every customer's form under a new name."""
    return _shaped(
        D.customer,
        submission_id="customer_code",
        customer_code="cast(customer_code as string)",
        customer_name="concat(customer_name, ' Ltd ')",
        state="state",
        active="case when customer_code % 3 = 0 then 'on' else 'off' end",
    )


def indent_heads(D: Tables) -> DataFrame:
    """Indents of which every other one has a requester's name without digits."""
    return D.indent_request_head.withColumn(
        "requested_by",
        F.when(F.col("indent_id") % 2 == 0, F.lit("Store Keeper")).otherwise(F.col("requested_by")),
    )


def _entered(lines: DataFrame, number: str) -> DataFrame:
    return _shaped(
        lines,
        submission_id=number,
        position="rowid",
        part_num="cast(partnum as string)",
        quantity="""case when partnum % 8 = 3 then '' when partnum % 1001 = 7 then 'abc'
            else cast(quantity as string) end""",
        rate="cast(unit_price as string)",
    )


def order_edits(D: Tables) -> Batch:
    """Every purchase order edited once, every tenth one twice."""
    twice = F.when(F.col("po_no") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    heads = _shaped(
        D.purchase_order_head.withColumn("k", F.explode(twice)),
        submission_id="po_no * 2 + k",
        doc_no="case when po_no % 31 = 0 then -po_no else po_no end",
        doc_date="date_add(po_date, k + 1)",
        party="vendor",
        remarks="concat('edit ', k)",
        active="po_no % 2 = 0",
    )
    lines = _shaped(
        D.purchase_order_tran.withColumn("k", F.explode(twice)),
        submission_id="po_no * 2 + k",
        position="rowid",
        part_num="cast(partnum as string)",
        quantity="case when partnum % 8 = 3 then '' else cast(quantity + k as string) end",
        rate="cast(unit_price as string)",
    )
    return Batch(heads, lines)


def receipt_forms(D: Tables) -> Batch:
    """One receipt form per purchase order; every seventh names an unknown order."""
    heads = _shaped(
        D.purchase_order_head,
        submission_id="po_no",
        po_no="case when po_no % 7 = 0 then -po_no else po_no end",
        grn_date="case when po_no % 23 <> 0 then date_add(po_date, 20) end",
    )
    return Batch(heads, _entered(D.purchase_order_tran, "po_no"))


def movement_forms(D: Tables) -> DataFrame:
    """Every ledger row entered again, whatever its type and with or without a part."""
    return _shaped(
        D.stock_update,
        submission_id="update_id",
        part_num="part_num",
        type="type",
        quantity="qty",
        reason="case when part_num % 5 = 0 then 'Other' when part_num % 5 = 1 then 'Mood' end",
    )


def _indent_lines(D: Tables) -> DataFrame:
    return _shaped(
        D.indent_request_tran,
        submission_id="indent_id",
        position="rowid",
        part_num="cast(partnum as string)",
        part_desc="part_desc",
        quantity="""case when indent_id % 7 = 0 then '0' when indent_id % 29 = 0 then 'x'
            else cast(quantity as string) end""",
        required_date="cast(required_date as string)",
        item_remarks="cast(null as string)",
    )


def new_indents(D: Tables) -> Batch:
    """Every indent entered again; every ninth under its existing number."""
    heads = _shaped(
        D.indent_request_head,
        submission_id="indent_id",
        indent_id="case when indent_id % 9 = 0 then indent_id end",
        indent_dt="indent_dt",
        department="department",
        requested_by="requested_by",
        remarks="cast(null as string)",
    )
    return Batch(heads, _indent_lines(D))


def indent_edits(D: Tables) -> Batch:
    """Every indent edited; every twentieth form names an unknown one."""
    heads = _shaped(
        D.indent_request_head,
        submission_id="indent_id",
        indent_id="case when indent_id % 20 = 0 then -indent_id - 1 else indent_id end",
        indent_dt="date_add(indent_dt, 1)",
        department="'ADMIN'",
        requested_by="requested_by",
        remarks="'edited'",
    )
    return Batch(heads, _indent_lines(D))


def indent_decisions(D: Tables) -> DataFrame:
    """One decision per indent, every third indent decided again a day later."""
    again = F.when(F.col("indent_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    return _shaped(
        D.indent_request_head.withColumn("k", F.explode(again)),
        indent_id="case when indent_id % 50 = 0 then -indent_id - 1 else indent_id end",
        status="""case when (indent_id + k) % 2 = 0 then 'APPROVED'
            when indent_id % 5 = 0 then 'OPEN' else 'REJECTED' end""",
        updated="cast(date_add(indent_dt, 30 + k) as timestamp)",
    )


def part_forms(D: Tables) -> DataFrame:
    """Every part's form: updates, inserts under a new code, and forms without a code."""
    return _shaped(
        D.part,
        submission_id="part_num",
        part_num="""case when part_num % 6 = 0 then ' ' when part_num % 5 = 0
            then cast(-part_num as string) when part_num % 4 = 0
            then cast(part_num div 8 * 8 + 1 as string) else cast(part_num as string) end""",
        part_desc="case when part_num % 40 = 1 then '' else concat(part_desc, ' v2') end",
        part_type="part_type",
        part_category="part_category",
        pur_price="""case when part_num % 41 = 0 then 'abc'
            else cast(sell_price as string) end""",
        sell_price="cast(sell_price as string)",
        tax_percent="cast(tax_percent as string)",
        active="case when part_num % 2 = 1 then 'on' end",
    )


def vendor_forms(D: Tables) -> DataFrame:
    """Every vendor's form with a lower-case tax number."""
    return _shaped(
        D.vendor,
        submission_id="vendor_code",
        vendor_code="cast(vendor_code as string)",
        vendor_name="concat(' ', vendor_name)",
        state="state",
        gst="lower(gst)",
        pan="pan",
        active="case when vendor_code % 3 = 0 then 'on' else 'off' end",
    )


def tax_lines(D: Tables) -> DataFrame:
    """Order lines as entered text with quantities and taxes around the limits."""
    return _shaped(
        D.purchase_order_tran,
        submission_id="po_no",
        position="rowid",
        part_num="case when partnum % 97 <> 0 then cast(partnum as string) else '' end",
        quantity="""case when partnum % 8 = 3 then '' when partnum % 8 = 4 then '0'
            else cast(quantity * 25000 as string) end""",
        rate="cast(unit_price as string)",
        tax_percent="cast(partnum % 103 as string)",
    )


def shared_vendor_names(D: Tables) -> DataFrame:
    """Vendor forms of which every other name has letters and signs only."""
    return D.vendor.select(
        F.col("vendor_code"),
        F.when(F.col("vendor_code") % 2 == 0, F.lit("Smith & Sons (Pvt.)"))
        .otherwise(F.col("vendor_name"))
        .alias("vendor_name"),
        "gst",
        "pan",
    )


def part_entries(D: Tables) -> DataFrame:
    """Parts as typed into the entry form, with names, types and costing methods in and outside the choices."""
    return _shaped(
        D.part,
        submission_id="part_num",
        part_num="case when part_num % 50 <> 0 then cast(part_num as string) end",
        part_desc="""case part_num % 7 when 0 then '' when 1 then 'Valve (brass) 1/2'
            when 2 then 'Valve - brass.' else part_desc end""",
        part_type="""case part_num % 5 when 0 then 'Raw Material' when 1 then 'Service'
            when 2 then '' when 3 then part_type end""",
        costing="case part_num % 4 when 0 then 'FIFO' when 1 then 'Average' when 2 then 'HIFO' end",
    )


def customer_entries(D: Tables) -> DataFrame:
    """Customers as typed in: codes, names and tax numbers present, absent and misspelt."""
    return _shaped(
        D.customer,
        submission_id="customer_code",
        customer_code="case when customer_code % 40 = 0 then '' else cast(customer_code as string) end",
        customer_name="""case customer_code % 3 when 0 then 'Shah & Sons (East)'
            when 1 then customer_name else case when customer_code % 9 <> 8 then 'A/B Traders' end end""",
        gst="""case customer_code % 4 when 0 then '27ABCDE1234F1Z5' when 1 then '27abcde1234f1z5'
            when 2 then '' end""",
        pan="case customer_code % 5 when 0 then 'ABCDE1234F' when 1 then 'ABCDE12345' end",
    )


def movement_entries(D: Tables) -> DataFrame:
    """Movements as typed in, with quantities around the limits."""
    return _shaped(
        D.stock_update,
        submission_id="update_id",
        part_num="cast(part_num as string)",
        type="case when update_id % 6 <> 0 then type end",
        quantity="""case update_id % 8 when 0 then '0' when 1 then '1000000' when 2 then 'ten'
            when 3 then '' when 4 then '0.01' when 5 then '999999' else cast(qty as string) end""",
    )


def indent_line_entries(D: Tables) -> DataFrame:
    """Indent lines as typed in."""
    return _shaped(
        D.indent_request_tran,
        submission_id="indent_id",
        position="rowid",
        part_num="case when partnum % 10 <> 0 then cast(partnum as string) else '' end",
        quantity="""case when indent_id % 9 = 0 then '' when indent_id % 9 = 1 then '-1'
            else cast(quantity as string) end""",
    )
