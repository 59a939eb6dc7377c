"""DuckDB text of the posting jobs: what the tables hold after a batch."""

from oracle_reads import AS_OF, PO, _register, d

START = "(select coalesce(max({col}), 0) from {table})"


def _document_forms(no, date, party, table):
    return f"""
    forms as (select {no} as submission_id,
        case when {no} % 13 = 0 then {no} when {no} % 11 = 0 then -{no}
            when {no} % 17 = 0 then -1 - {party} % 5 end as doc_no,
        case when {no} % 19 <> 0 then {date} end as doc_date, {party} as party
        from {table}_head_t),
    form_lines as (select {no} as submission_id, rowid, partnum,
        case when partnum % 1001 = 7 then null else quantity end as quantity, unit_price
        from {table}_tran_t where partnum % 8 <> 3),
    checked as (select f.*, concat_ws('; ',
            case when doc_date is null then 'missing date' end,
            case when party is null then 'missing party' end,
            case when submission_id in (select submission_id from form_lines
                where quantity is null) then 'unreadable line' end,
            case when doc_no in (select {no} from {table}_head_t)
                then 'number exists' end) as reasons
        from forms f),
    firsts as (select doc_no, min(submission_id) as first_id from checked
        where reasons = '' and doc_no is not null group by doc_no),
    final as (select c.submission_id, c.doc_no, c.doc_date, c.party,
            case when c.reasons = '' and x.first_id <> c.submission_id
                then 'number repeated in batch' else c.reasons end as reasons
        from checked c left join firsts x on c.doc_no = x.doc_no),
    starting as (select greatest((select max({no}) from {table}_head_t),
        (select coalesce(max(doc_no), 0) from final where reasons = '')) as n),
    posted as (select submission_id, doc_date, party,
            coalesce(doc_no, n + row_number() over (
                partition by doc_no is null order by submission_id)) as {no}
        from final, starting where reasons = '')
"""


INVOICE_FORMS = _document_forms("inv_no", "inv_dt", "customer", "sales_invoice")
ORDER_FORMS = _document_forms("po_no", "po_date", "vendor", "purchase_order")

RECEIPT_FORMS = f"""
    forms as (select po_no as submission_id,
        case when po_no % 7 = 0 then -po_no else po_no end as po_no,
        case when po_no % 23 <> 0 then cast(po_date + interval '20' day as date) end as grn_date
        from purchase_order_head_t),
    form_lines as (select po_no as submission_id, rowid, partnum,
        case when partnum % 1001 = 7 then null else quantity end as quantity, unit_price
        from purchase_order_tran_t where partnum % 8 <> 3),
    checked as (select f.*, h.vendor, concat_ws('; ',
            case when h.po_no is null then 'unknown purchase order' end,
            case when f.grn_date is null then 'missing date' end,
            case when f.submission_id in (select submission_id from form_lines
                where quantity is null) then 'unreadable line' end) as reasons
        from forms f left join purchase_order_head_t h on f.po_no = h.po_no),
    posted as (select submission_id, po_no, vendor, grn_date as grn_dt,
            {START.format(col="grn_no", table="goods_receipt_head_t")}
                + row_number() over (order by submission_id) as grn_no
        from checked where reasons = ''),
    received as (select p.grn_no, p.grn_dt, l.*,
            {START.format(col="update_id", table="stock_update_t")}
                + row_number() over (order by l.submission_id, l.rowid) as update_id
        from form_lines l join posted p on l.submission_id = p.submission_id)
"""

EDIT_FORMS = """
    edits as (select h.po_no * 2 + k as submission_id, h.po_no,
        cast(h.po_date + to_days(cast(k + 1 as integer)) as date) as doc_date, h.vendor,
        'edit ' || k as remarks,
        h.po_no % 2 = 0 as active
        from purchase_order_head_t h, (values (0), (1)) n(k)
        where (k = 0 or h.po_no % 10 = 0) and h.po_no % 31 <> 0),
    last as (select * from (select *, max(submission_id) over (partition by po_no) as m
        from edits) e where submission_id = m)
"""

INDENT_LINES = """
    form_lines as (select indent_id as submission_id, rowid, partnum, part_desc,
        case when indent_id % 7 = 0 then 0 when indent_id % 29 = 0 then null
            else quantity end as quantity, required_date
        from indent_request_tran_t),
    facts as (select h.indent_id as submission_id,
            count(case when l.quantity > 0 then 1 end) as valid_lines,
            count(case when l.submission_id is not null and l.quantity is null
                then 1 end) as broken
        from indent_request_head_t h left join form_lines l on l.submission_id = h.indent_id
        group by 1)
"""

NEW_INDENTS = f"""
    {INDENT_LINES},
    checked as (select h.*, concat_ws('; ',
            case when f.broken > 0 then 'unreadable line' end,
            case when f.valid_lines = 0 then 'no valid item' end,
            case when h.indent_id % 9 = 0 then 'number exists' end) as reasons
        from indent_request_head_t h join facts f on f.submission_id = h.indent_id),
    posted as (select indent_id as submission_id, indent_dt, department, requested_by,
            {START.format(col="indent_id", table="indent_request_head_t")}
                + row_number() over (order by indent_id) as indent_id
        from checked where reasons = '')
"""

EDITED_INDENTS = f"""
    {INDENT_LINES},
    checked as (select h.indent_id as submission_id,
            case when h.indent_id % 20 = 0 then -h.indent_id - 1 else h.indent_id end as target,
            concat_ws('; ', case when h.indent_id % 20 = 0 then 'not found' end,
                case when h.indent_id % 20 <> 0 and h.status <> 'PENDING'
                    then 'not pending' end,
                case when f.broken > 0 then 'unreadable line' end,
                case when f.valid_lines = 0 then 'no valid item' end) as reasons
        from indent_request_head_t h join facts f on f.submission_id = h.indent_id),
    done as (select target from checked where reasons = '')
"""

DECISIONS = """
    decisions as (select
        case when h.indent_id % 50 = 0 then -h.indent_id - 1 else h.indent_id end as indent_id,
        case when (h.indent_id + k) % 2 = 0 then 'APPROVED' when h.indent_id % 5 = 0 then 'OPEN'
            else 'REJECTED' end as status, k
        from indent_request_head_t h, (values (0), (1)) n(k)
        where k = 0 or h.indent_id % 3 = 0),
    facts as (select x.*, h.status as current_status from decisions x
        left join indent_request_head_t h on h.indent_id = x.indent_id)
"""


def _movements(types):
    return f"""
        select {START.format(col="update_id", table="stock_update_t")}
                + row_number() over (order by update_id) as update_id,
            part_num, type, {d("qty")}, {AS_OF} as update_date
        from stock_update_t where part_num is not null and type in {types}
    """


PART_FORMS = f"""
    forms as (select part_num as submission_id,
        case when part_num % 6 = 0 then null when part_num % 5 = 0 then -part_num
            when part_num % 4 = 0 then part_num // 8 * 8 + 1 else part_num end as code,
        case when part_num % 40 = 1 then null else part_desc || ' v2' end as part_desc,
        part_num % 41 = 0 as unread, sell_price, part_category, part_num % 2 = 1 as active
        from part_t),
    sound as (select * from forms where part_desc is not null and not unread),
    starting as (select greatest((select max(part_num) from part_t),
        (select coalesce(max(code), 0) from sound)) as n),
    coded as (select submission_id, part_desc, sell_price, part_category, active,
            coalesce(code, n + row_number() over (
                partition by code is null order by submission_id)) as code
        from sound, starting),
    latest as (select * from (select *, max(submission_id) over (partition by code) as m,
        count(*) over (partition by code) as forms from coded) x where submission_id = m)
"""

PENDING_PER_PART = """
    pending as (select t.po_no, t.partnum,
            max(t.quantity - coalesce(r.total, 0)) as pending
        from purchase_order_tran_t t
        left join (select h.po_no, g.partnum, sum(g.quantity) as total
            from goods_receipt_tran_t g join goods_receipt_head_t h on g.grn_no = h.grn_no
            where g.active group by 1, 2) r on t.po_no = r.po_no and t.partnum = r.partnum
        where t.active group by 1, 2)
"""

POSTS = {
    "post_invoices_heads": f"""with {INVOICE_FORMS}
        select inv_no, doc_date as inv_dt, party as customer, true as active,
            {AS_OF} as updated from posted""",
    "post_invoices_lines": f"""with {INVOICE_FORMS}
        select p.inv_no, l.rowid, l.partnum, {d("l.quantity")}, {d("l.unit_price")},
            {d("cast(l.quantity * l.unit_price as decimal(18,2))", "amount")}, true as active
        from form_lines l join posted p on l.submission_id = p.submission_id""",
    "post_invoices_rejects": f"""with {INVOICE_FORMS}
        select submission_id, reasons from final where reasons <> ''""",
    "post_orders_heads": f"""with {ORDER_FORMS}
        select po_no, doc_date as po_date, party as vendor, true as active,
            {AS_OF} as updated from posted""",
    "post_orders_lines": f"""with {ORDER_FORMS}
        select p.po_no, l.rowid, l.partnum, {d("l.quantity")}, {d("l.unit_price")},
            {d("cast(l.quantity * l.unit_price as decimal(18,2))", "amount")}, true as active
        from form_lines l join posted p on l.submission_id = p.submission_id""",
    "post_orders_rejects": f"""with {ORDER_FORMS}
        select submission_id, reasons from final where reasons <> ''""",
    "replace_invoices_heads": """
        select inv_no, case when inv_no % 31 = 0 then inv_dt
                else cast(inv_dt + interval '1' day as date) end as inv_dt, customer,
            case when inv_no % 31 <> 0 then 'edited' end as remarks,
            case when inv_no % 31 = 0 then active else inv_no % 2 = 0 end as active
        from sales_invoice_head_t""",
    "replace_invoices_lines": f"""
        with edited as (select inv_no from sales_invoice_head_t where inv_no % 31 <> 0)
        select inv_no, rowid, partnum, {d("quantity")}, {d("amount")},
            active and inv_no not in (select inv_no from edited) as active
        from sales_invoice_tran_t
        union all
        select inv_no, rowid, partnum, {d("quantity")}, {d("amount")}, true
        from sales_invoice_tran_t
        where partnum % 8 <> 3 and inv_no in (select inv_no from edited)""",
    "replace_invoices_rejects": """
        select inv_no as submission_id, 'unknown document' as reasons
        from sales_invoice_head_t where inv_no % 31 = 0""",
    "delete_invoices_heads": """
        select inv_no, active and customer not in (
            select customer_code from customer_t where company = 1 and not active) as active
        from sales_invoice_head_t""",
    "delete_invoices_lines": """
        select t.inv_no, t.rowid, t.active and h.inv_no is null as active
        from sales_invoice_tran_t t left join sales_invoice_head_t h
            on t.inv_no = h.inv_no and h.customer in (
                select customer_code from customer_t where company = 1 and not active)""",
    "delete_customers": """
        select customer_code, active and not (company = 1 and customer_code in (
            select customer from sales_invoice_head_t where not active)) as active
        from customer_t""",
    "delete_parts": """
        select part_num, active and part_num not in (
            select partnum from purchase_order_tran_t where not active) as active
        from part_t""",
    "upsert_customers": """
        select customer_code, case when company = 1 then customer_name || ' Ltd'
            else customer_name end as customer_name,
            case when company = 1 then customer_code % 3 = 0 else active end as active
        from customer_t
        union all select customer_code, customer_name || ' Ltd', true
        from customer_t where company = 2""",
    "replace_orders_heads": f"""with {EDIT_FORMS}
        select h.po_no, coalesce(e.doc_date, h.po_date) as po_date, h.vendor, e.remarks,
            case when e.po_no is not null then e.active else h.active end as active
        from purchase_order_head_t h left join last e on h.po_no = e.po_no""",
    "replace_orders_lines": f"""with {EDIT_FORMS}
        select t.po_no, t.rowid, t.partnum, {d("t.quantity")}, {d("t.amount")},
            t.active and e.po_no is null as active
        from purchase_order_tran_t t left join last e on t.po_no = e.po_no
        union all
        select t.po_no, t.rowid, t.partnum,
            {d("t.quantity + (e.submission_id - e.po_no * 2)", "quantity")},
            {d("cast((t.quantity + (e.submission_id - e.po_no * 2)) * t.unit_price"
               " as decimal(18,2))", "amount")},
            e.submission_id = l.submission_id as active
        from purchase_order_tran_t t
        join edits e on t.po_no = e.po_no join last l on t.po_no = l.po_no
        where t.partnum % 8 <> 3""",
    "replace_orders_rejects": """
        select h.po_no * 2 + k as submission_id, 'unknown document' as reasons
        from purchase_order_head_t h, (values (0), (1)) n(k)
        where (k = 0 or h.po_no % 10 = 0) and h.po_no % 31 = 0""",
    "delete_orders_heads": """
        select h.po_no, h.active and not coalesce(not v.active, false) as active
        from purchase_order_head_t h left join vendor_t v on h.vendor = v.vendor_code""",
    "delete_orders_lines": """
        select t.po_no, t.rowid, t.active and not coalesce(not v.active, false) as active
        from purchase_order_tran_t t
        join purchase_order_head_t h on t.po_no = h.po_no
        left join vendor_t v on h.vendor = v.vendor_code""",
    "delete_vendors": """
        select vendor_code, active and not (company = 1 and vendor_code in (
            select case when po_no % 30 = 0 then -vendor else vendor end
            from purchase_order_head_t where not active)) as active
        from vendor_t""",
    "delete_vendors_rejects": """
        with keys as (select distinct case when po_no % 30 = 0 then -vendor else vendor end as vendor_code
            from purchase_order_head_t where not active)
        select vendor_code, 'not found' as reasons from keys
        where vendor_code not in (select vendor_code from vendor_t where company = 1)""",
    "post_receipts_heads": f"""with {RECEIPT_FORMS}
        select grn_no, grn_dt, po_no, vendor, true as active from posted""",
    "post_receipts_lines": f"""with {RECEIPT_FORMS}
        select grn_no, rowid, partnum, {d("quantity")}, {d("unit_price")},
            {d("cast(quantity * unit_price as decimal(18,2))", "amount")} from received""",
    "post_receipts_movements": f"""with {RECEIPT_FORMS}
        select update_id, partnum as part_num, 'IN' as type, {d("quantity", "qty")},
            grn_dt as update_date from received""",
    "post_receipts_rejects": f"""with {RECEIPT_FORMS}
        select submission_id, reasons from checked where reasons <> ''""",
    "post_receipts_on_hand": f"""with {RECEIPT_FORMS}
        select part_num, {d("sum(q)", "current_stock")} from (
            select part_num, case when type = 'IN' then qty else -qty end as q
                from stock_update_t where part_num is not null
            union all select partnum, quantity from received) x group by part_num""",
    "append_ledger": f"""
        select update_id, part_num, type, {d("qty")}, update_date from stock_update_t""",
    "published_tables": """
        select 'vendor' as entity, vendor_code as code, active and not (company = 1 and vendor_code in (
            select case when po_no % 30 = 0 then -vendor else vendor end
            from purchase_order_head_t where not active)) as active
        from vendor_t
        union all select 'part', part_num, active from part_t""",
    "append_ledger_years": f"""
        select update_id, part_num, type, {d("qty")}, update_date from stock_update_t
        where update_date between DATE '1996-01-01' and DATE '1998-12-31'""",
    "export_po_register": f"""
        select po_no, strftime(po_date, '%d-%m-%Y') as po_date, vendor_name, active, line_items,
            total_amount
        from ({_register(*PO)}) r""",
    "post_movements": _movements("('IN', 'OUT')"),
    "post_adjustments": _movements("('INCREASE', 'DECREASE')"),
    "post_movements_rejects": """
        select update_id as submission_id, concat_ws('; ',
            case when part_num is null then 'missing part' end,
            case when type not in ('IN', 'OUT') then 'unknown type' end) as reasons
        from stock_update_t where part_num is null or type not in ('IN', 'OUT')""",
    "create_indents_heads": f"""with {NEW_INDENTS}
        select indent_id, indent_dt, department, requested_by, 'PENDING' as status,
            true as active from posted""",
    "create_indents_lines": f"""with {NEW_INDENTS}
        select p.indent_id, l.rowid, l.partnum, l.part_desc, {d("l.quantity")},
            l.required_date, true as active
        from form_lines l join posted p on p.submission_id = l.submission_id
        where l.quantity > 0""",
    "create_indents_rejects": f"""with {NEW_INDENTS}
        select indent_id as submission_id, reasons from checked where reasons <> ''""",
    "update_indents_heads": f"""with {EDITED_INDENTS}
        select h.indent_id, case when x.target is null then h.indent_dt
                else cast(h.indent_dt + interval '1' day as date) end as indent_dt,
            case when x.target is null then h.department else 'ADMIN' end as department,
            case when x.target is not null then 'edited' end as remarks, h.status
        from indent_request_head_t h left join done x on x.target = h.indent_id""",
    "update_indents_lines": f"""with {EDITED_INDENTS}
        select t.indent_id, t.rowid, {d("t.quantity")}, t.active and x.target is null as active
        from indent_request_tran_t t left join done x on x.target = t.indent_id and t.company = 1
        union all
        select l.submission_id, l.rowid, {d("l.quantity")}, true
        from form_lines l join done x on x.target = l.submission_id where l.quantity > 0""",
    "update_indents_rejects": f"""with {EDITED_INDENTS}
        select submission_id, reasons from checked where reasons <> ''""",
    "transition_indents": f"""with {DECISIONS},
        taken as (select indent_id, max_by(status, k) as status from facts
            where current_status is not null and status <> 'OPEN' group by 1)
        select h.indent_id, coalesce(t.status, h.status) as status
        from indent_request_head_t h left join taken t on t.indent_id = h.indent_id""",
    "transition_indents_strict": f"""with {DECISIONS},
        taken as (select indent_id, min_by(status, k) as status from facts
            where current_status = 'PENDING' and status <> 'OPEN' group by 1)
        select h.indent_id, coalesce(t.status, h.status) as status
        from indent_request_head_t h left join taken t on t.indent_id = h.indent_id""",
    "transition_indents_rejects": f"""with {DECISIONS}
        select indent_id, status, concat_ws('; ',
            case when current_status is null then 'not found' end,
            case when status = 'OPEN' then 'unknown status' end) as reasons
        from facts where current_status is null or status = 'OPEN'""",
    "upsert_parts": f"""with {PART_FORMS}
        select coalesce(l.code, p.part_num) as part_num,
            case when l.code is null then p.part_desc else l.part_desc end as part_desc,
            case when l.code is null then p.part_category else l.part_category end
                as part_category,
            {d("case when l.code is null then p.pur_price else l.sell_price end", "pur_price")},
            case when l.code is null then p.active
                when p.part_num is null and l.forms = 1 then true else l.active end as active
        from part_t p full outer join latest l on p.part_num = l.code""",
    "upsert_parts_rejects": """
        select part_num as submission_id, concat_ws('; ',
            case when part_num % 40 = 1 then 'missing part_desc' end,
            case when part_num % 41 = 0 then 'unreadable field' end) as reasons
        from part_t where part_num % 40 = 1 or part_num % 41 = 0""",
    "upsert_vendors": """
        select vendor_code, vendor_name, gst,
            case when company = 1 then vendor_code % 3 = 0 else active end as active
        from vendor_t
        union all select vendor_code, vendor_name, gst, true from vendor_t where company = 2""",
    "validate_lines": """
        select * from (select po_no as submission_id, rowid as position, concat_ws('; ',
            case when partnum % 97 = 0 then 'missing part' end,
            case when partnum % 8 = 3 then 'missing quantity' end,
            case when partnum % 8 = 4 or (partnum % 8 <> 3 and quantity * 25000 > 999999)
                then 'quantity out of range' end,
            case when unit_price not between 0.01 and 999999 then 'rate out of range' end,
            case when partnum % 103 > 100 then 'tax out of range' end) as reasons
        from purchase_order_tran_t) r where reasons <> ''""",
    "validate_vendors": """
        select * from (select vendor_code, concat_ws('; ',
            case when vendor_code % 2 <> 0 and not regexp_matches(vendor_name,
                '^[A-Za-z\\s\\-\\.\\(\\)\\/&]+$') then 'bad vendor_name' end,
            case when gst = '27ABC' then 'bad gst' end,
            case when pan = 'ABCD' then 'bad pan' end) as reasons from vendor_t) r
        where reasons <> ''""",
    "validate_adjustments": """
        select * from (select update_id as submission_id, concat_ws('; ',
            case when part_num is null then 'missing part' end,
            case when qty not between 0.01 and 999999 then 'quantity out of range' end,
            case when part_num is null or part_num % 5 > 1 then 'missing reason' end,
            case when part_num % 5 = 1 then 'unknown reason' end) as reasons
        from stock_update_t) r where reasons <> ''""",
    "validate_indents": """
        select indent_id, 'bad requester' as reasons from indent_request_head_t""",
    "validate_indent_heads": """
        select indent_id, 'bad requester' as reasons from indent_request_head_t
        where indent_id % 2 <> 0""",
    "validate_indent_heads_accepted": """
        select indent_id from indent_request_head_t where indent_id % 2 = 0""",
    "validate_documents": f"""with {INVOICE_FORMS}
        select submission_id, concat_ws('; ',
            case when doc_no is null then 'missing number' end,
            case when doc_date is null then 'missing date' end,
            case when submission_id not in (select inv_no from sales_invoice_tran_t
                where partnum % 8 <> 3) then 'no complete line' end) as reasons
        from forms where doc_no is null or doc_date is null or submission_id not in (
            select inv_no from sales_invoice_tran_t where partnum % 8 <> 3)""",
    "validate_receipts": f"""with {PENDING_PER_PART},
        entered as (select t.po_no,
                case when partnum % 8 = 3 or partnum % 1001 = 7 then 0 else quantity end
                    as received, t.partnum
            from purchase_order_tran_t t),
        facts as (select e.po_no, max(e.received) as most,
                bool_or(e.received > case when e.po_no % 7 = 0 then 0
                    else coalesce(p.pending, 0) end) as too_much
            from entered e
            left join pending p on p.po_no = e.po_no and p.partnum = e.partnum
            group by 1),
        judged as (select po_no as submission_id, concat_ws('; ',
                case when most <= 0 then 'nothing received' end,
                case when too_much then 'more than pending' end) as reasons
            from facts)
        select * from judged where reasons <> ''""",
}

# The accepted half of a validation: all forms but the rejected ones.
ACCEPTED = {
    "validate_lines": "select po_no as submission_id, rowid as position from purchase_order_tran_t",
    "validate_vendors": "select vendor_code from vendor_t",
    "validate_adjustments": "select update_id as submission_id from stock_update_t",
    "validate_documents": "select inv_no as submission_id from sales_invoice_head_t",
    "validate_receipts": "select po_no as submission_id from purchase_order_head_t",
}
KEYS = {"validate_lines": "submission_id, position", "validate_vendors": "vendor_code"}
POSTS |= {
    f"{name}_accepted": f"""select * from ({every}) a except
        select {KEYS.get(name, "submission_id")} from (select * from ({POSTS[name]}) r) b"""
    for name, every in ACCEPTED.items()
}

# Entry checks: every form with its reasons, from which the rejected and the accepted ones are told.
ENTRIES = {
    "part": ("submission_id", """
        select part_num as submission_id, concat_ws('; ',
            case when part_num % 50 = 0 then 'missing part_num' end,
            case when part_num % 7 = 0 then 'missing part_desc' end,
            case when part_num % 7 = 1 or part_num % 7 > 2 and not regexp_matches(part_desc,
                '^[A-Za-z\\s\\-\\.\\(\\)\\/]+$') then 'bad part_desc' end,
            case when part_num % 5 = 3 and part_type <> '' then 'unknown part_type' end,
            case when part_num % 4 = 2 then 'unknown costing' end) as reasons
        from part_t"""),
    "customer": ("submission_id", """
        select customer_code as submission_id, concat_ws('; ',
            case when customer_code % 40 = 0 then 'missing customer_code' end,
            case when customer_code % 9 = 8 then 'missing customer_name' end,
            case when customer_code % 3 = 1 then 'bad customer_name' end,
            case when customer_code % 4 = 1 then 'bad gst' end,
            case when customer_code % 5 = 1 then 'bad pan' end) as reasons
        from customer_t"""),
    "movement": ("submission_id", """
        select update_id as submission_id, concat_ws('; ',
            case when part_num is null then 'missing part' end,
            case when update_id % 6 = 0 then 'missing type' end,
            case when update_id % 8 = 3 then 'missing quantity' end,
            case when update_id % 8 < 3 then 'quantity out of range' end) as reasons
        from stock_update_t"""),
    "indent_line": ("submission_id, position", """
        select indent_id as submission_id, rowid as position, concat_ws('; ',
            case when partnum % 10 = 0 then 'missing part' end,
            case when indent_id % 9 = 0 then 'missing quantity' end,
            case when indent_id % 9 = 1 or (indent_id % 9 > 1 and quantity not between 0.01 and 999999)
                then 'quantity out of range' end) as reasons
        from indent_request_tran_t"""),
}
for kind, (keys, judged) in ENTRIES.items():
    POSTS[f"validate_{kind}_entries"] = f"select * from ({judged}) r where reasons <> ''"
    POSTS[f"validate_{kind}_entries_accepted"] = f"select {keys} from ({judged}) r where reasons = ''"
