"""DuckDB text of the inventory tables over the given star schema tables, and a
helper that puts the needed ones in front of a query as CTEs."""

import re

ORD = (
    "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_tax, l_discount,"
    " l_returnflag, l_linestatus, l_shipdate"
)
PONO = "(l_suppkey*1000 + (year(l_shipdate)-1995)*12 + month(l_shipdate))"
QTY = "cast(l_quantity as decimal(18,2))"
PRICE = "cast(l_extendedprice as decimal(18,2))"
AMOUNT = f"cast({QTY}*{PRICE} as decimal(18,2))"

VIEWS = {
    "unit_t": """select c.company, s.u unit_id, c.unit_desc, s.u<>2 active
        from (select distinct p_size%4 u from part) s
        join (values (0,1,'EACH'),(1,1,'BOX'),(1,2,'BOX-2'),(2,1,'KG'),(3,2,'SET'))
            c(u,company,unit_desc) on c.u=s.u""",
    "tax_t": """select c.company, s.t tax_id, c.tax_desc,
        cast(c.pct as decimal(5,2)) tax_percent, s.t<>2 active
        from (select distinct p_size%5 t from part) s
        join (values (0,1,'GST 5',5),(1,1,'GST 12',12),(2,1,'GST 18',18),(3,2,'GST 28',28),
            (4,2,'GST 28',28)) c(t,company,tax_desc,pct) on c.t=s.t""",
    "part_t": """select 1 company, p_partkey part_num, p_name part_desc, p_type part_type,
        case when p_partkey%10=0 then null else p_brand end part_category,
        p_size%4 unit_id,
        case when p_partkey%13=0 then null when p_partkey%17=0 then cast(0 as decimal(18,2))
            else cast(cast(p_retailprice as decimal(18,2))*cast(6+p_partkey%7 as decimal(3,0))
                *cast(0.1 as decimal(2,1)) as decimal(18,2)) end pur_price,
        cast(p_retailprice as decimal(18,2)) sell_price,
        lpad(cast(p_size as varchar),4,'0') hsn_code,
        p_size%5 tax_id,
        case p_size%5 when 0 then cast(5 as decimal(5,2)) when 1 then cast(12 as decimal(5,2))
            when 2 then cast(18 as decimal(5,2)) end tax_percent,
        p_partkey%20<>0 active
        from part""",
    "vendor_t": """select case when s_suppkey%50=49 then 2 else 1 end company, s_suppkey vendor_code, s_name vendor_name,
        cast(null as varchar) city, n_name state,
        case s_suppkey%3 when 0 then '27ABCDE1234F1Z5' when 1 then '27ABC' end gst,
        case s_suppkey%3 when 0 then 'ABCDE1234F' when 1 then 'ABCD' end pan,
        s_suppkey%10<>0 active
        from supplier join nation on s_nationkey=n_nationkey""",
    "customer_t": """select case when c_custkey%100=99 then 2 else 1 end company, c_custkey customer_code, c_name customer_name,
        cast(null as varchar) city, n_name state, c_custkey%25<>0 active
        from customer join nation on c_nationkey=n_nationkey""",
    "purchase_order_tran_t": f"""select 1 company, {PONO} po_no,
        cast(row_number() over (partition by {PONO} order by {ORD}) as integer) rowid, l_partkey partnum,
        {QTY} quantity, {PRICE} unit_price, {AMOUNT} amount, l_returnflag<>'R' active
        from lineitem""",
    "purchase_order_head_t": f"""select 1 company, po po_no, d po_date, v vendor, po%6<>0 active
        from (select {PONO} po, min(cast(date_trunc('month', l_shipdate) as date)) d,
            min(l_suppkey) v from lineitem group by 1) t""",
    "goods_receipt_tran_t": f"""select 1 company, po grn_no, cast(rn as integer) rowid, l_partkey partnum,
        q quantity, up unit_price, cast(q*up as decimal(18,2)) amount, l_returnflag<>'R' active
        from (select {PONO} po, row_number() over (partition by {PONO} order by {ORD}) rn,
            l_partkey, cast({QTY}*cast(case when l_returnflag='A' then 0.5 else 1.0 end
                as decimal(2,1)) as decimal(18,2)) q, {PRICE} up, l_returnflag
            from lineitem where l_linestatus='F') t""",
    "goods_receipt_head_t": """select 1 company, po_no grn_no,
        cast(po_date + interval '14' day as date) grn_dt, po_no, vendor, po_no%9<>0 active
        from purchase_order_head_t where po_no in (select grn_no from goods_receipt_tran_t)""",
    "sales_invoice_head_t": """select 1 company, o_orderkey inv_no,
        cast(o_orderdate as date) inv_dt, o_custkey customer, o_orderstatus<>'F' active
        from orders""",
    "sales_invoice_tran_t": f"""select 1 company, l_orderkey inv_no,
        cast(row_number() over (partition by l_orderkey order by {ORD}) as integer) rowid, l_partkey partnum,
        {QTY} quantity, {PRICE} unit_price, {AMOUNT} amount, l_returnflag<>'R' active
        from lineitem""",
    "stock_update_t": f"""select 1 company,
        l_partkey*4294967296 + row_number() over (partition by l_partkey
            order by l_shipdate, {ORD}) update_id,
        case when l_partkey%97=0 then null else l_partkey end part_num,
        case when l_linestatus='F' and l_returnflag<>'R' then 'IN'
            when l_linestatus='F' then 'INCREASE'
            when l_returnflag='A' then 'DECREASE' else 'OUT' end as "type",
        {QTY} qty, cast(l_shipdate as date) update_date
        from lineitem""",
    "indent_request_head_t": """select 1 company, event_id indent_id, cast(ts as date) indent_dt,
        case event_type when 'view' then 'STORES' when 'click' then 'PRODUCTION'
            when 'signup' then 'HR' when 'error' then 'MAINTENANCE' else 'QUALITY' end department,
        concat('user ', cast(user_id as varchar)) requested_by,
        case event_id%4 when 2 then 'APPROVED' when 3 then 'REJECTED' else 'PENDING' end status,
        event_id%8<>7 active, ts created
        from events""",
    "indent_request_tran_t": """select case when event_id%3=0 then 2 else 1 end company, event_id indent_id, k rowid, cast(user_id as integer) partnum,
        event_type part_desc, cast("value" as decimal(18,2)) quantity,
        case when k=1 then cast(ts as date) end required_date, event_id%5<>0 active
        from events, (values (1),(2)) n(k)
        where k=1 or event_id%2=0""",
}


def with_views(query: str) -> str:
    """``query`` preceded by the CTEs of the views it names, directly or indirectly."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\b\w+_t\b", text):
            if name in VIEWS and name not in needed:
                needed.add(name)
                visit(VIEWS[name])

    visit(query)
    ctes = [f"{name} as ({body})" for name, body in VIEWS.items() if name in needed]
    body = query.strip()
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + body[5:]
    return "with " + ",\n".join(ctes) + "\n" + body
