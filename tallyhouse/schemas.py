"""Explicit schemas of the fourteen inventory tables.

Money and quantities are ``decimal(18,2)``; the natural key of every table
starts with ``company``.  Documents are a head table and a line ("tran") table.
"""

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

MONEY = "decimal(18,2)"
PERCENT = "decimal(5,2)"

_PARTY = """
    address1 string, address2 string, location string, city string, state string,
    pin string, std_code string, phone string, mobile string, email string,
    website string, gst string, pan string,
    active boolean, created_by string, updated date"""

_LINE = f"""
    rowid int, partnum bigint, quantity {MONEY}, unit_price {MONEY}, amount {MONEY},
    active boolean, createdby string, updated date"""

DDL = {
    "part": f"""
        company int, part_num bigint, part_desc string, part_type string,
        part_category string, unit_id int, pur_price {MONEY}, sell_price {MONEY},
        hsn_code string, tax_id int, tax_percent {PERCENT}, lot boolean,
        batch boolean, warranty boolean, costing string, active boolean,
        created_by string, updated date""",
    "unit": "company int, unit_id int, unit_desc string, active boolean",
    "tax": f"company int, tax_id int, tax_desc string, tax_percent {PERCENT}, active boolean",
    "vendor": f"company int, vendor_code bigint, vendor_name string, {_PARTY}",
    "customer": f"company int, customer_code bigint, customer_name string, {_PARTY}",
    "purchase_order_head": """
        company int, po_no bigint, po_date date, vendor bigint, remarks string,
        active boolean, created_by string, updated date""",
    "purchase_order_tran": f"company int, po_no bigint, {_LINE}",
    "sales_invoice_head": """
        company int, inv_no bigint, inv_dt date, customer bigint, remarks string,
        active boolean, created_by string, updated date""",
    "sales_invoice_tran": f"company int, inv_no bigint, {_LINE}",
    "goods_receipt_head": """
        company int, grn_no bigint, grn_dt date, po_no bigint, vendor bigint,
        active boolean, created_by string, updated date""",
    "goods_receipt_tran": f"company int, grn_no bigint, {_LINE}",
    "stock_update": f"""
        company int, update_id bigint, part_num bigint, type string, qty {MONEY},
        update_date date, created_by string, updated date""",
    "indent_request_head": """
        company int, indent_id bigint, indent_dt date, department string,
        requested_by string, status string, remarks string, active boolean,
        created timestamp, updated timestamp""",
    "indent_request_tran": f"""
        company int, indent_id bigint, rowid int, partnum int, part_desc string,
        quantity {MONEY}, required_date date, remarks string, active boolean""",
}


@cache
def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


def columns(table: str) -> list[str]:
    return schema(table).names


def conform(df: DataFrame, table: str, *others: str) -> DataFrame:
    """Select the columns of ``table`` in order, typed; absent ones become NULL. ``others`` follow as they are."""
    have = set(df.columns)
    return df.selectExpr(
        *[
            f"cast({f'`{f.name}`' if f.name in have else 'null'} as {f.dataType.simpleString()})"
            f" as `{f.name}`"
            for f in schema(table)
        ],
        *others,
    )
