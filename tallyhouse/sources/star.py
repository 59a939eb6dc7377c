"""The inventory tables derived from a sales star schema (orders, lineitem, ...).

Purchase orders are one supplier's lines of one ship month, invoices are orders,
the stock ledger is the line table ordered by ship date per part, and indents are
events. Positions inside a document come from segmented running counts, so one huge
order, supplier or part does not land in one task.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyhouse.functions.ordering import running_totals
from tallyhouse.schemas import schema
from tallyhouse.tables import Tables

STAR_DDL = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": """c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,
        c_mktsegment string""",
    "part": """p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,
        p_retailprice double""",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string,
        o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
        value double, props string""",
}

# Order of the lines inside one document.
LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
    "l_tax", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate",
]

QUANTITY = "cast(l_quantity as decimal(18,2))"
PRICE = "cast(l_extendedprice as decimal(18,2))"

# Coarse steps of the line order, so that one huge document or part is many segments
# and the segments stay few.
ORDER_BLOCK = "l_orderkey div 1000000"
PART_BLOCK = "l_partkey div 1000"
DAY_ORDER_BLOCK = "l_orderkey div 1000000"


def read_star(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_DDL[name]).parquet(f"{path}/{name}.parquet")


@cache
def star_tables(spark: SparkSession, path: str) -> Tables:
    """Tables over the star schema files in ``path``. A session defines them once, like
    views; they hold plans, not data."""
    return Tables(_Star(spark, path).table)


def _po_number() -> Column:
    return F.expr("l_suppkey * 1000 + (year(l_shipdate) - 1995) * 12 + month(l_shipdate)")


def _rows(df: DataFrame, table: str, **expressions: str) -> DataFrame:
    """The columns of ``table`` from SQL expressions, typed; absent ones are NULL."""
    return df.selectExpr(
        *[
            f"cast({expressions.get(f.name, 'null')} as {f.dataType.simpleString()}) as `{f.name}`"
            for f in schema(table)
        ]
    )


def _positions(lines: DataFrame, document: str) -> DataFrame:
    blocks = lines.withColumn("block", F.expr(ORDER_BLOCK))
    return running_totals(blocks, [document], ["block"], LINE_ORDER, rowid=F.lit(1))


class _Star:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)()

    def read(self, name: str) -> DataFrame:
        return read_star(self.spark, self.path, name)

    def purchase_lines(self) -> DataFrame:
        return self.read("lineitem").withColumn("po", _po_number())

    def unit(self) -> DataFrame:
        sizes = self.read("part").selectExpr("p_size % 4 as unit").where("unit is not null").distinct()
        companies = "case unit when 1 then array(1, 2) when 3 then array(2) else array(1) end"
        return _rows(
            sizes.withColumn("company", F.explode(F.expr(companies))),
            "unit",
            company="company",
            unit_id="unit",
            unit_desc="""case when unit = 0 then 'EACH' when unit = 2 then 'KG'
                when unit = 3 then 'SET' when company = 1 then 'BOX' else 'BOX-2' end""",
            active="unit <> 2",
        )

    def tax(self) -> DataFrame:
        sizes = self.read("part").selectExpr("p_size % 5 as tax").where("tax is not null").distinct()
        percent = "case tax when 0 then 5 when 1 then 12 when 2 then 18 else 28 end"
        return _rows(
            sizes,
            "tax",
            company="case when tax < 3 then 1 else 2 end",
            tax_id="tax",
            tax_desc=f"concat('GST ', {percent})",
            tax_percent=percent,
            active="tax <> 2",
        )

    def part(self) -> DataFrame:
        return _rows(
            self.read("part"),
            "part",
            company="1",
            part_num="p_partkey",
            part_desc="p_name",
            part_type="p_type",
            part_category="case when p_partkey % 10 = 0 then null else p_brand end",
            unit_id="p_size % 4",
            pur_price="""case when p_partkey % 13 = 0 then null
                when p_partkey % 17 = 0 then cast(0 as decimal(18,2))
                else cast(cast(p_retailprice as decimal(18,2))
                    * cast(6 + p_partkey % 7 as decimal(3,0))
                    * cast(0.1 as decimal(2,1)) as decimal(18,2)) end""",
            sell_price="cast(p_retailprice as decimal(18,2))",
            hsn_code="lpad(cast(p_size as string), 4, '0')",
            tax_id="p_size % 5",
            tax_percent="""case p_size % 5 when 0 then cast(5 as decimal(5,2))
                when 1 then cast(12 as decimal(5,2)) when 2 then cast(18 as decimal(5,2)) end""",
            active="p_partkey % 20 <> 0",
        )

    def vendor(self) -> DataFrame:
        rows = self.read("supplier").join(
            self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")
        )
        return _rows(
            rows,
            "vendor",
            company="case when s_suppkey % 50 = 49 then 2 else 1 end",
            vendor_code="s_suppkey",
            vendor_name="s_name",
            state="n_name",
            gst="case s_suppkey % 3 when 0 then '27ABCDE1234F1Z5' when 1 then '27ABC' end",
            pan="case s_suppkey % 3 when 0 then 'ABCDE1234F' when 1 then 'ABCD' end",
            active="s_suppkey % 10 <> 0",
        )

    def customer(self) -> DataFrame:
        rows = self.read("customer").join(
            self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        return _rows(
            rows,
            "customer",
            company="case when c_custkey % 100 = 99 then 2 else 1 end",
            customer_code="c_custkey",
            customer_name="c_name",
            state="n_name",
            active="c_custkey % 25 <> 0",
        )

    def purchase_order_tran(self) -> DataFrame:
        lines = _positions(self.purchase_lines(), "po")
        return _rows(
            lines,
            "purchase_order_tran",
            company="1",
            po_no="po",
            rowid="rowid",
            partnum="l_partkey",
            quantity=QUANTITY,
            unit_price=PRICE,
            amount=f"{QUANTITY} * {PRICE}",
            active="l_returnflag <> 'R'",
        )

    def purchase_order_head(self) -> DataFrame:
        # The month of the first day is the first of the months: it is taken once an order, not once a line.
        heads = self.purchase_lines().groupBy("po").agg(
            F.trunc(F.min("l_shipdate").cast("date"), "month").alias("opened"),
            F.min("l_suppkey").alias("supplier"),
        )
        return _rows(
            heads,
            "purchase_order_head",
            company="1",
            po_no="po",
            po_date="opened",
            vendor="supplier",
            active="po % 6 <> 0",
        )

    def received_lines(self) -> DataFrame:
        return self.purchase_lines().filter("l_linestatus = 'F'")

    def goods_receipt_tran(self) -> DataFrame:
        lines = _positions(self.received_lines(), "po")
        received = lines.withColumn(
            "received",
            F.expr(
                f"""cast({QUANTITY} * cast(case when l_returnflag = 'A' then 0.5 else 1.0 end
                as decimal(2,1)) as decimal(18,2))"""
            ),
        )
        return _rows(
            received,
            "goods_receipt_tran",
            company="1",
            grn_no="po",
            rowid="rowid",
            partnum="l_partkey",
            quantity="received",
            unit_price=PRICE,
            amount=f"received * {PRICE}",
            active="l_returnflag <> 'R'",
        )

    def goods_receipt_head(self) -> DataFrame:
        received = self.received_lines().select(F.col("po").alias("po_no")).distinct()
        return _rows(
            self.purchase_order_head().join(received, "po_no", "left_semi"),
            "goods_receipt_head",
            company="1",
            grn_no="po_no",
            grn_dt="date_add(po_date, 14)",
            po_no="po_no",
            vendor="vendor",
            active="po_no % 9 <> 0",
        )

    def sales_invoice_head(self) -> DataFrame:
        return _rows(
            self.read("orders"),
            "sales_invoice_head",
            company="1",
            inv_no="o_orderkey",
            inv_dt="cast(o_orderdate as date)",
            customer="o_custkey",
            active="o_orderstatus <> 'F'",
        )

    def sales_invoice_tran(self) -> DataFrame:
        lines = running_totals(
            self.read("lineitem").withColumn("block", F.expr(PART_BLOCK)),
            ["l_orderkey"],
            ["l_linenumber", "block"],
            LINE_ORDER,
            rowid=F.lit(1),
        )
        return _rows(
            lines,
            "sales_invoice_tran",
            company="1",
            inv_no="l_orderkey",
            rowid="rowid",
            partnum="l_partkey",
            quantity=QUANTITY,
            unit_price=PRICE,
            amount=f"{QUANTITY} * {PRICE}",
            active="l_returnflag <> 'R'",
        )

    def stock_update(self) -> DataFrame:
        ledger = running_totals(
            self.read("lineitem").withColumn("block", F.expr(DAY_ORDER_BLOCK)),
            ["l_partkey"],
            ["l_shipdate", "block"],
            ["l_shipdate", *LINE_ORDER],
            position=F.lit(1),
        )
        return _rows(
            ledger,
            "stock_update",
            company="1",
            update_id="l_partkey * 4294967296 + position",
            part_num="case when l_partkey % 97 = 0 then null else l_partkey end",
            type="""case when l_linestatus = 'F' and l_returnflag <> 'R' then 'IN'
                when l_linestatus = 'F' then 'INCREASE'
                when l_returnflag = 'A' then 'DECREASE' else 'OUT' end""",
            qty=QUANTITY,
            update_date="cast(l_shipdate as date)",
        )

    def indent_request_head(self) -> DataFrame:
        return _rows(
            self.read("events"),
            "indent_request_head",
            company="1",
            indent_id="event_id",
            indent_dt="cast(ts as date)",
            department="""case event_type when 'view' then 'STORES' when 'click' then 'PRODUCTION'
                when 'signup' then 'HR' when 'error' then 'MAINTENANCE' else 'QUALITY' end""",
            requested_by="concat('user ', cast(user_id as string))",
            status="""case event_id % 4 when 2 then 'APPROVED' when 3 then 'REJECTED'
                else 'PENDING' end""",
            active="event_id % 8 <> 7",
            created="ts",
        )

    def indent_request_tran(self) -> DataFrame:
        slots = F.when(F.col("event_id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(
            F.array(F.lit(1))
        )
        rows = self.read("events").withColumn("k", F.explode(slots))
        return _rows(
            rows,
            "indent_request_tran",
            company="case when event_id % 3 = 0 then 2 else 1 end",
            indent_id="event_id",
            rowid="k",
            partnum="user_id",
            part_desc="event_type",
            quantity="value",
            required_date="case when k = 1 then cast(ts as date) end",
            active="event_id % 5 <> 0",
        )
