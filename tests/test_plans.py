"""Physical plans: what is pushed down, what is not shuffled, what never appears."""

import datetime as dt

import pytest
from compare import SF_DIR

import __spark_entry__ as entry
from tallyhouse.operators import dashboard, documents, history, parties, stock
from tallyhouse.schemas import DDL
from tallyhouse.sources.readers import load_tables
from tallyhouse.sources.star import star_tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(entry.REPORTS))
def test_no_cross_join_and_no_window_in_one_task(spark, no_broadcast, name):
    lines = plan(entry.queries()[name](spark, SF_DIR)).splitlines()
    text = "\n".join(lines)
    assert "Cartesian" not in text and "NestedLoop" not in text
    assert "PythonUDF" not in text and "Python" not in text
    for i, line in enumerate(lines):
        if "Window [" in line or "WindowGroupLimit" in line:
            assert "SinglePartition" not in "".join(lines[i + 1 : i + 4])


def test_row_positions_are_not_computed_when_unused(spark):
    text = plan(documents.po_register(star_tables(spark, SF_DIR)))
    assert "Window" not in text


def test_the_month_of_an_order_is_taken_once_an_order(spark):
    assert "partial_min(l_shipdate" in plan(star_tables(spark, SF_DIR).purchase_order_head)


def test_pending_receipts_use_an_anti_join(spark):
    assert "LeftAnti" in plan(dashboard.pending_grns(star_tables(spark, SF_DIR)))


def test_history_page_is_a_top_n(spark):
    assert "TakeOrderedAndProject(limit=100" in plan(
        history.purchase_history(star_tables(spark, SF_DIR))
    )


def test_ranked_reports_cut_groups_early(spark):
    D = star_tables(spark, SF_DIR)
    for report in (parties.recent_pos_by_vendor, parties.part_recent_purchases):
        assert "WindowGroupLimit" in plan(report(D))


def test_filters_and_columns_reach_the_scan(spark, tmp_path, frame):
    rows = frame("sales_invoice_head", {"inv_no": 1}, {"inv_no": 2, "company": 2})
    rows.write.parquet(str(tmp_path / "sales_invoice_head"))
    D = load_tables(spark, str(tmp_path))
    counted = D.sales_invoice_head.filter("active and company = 1").groupBy("customer").count()
    text = plan(counted)
    assert "EqualTo(company,1)" in text and "EqualTo(active,true)" in text
    schema = text[text.index("ReadSchema:") :]
    assert "customer" in schema and "remarks" not in schema


def test_stock_levels_aggregate_before_the_join(spark, no_broadcast):
    text = plan(stock.stock_on_hand(star_tables(spark, SF_DIR)))
    assert text.index("Join") < text.index("partial_sum")


def test_dashboards_read_each_table_once(spark, tmp_path, tables):
    empty = tables()
    for name in DDL:
        getattr(empty, name).write.parquet(f"{tmp_path}/{name}")
    D = load_tables(spark, str(tmp_path))
    for report, n_tables in [(dashboard.dashboard_stats, 7), (dashboard.operational_status, 3)]:
        assert plan(report(D, dt.date(2024, 1, 1))).count("FileScan parquet") == n_tables
