"""Relations between reports, and results that do not depend on partitioning."""

from compare import SF_DIR, records, rows
from pyspark.sql import functions as F

from tallyhouse.operators import documents, history, parties, receipts, stock
from tallyhouse.sources.star import star_tables


def multiset(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def test_report_for_one_key_is_the_report_filtered(spark):
    D = star_tables(spark, SF_DIR)
    one = D.replace(
        purchase_order_head=D.purchase_order_head.filter("vendor = 3"),
        vendor=D.vendor.filter("vendor_code = 3"),
    )
    for report in (parties.vendor_scorecard, parties.top_parts_by_vendor):
        assert multiset(report(one)) == multiset(report(D).filter("vendor_code = 3"))


def test_last_running_balance_is_the_stock_level(spark):
    D = star_tables(spark, SF_DIR)
    last = stock.stock_running_balance(D).groupBy("part_num").agg(
        F.max_by("running_balance", F.struct("update_date", "update_id")).alias("current_stock")
    )
    assert multiset(last) == multiset(stock.ledger_level(D))


def test_register_totals_add_up(spark):
    D = star_tables(spark, SF_DIR)
    register = documents.po_register(D)
    stats = documents.register_stats(register).first()
    assert stats.total == register.count()
    assert stats.total_value == register.agg(F.sum("total_amount")).first()[0]
    lines = documents.document_totals(D, documents.PURCHASE)
    assert stats.total_value == lines.agg(F.sum("total_amount")).first()[0]


def test_unlimited_history_agrees_with_the_summary(spark):
    D = star_tables(spark, SF_DIR)
    filters = {"party": "1", "date_from": "1996-05-01", "date_to": "1998-05-01"}
    lines = history.purchase_history(D, limit=None, **filters)
    assert records(history.purchase_summary(D, **filters)) == records(
        lines.agg(
            F.count_distinct("po_no"), F.count("*"), F.sum("quantity"), F.sum("amount")
        )
    )


def test_results_do_not_depend_on_the_partition_count(spark):
    D = star_tables(spark, SF_DIR)
    reports = [
        stock.stock_running_balance,
        receipts.po_receipt_status,
        parties.part_recent_purchases,
        documents.po_register,
    ]
    before = [multiset(r(D)) for r in reports]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        after = [multiset(r(star_tables(spark, SF_DIR))) for r in reports]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert before == after
