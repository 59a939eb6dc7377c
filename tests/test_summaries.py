"""Summaries from monthly sums equal the line scan for any range and filter."""

import datetime as dt
import itertools

import pytest
from compare import SF_DIR, records
from pyspark.sql import functions as F

from tallyhouse.operators.documents import PURCHASE, SALES
from tallyhouse.operators.history import history_summary
from tallyhouse.plans.documents import soft_delete
from tallyhouse.sources.star import star_tables
from tallyhouse.sources.store import Store
from tallyhouse.sources.summaries import keep_sums, stored_summary

TODAY = dt.date(2024, 5, 1)
RANGES = [(None, None), ("1996-01-01", "1997-12-31"), ("1996-01-02", None), (None, "1998-03-30"),
          ("1997-05-05", "1997-05-20"), ("2030-01-01", None)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    D = star_tables(spark, SF_DIR)
    store = Store(spark, str(tmp_path_factory.mktemp("sums")))
    store.create(D, ["part", "unit", "vendor", "customer", PURCHASE.head, PURCHASE.tran, SALES.head, SALES.tran])
    for kind in (PURCHASE, SALES):
        keep_sums(store, kind)
    return store, D


def read(df):
    """Months of line files that a plan reads."""
    return {f.split("month=")[1][:7] for f in df.inputFiles() if "_tran/" in f}


@pytest.mark.parametrize("kind", [PURCHASE, SALES], ids=["purchase", "sales"])
def test_any_range_and_filter(stored, kind):
    store, D = stored
    for (date_from, date_to), party, part in itertools.product(RANGES, [None, "00"], [None, "bolt"]):
        filters = {"party": party, "part": part, "date_from": date_from, "date_to": date_to}
        got = stored_summary(store, store.manifest(), kind, **filters)
        assert records(got) == records(history_summary(D, kind, **filters)), filters


def test_only_edge_months_are_scanned(stored):
    store, _ = stored
    current = store.manifest()
    whole = stored_summary(store, current, SALES, part="bolt", date_from="1996-01-01", date_to="1997-12-31")
    assert read(whole) == set()
    edges = stored_summary(store, current, SALES, date_from="1996-01-15", date_to="1997-12-30")
    assert read(edges) == {"1996-01", "1997-12"}


def test_documents_under_a_part_filter_are_counted_by_hash_aggregates(stored):
    store, _ = stored
    plan = stored_summary(store, store.manifest(), SALES, part="bolt")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_changed_months_are_scanned_until_they_are_summed(spark, tables, tmp_path):
    D = tables(
        part=[{"part_num": 1, "part_desc": "bolt"}, {"part_num": 2, "part_desc": "nut"}],
        vendor=[{"vendor_code": 1, "vendor_name": "Acme"}],
        purchase_order_head=[
            {"po_no": no, "po_date": f"2024-0{m}-05", "vendor": 1} for m, no in [(1, 1), (1, -1), (1, 32769), (2, 4), (3, 5)]
        ] + [{"po_no": 6, "vendor": 1}, {"po_no": 1, "po_date": "2024-01-09", "vendor": 1, "company": 2}],
        purchase_order_tran=[
            {"po_no": no, "rowid": r, "partnum": p, "quantity": 2, "unit_price": 3, "amount": 6}
            for no in (1, -1, 32769, 4, 5, 6) for r, p in enumerate([1, 1, 2, None], 1)
        ],
    )
    store = Store(spark, str(tmp_path / "s"))
    store.create(D, ["part", "unit", "vendor", PURCHASE.head, PURCHASE.tran])
    keep_sums(store, PURCHASE)
    for part, n in [(None, 6), ("bolt", 6), ("o", 6), ("none", 0)]:
        got = stored_summary(store, store.manifest(), PURCHASE, part=part)
        assert records(got) == records(history_summary(D, PURCHASE, part=part))
        assert got.first().total_documents == n
    keys = spark.createDataFrame([(4,)], "po_no long")
    current = store.post(
        lambda base: soft_delete(store.around(base, PURCHASE.head, keys), "purchase", keys, TODAY), "delete"
    )
    changed = stored_summary(store, current, PURCHASE)
    assert read(changed) == {"2024-02", "__HIVE_"} and changed.first().total_documents == 5
    current = keep_sums(store, PURCHASE)
    again = stored_summary(store, current, PURCHASE, date_from="2024-01-01", date_to="2024-12-31")
    assert read(again) == set() and records(again, "total_documents", "total_line_items") == [(4, 16)]
    assert keep_sums(store, PURCHASE) == current
    assert store.tables(current).purchase_order_head.filter(F.col("po_no") == 4).first().active is False
