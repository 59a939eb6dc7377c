"""Behaviour on hand-written rows: NULLs, ties, missing partners, faithful quirks."""

import datetime as dt

import pytest
from compare import records
from pyspark.sql import functions as F

from tallyhouse.functions import predicates as P, values as V
from tallyhouse.operators import (
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
from tallyhouse.operators.documents import PURCHASE

AS_OF = dt.date(2024, 8, 31)

GOLDEN = [
    {"update_id": 1, "part_num": 7, "type": "IN", "qty": 100, "update_date": "2024-01-15"},
    {"update_id": 2, "part_num": 7, "type": "OUT", "qty": 25, "update_date": "2024-01-20"},
    {"update_id": 3, "part_num": 7, "type": "IN", "qty": 50, "update_date": "2024-01-25"},
]


def po(no, date="2024-08-01", vendor=1, active=True, company=1):
    return dict(po_no=no, po_date=date, vendor=vendor, active=active, company=company)


def line(no, row, part=1, qty=1, amount=10, active=True, key="po_no"):
    return {
        key: no, "rowid": row, "partnum": part, "quantity": qty, "unit_price": 10,
        "amount": amount, "active": active,
    }


def test_golden_stock_history(tables):
    D = tables(stock_update=GOLDEN)
    balance = stock.stock_running_balance(D).orderBy("update_id")
    assert records(balance, "running_balance") == [(100.0,), (75.0,), (125.0,)]
    assert records(
        stock.movement_summary(D), "total_in", "total_out", "net_balance", "movements"
    ) == [(150.0, 25.0, 125.0, 3)]


def test_increase_lowers_stock_unless_adjusted(tables):
    rows = [
        {"update_id": 1, "part_num": 1, "type": "IN", "qty": 10},
        {"update_id": 2, "part_num": 1, "type": "INCREASE", "qty": 4},
        {"update_id": 3, "part_num": 1, "type": "DECREASE", "qty": 1},
        {"update_id": 4, "part_num": None, "type": "IN", "qty": 99},
    ]
    D = tables(part=[{"part_num": 1}, {"part_num": 2}], stock_update=rows)
    on_hand = stock.stock_on_hand(D).orderBy("part_num")
    assert records(on_hand, "current_stock", "status") == [(5.0, "low"), (0.0, "out")]
    adjusted = stock.stock_on_hand(D, sign="adjusted").orderBy("part_num")
    assert records(adjusted, "current_stock") == [(13.0,), (0.0,)]


def test_running_balance_state_and_order_by_date_then_id(tables):
    rows = [
        {"update_id": 9, "part_num": 1, "type": "OUT", "qty": 5, "update_date": "2024-01-01"},
        {"update_id": 1, "part_num": 1, "type": "IN", "qty": 5, "update_date": "2024-01-02"},
        {"update_id": 2, "part_num": 1, "type": "IN", "qty": 1, "update_date": "2024-01-02"},
    ]
    balance = stock.stock_running_balance(tables(stock_update=rows))
    assert records(balance.orderBy("update_date", "update_id"), "balance_state") == [
        ("negative",), ("zero",), ("positive",)
    ]


def test_kpi_band_includes_ten_and_filter_does_not(tables):
    moves = [
        {"update_id": n, "part_num": n, "type": "IN", "qty": q}
        for n, q in enumerate([10, 9.5, 0.5, 20], start=1)
    ]
    D = tables(part=[{"part_num": n} for n in range(1, 6)], stock_update=moves)
    assert records(stock.stock_kpis(D)) == [(5, 4, 3, 1)]
    on_hand = stock.stock_on_hand(D)

    def level(name):
        return sorted(r[0] for r in records(P.stock_level_filter(on_hand, name), "part_num"))

    assert level("low") == [2]
    assert level("zero") == [3, 5]
    assert level("available") == [1, 2, 4]


def test_valuation_needs_price_and_stock(tables):
    D = tables(
        part=[
            {"part_num": 1, "pur_price": 2}, {"part_num": 2, "pur_price": None},
            {"part_num": 3, "pur_price": 2}, {"part_num": 4, "pur_price": 0},
        ],
        stock_update=[
            {"update_id": n, "part_num": n, "type": "OUT", "qty": 3} for n in (1, 2, 4)
        ],
    )
    values = dict(records(stock.stock_valuation(D), "part_num", "stock_value"))
    assert values == {1: -6.0, 2: None, 3: None, 4: None}
    assert records(stock.stock_value_total(D)) == [(-6.0,)]


def test_register_keeps_documents_without_lines_or_partner(tables):
    D = tables(
        vendor=[{"vendor_code": 1, "vendor_name": "A"}],
        purchase_order_head=[po(1), po(2, vendor=9), po(3, date=None), po(4, company=2)],
        purchase_order_tran=[line(1, 1), line(1, 2, active=False), line(1, 3, amount=5)],
    )
    got = records(documents.po_register(D), "po_no", "vendor_name", "line_items", "total_amount")
    assert got == [(3, "A", 0, 0.0), (2, None, 0, 0.0), (1, "A", 2, 15.0)]


def test_open_orders_need_an_active_line(tables):
    D = tables(
        purchase_order_head=[po(1), po(2), po(3, active=False)],
        purchase_order_tran=[line(1, 1), line(2, 1, active=False), line(3, 1)],
    )
    got = records(documents.open_pos_for_receipt(D), "po_no", "total_items", "total_amount")
    assert got == [(1, 1, 10.0)]


def test_item_check_counts_inactive_lines(tables):
    D = tables(
        purchase_order_head=[po(1), po(2)], purchase_order_tran=[line(1, 1, active=False)]
    )
    checks = documents.po_item_check(D).orderBy("po_no")
    assert records(checks) == [(1, True, 1), (2, False, 0)]


def test_receipt_summary_counts_lines_unless_distinct(tables):
    D = tables(
        goods_receipt_head=[
            dict(grn_no=1, vendor=1), dict(grn_no=2, vendor=1, active=False),
            dict(grn_no=3, vendor=2),
        ],
        goods_receipt_tran=[
            line(1, 1, key="grn_no"), line(1, 2, key="grn_no", active=False),
            line(2, 1, key="grn_no"),
        ],
    )
    assert records(receipts.grn_summary(D)) == [(4, 3, 20.0, 2)]
    assert records(receipts.grn_summary(D, distinct=True)) == [(3, 2, 20.0, 2)]


def test_received_quantity_over_all_orders_or_per_order(tables):
    D = tables(
        part=[{"part_num": 1}],
        purchase_order_head=[po(1), po(2)],
        purchase_order_tran=[line(1, 1, qty=10), line(2, 1, qty=5)],
        goods_receipt_head=[dict(grn_no=1, po_no=1)],
        goods_receipt_tran=[line(1, 1, qty=8, key="grn_no")],
    )
    all_orders = receipts.po_receipt_status(D).orderBy("po_no")
    assert records(all_orders, "pending_qty") == [(2.0,), (-3.0,)]
    per_order = receipts.po_receipt_status(D, per_po=True).orderBy("po_no")
    assert records(per_order, "pending_qty") == [(2.0,), (5.0,)]


def test_pending_receipts_ignore_receipt_state(tables):
    D = tables(
        purchase_order_head=[po(1), po(2), po(3, active=False)],
        goods_receipt_head=[dict(grn_no=1, po_no=1, active=False)],
    )
    assert records(dashboard.pending_grns(D)) == [(1,)]


def test_window_clamps_to_month_end_and_profit_to_zero(tables):
    D = tables(
        vendor=[{"vendor_code": 1, "vendor_name": "A"}],
        purchase_order_head=[po(1, "2024-02-29"), po(2, "2024-02-28"), po(3, "2024-03-01", 9)],
        purchase_order_tran=[line(1, 1, amount=7), line(2, 1, amount=100), line(3, 1, amount=1)],
    )
    assert records(dashboard.revenue_vs_expense(D, AS_OF)) == [(0.0, 8.0, 0.0, -8.0)]
    assert records(dashboard.top_vendors(D, AS_OF)) == [("A", 7.0)]


def test_dashboard_sections_agree_with_their_parts(tables):
    D = tables(
        vendor=[{"vendor_code": 1, "vendor_name": "A"}],
        purchase_order_head=[po(1), po(2, active=False)],
        purchase_order_tran=[line(1, 1, amount=7)],
    )
    rows = {(s, label): v for s, label, v in records(dashboard.dashboard_stats(D, AS_OF))}
    assert rows[("revenue_expense", "Purchase Costs")] == 7.0
    assert rows[("top_partners", "🏢 A (Vendor)")] == 7.0
    assert rows[("operational_status", "Pending GRNs")] == 1.0
    assert rows[("operational_status", "Completed Operations (30d)")] == 1.0


def test_top_parts_null_value_first_and_unknown_parts_together(tables):
    D = tables(
        part=[{"part_num": 1, "part_desc": "x"}, {"part_num": 2, "part_desc": "y"}],
        vendor=[{"vendor_code": 1}],
        purchase_order_head=[po(1)],
        purchase_order_tran=[
            line(1, 1, part=1, amount=10), line(1, 2, part=2, amount=None),
            line(1, 3, part=8, amount=20), line(1, 4, part=9, amount=30),
        ],
    )
    got = records(parties.top_parts_by_vendor(D, n=2), "part_num", "purchase_count", "total_value")
    assert sorted(got, key=str) == sorted([(2, 1, None), (None, 2, 50.0)], key=str)


def test_scorecard_of_a_vendor_without_orders(tables):
    D = tables(
        vendor=[{"vendor_code": 1}, {"vendor_code": 2}],
        purchase_order_head=[po(1), po(2, active=False)],
        purchase_order_tran=[line(1, 1), line(2, 1), line(1, 2, active=False)],
    )
    got = sorted(records(parties.vendor_scorecard(D)))
    assert got == [(1, 2, 1, 10.0, "2024-08-01"), (2, 0, 0, 0.0, None)]


def test_recent_documents_break_ties_by_number(tables):
    D = tables(purchase_order_head=[po(n) for n in range(1, 13)])
    got = records(parties.recent_pos_by_vendor(D, n=3), "po_no", "line_items", "total_amount")
    assert sorted(got) == [(10, 0, 0.0), (11, 0, 0.0), (12, 0, 0.0)]


def test_history_filters_and_empty_summary(tables):
    D = tables(
        part=[{"part_num": 1, "part_desc": "Steel 50% rod"}, {"part_num": 2, "part_desc": "Nut"}],
        vendor=[{"vendor_code": 1, "vendor_name": "Acme"}],
        purchase_order_head=[po(1, "2024-01-31"), po(2, "2024-02-01"), po(3, None)],
        purchase_order_tran=[
            line(1, 1, part=1), line(2, 1, part=2), line(2, 2, part=7), line(3, 1, part=1),
        ],
    )
    full = history.purchase_history(D)
    assert records(full, "po_no", "part_num") == [(3, 1), (2, 2), (2, None), (1, 1)]
    wild = history.purchase_history(D, part="s%50", party="ACME")
    assert records(wild, "po_no") == [(3,), (1,)]
    dated = history.purchase_history(D, date_from="2024-01-31", date_to="2024-01-31")
    assert records(dated, "po_no") == [(1,)]
    assert records(history.purchase_history(D, limit=1), "po_no") == [(3,)]
    assert records(history.purchase_summary(D)) == [(3, 4, 4.0, 40.0)]
    assert records(history.purchase_summary(D, party="nobody")) == [(0, 0, None, None)]


def test_list_filters(tables):
    D = tables(purchase_order_head=[po(1, "2024-01-01"), po(2, None), po(3, "2024-02-01")])
    rows = D.purchase_order_head

    def numbers(df):
        return sorted(r[0] for r in records(df, "po_no"))

    assert numbers(P.date_filter(rows, "po_date", from_="2024-01-15")) == [3]
    assert numbers(P.date_filter(rows, "po_date", to="2024-01-15")) == [1, 2]
    assert numbers(P.date_filter(rows, "po_date", exact="2024-02-01")) == [3]
    assert numbers(P.search(rows, "%", ["po_no"])) == []
    assert numbers(P.search(rows, "", ["po_no"])) == [1, 2, 3]


def test_history_predicate_is_true_when_blank(tables):
    D = tables(purchase_order_head=[po(1), po(2, None)])
    blank = P.history_predicate("po_date", "remarks", "created_by", party="", date_from="")
    assert D.purchase_order_head.filter(blank).count() == 2
    dated = P.history_predicate("po_date", "remarks", "created_by", date_from="2024-01-01")
    assert D.purchase_order_head.filter(dated).count() == 1


def test_labels_come_from_the_same_company(tables):
    D = tables(
        part=[{"part_num": 1, "unit_id": 1, "pur_price": None}],
        unit=[dict(unit_id=1, unit_desc="BOX", company=2)],
    )
    assert records(catalog.part_catalog(D), "unit_desc") == [(None,)]
    assert records(catalog.part_price_lookup(D), "unit_desc", "pur_price") == [("", 0.0)]
    assert records(catalog.entity_detail(D, "part"), "tax_desc") == [("N/A",)]


def test_lookup_lists_hide_inactive_and_sort_nulls_last(tables):
    D = tables(
        vendor=[
            {"vendor_code": 1, "vendor_name": None}, {"vendor_code": 2, "vendor_name": "B"},
            {"vendor_code": 3, "vendor_name": "A", "active": False},
        ]
    )
    assert records(catalog.active_lookup(D, "vendor")) == [(2, "B"), (1, None)]
    stats = records(catalog.directory_stats(D, "vendor"))
    assert stats == [(3, 2, 1, 0)]


def test_facets_skip_blanks(tables):
    D = tables(vendor=[{"vendor_code": n, "state": s} for n, s in enumerate(
        [" Goa", "Goa", "", "-", None, "Assam"])])
    assert records(catalog.facet_values(D.vendor, "state")) == [("Assam",), ("Goa",)]


def test_parts_summary_and_margin(tables):
    D = tables(
        part=[
            {"part_num": 1, "pur_price": 100, "sell_price": 133, "part_category": "a"},
            {"part_num": 2, "pur_price": 0, "sell_price": 10, "part_category": ""},
            {"part_num": 3, "pur_price": 50, "sell_price": 50, "active": False},
            {"part_num": 4, "pur_price": 3, "sell_price": 2, "part_category": "a"},
        ]
    )
    assert records(parts.parts_report_summary(D)) == [(4, 3, 1, 51.0)]
    margins = {n: (m, c) for n, m, c in records(
        parts.part_margin(D), "part_num", "margin_percent", "margin_class")}
    assert margins[1] == (33.0, "positive")
    assert margins[2] == (None, None)
    assert margins[3] == (0.0, "zero")
    assert margins[4] == (-33.3, "negative")
    assert records(parts.parts_by(D, "part_category")) == [("a", 2)]


def test_empty_tables_give_zero_rows_or_zeros(tables):
    D = tables()
    assert records(dashboard.revenue_vs_expense(D, AS_OF)) == [(0.0, 0.0, 0.0, 0.0)]
    assert records(parts.parts_report_summary(D)) == [(0, 0, 0, 0.0)]
    assert records(documents.register_stats(documents.po_register(D))) == [(0, 0, 0, 0.0)]
    assert records(stock.stock_value_total(D)) == [(0.0,)]
    assert records(indents.indent_status_counts(D)) == [(0, 0, 0, 0)]


def test_tax_inclusive_amount_and_default_rate(tables):
    D = tables(part=[
        {"part_num": 1, "pur_price": 10, "sell_price": 20, "tax_percent": 18},
        {"part_num": 2, "pur_price": 10, "active": False, "tax_percent": 18},
    ], purchase_order_tran=[
        {**line(1, 1, part=1, qty=2), "unit_price": None},
        {**line(1, 2, part=1, qty=3), "unit_price": 1.99},
        {**line(1, 3, part=2, qty=3), "unit_price": 2},
    ])
    lines = D.purchase_order_tran
    got = documents.line_amount_with_tax(lines, D, PURCHASE).orderBy("rowid")
    assert records(got, "amount_incl_tax") == [(23.6,), (7.04,), (6.0,)]
    total = documents.document_total_with_tax(lines, D, PURCHASE)
    assert records(total) == [(1, 36.64)]


@pytest.mark.parametrize(
    ("kind", "number", "dashed", "code"),
    [("part", 7, False, "P007"), ("sales_invoice", 1234, False, "SI1234"),
     ("purchase_order", 7, True, "PO-7"), ("indent", 12, False, "IN012")],
)
def test_display_codes(spark, kind, number, dashed, code):
    got = spark.range(1).select(V.display_code(kind, F.lit(number), dashed)).first()[0]
    assert got == code


def test_form_cleaning(spark):
    row = spark.createDataFrame(
        [(" ", "27abcde1234f1z5", "on", " x ")], "city string, gst string, active string, pan string"
    )
    assert records(V.normalise(row, "vendor")) == [(None, "27ABCDE1234F1Z5", True, "X")]


def test_project_stock_counts_increase_as_plus(spark, tables):
    D = tables(part=[{"part_num": 1}], stock_update=[
        {"update_id": 1, "part_num": 1, "type": "IN", "qty": 5}])
    moves = spark.sql(
        "select * from values (1L, 'INCREASE', 5.00BD), (1L, 'OUT', 6.00BD), (2L, 'IN', 50.00BD)"
        " as t(part_num, type, quantity)"
    )
    got = sorted(records(stock.project_stock(moves, D), "new_stock", "status", "is_negative"))
    assert got == [(-1.0, "out", True), (10.0, "in", False), (50.0, "in", False)]
