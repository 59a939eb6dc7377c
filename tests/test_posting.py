"""Posting jobs on small batches: new rows, changed rows, rejects, invariants."""

import datetime as dt

import pytest
from compare import SF_DIR, records
from pyspark.sql import functions as F

from tallyhouse.operators import stock
from tallyhouse.operators.documents import PURCHASE, SALES
from tallyhouse.plans import validation
from tallyhouse.plans.batches import Batch, explode_batch
from tallyhouse.plans.documents import post_documents, replace_documents, soft_delete
from tallyhouse.plans.indents import create_indents, transition_indents, update_indents
from tallyhouse.plans.masters import upsert_master
from tallyhouse.plans import numbering
from tallyhouse.plans.numbering import assign_line_numbers, assign_numbers, numbers_of
from tallyhouse.plans.stock import post_adjustments, post_movements, post_receipts
from tallyhouse.schemas import schema
from tallyhouse.sources import star_batches as forms
from tallyhouse.sources.star import star_tables
from tallyhouse.tables import Tables

TODAY = dt.date(2024, 5, 1)
NOW = dt.datetime(2024, 5, 1, 9, 30)
HEAD = "submission_id long, doc_no long, doc_date date, party long, remarks string"
LINE = "submission_id long, position int, part_num string, quantity string, rate string"
DAY = dt.date(2024, 4, 30)


@pytest.fixture
def batch(spark):
    def build(heads, lines, head=HEAD, line=LINE):
        return Batch(spark.createDataFrame(heads, head), spark.createDataFrame(lines, line))

    return build


def reasons(posting):
    return {r[0]: r[1] for r in records(posting.rejects)}


@pytest.mark.parametrize("span", [7, 1_000_000])
def test_numbers_are_dense_ordered_and_follow_the_highest(spark, monkeypatch, span):
    monkeypatch.setattr(numbering, "SPAN", span)
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000 - 300).alias("k"))
    numbered = assign_numbers(rows.filter("k % 3 = 0"), "k", "n", spark.range(5), spark.range(10))
    want = [(k, 10 + i) for i, k in enumerate(range(-300, 700, 3))]
    assert sorted(records(numbered, "k", "n")) == want


def test_sparse_numbers_of_submissions(spark):
    keys = sorted({(i * 0x9E3779B97F4A7C15) % (1 << 63) for i in range(300)} | {0, 1, 10**12, (1 << 63) - 1})
    rows = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    numbered = assign_numbers(rows, "k", "n", spark.range(0))
    assert sorted(records(numbered, "k", "n")) == [(k, i) for i, k in enumerate(keys, 1)]


@pytest.mark.parametrize("span", [3, 1_000_000])
def test_lines_are_numbered_by_form_and_position(spark, monkeypatch, span):
    monkeypatch.setattr(numbering, "SPAN", span)
    lines = [(s, p) for s in (1, 5, 6, 90) for p in range(1, 30, 2) if s == 5 or p < 5 * s]
    rows = spark.createDataFrame(lines, "s long, p int").repartition(4)
    numbered = assign_line_numbers(rows, "s", "p", "n", spark.range(100))
    assert sorted(records(numbered, "s", "p", "n")) == [(*x, 99 + i) for i, x in enumerate(lines, 1)]


@pytest.mark.parametrize("span", [3, 1_000_000])
def test_only_lines_of_the_given_forms_are_numbered(spark, monkeypatch, span):
    monkeypatch.setattr(numbering, "SPAN", span)
    lines = [(s, p) for s in (1, 5, 6, 90, None) for p in range(1, 9)]
    forms = spark.createDataFrame([(90, "c"), (1, "a"), (6, "b"), (7, "no line"), (None, "no key")], "s long, of string")
    rows = spark.createDataFrame(lines, "s long, p int").repartition(4)
    numbered = assign_line_numbers(rows, "s", "p", "n", spark.range(100), forms=forms)
    want = [(s, p, of, 100 + 8 * i + k) for i, (s, of) in enumerate([(1, "a"), (6, "b"), (90, "c")]) for k, p in enumerate(range(1, 9))]
    assert sorted(records(numbered, "s", "p", "of", "n")) == want


def test_numbering_derives_its_rows_once(spark):
    rows = spark.range(0, 900, 1, 4).selectExpr("id % 300 as k").distinct()
    numbered = numbering.running(rows, "k", "n", F.lit(1))
    assert "isnotnull((k" not in numbered._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(records(numbered, "k", "n")) == [(k, k + 1) for k in range(300)]


def test_numbers_of_an_empty_batch(spark):
    assert assign_numbers(spark.range(0), "id", "n", spark.range(0)).count() == 0


def test_first_number_is_one(spark):
    numbered = assign_numbers(spark.range(2), "id", "n", spark.range(0))
    assert sorted(records(numbered, "n")) == [(1,), (2,)]


def test_known_highest_numbers_save_the_scan(spark, tables, tmp_path):
    D = tables(stock_update=[{"update_id": 7}])
    assert records(numbers_of(D, "stock_update", "update_id")) == [(7,)]
    D.stock_update.write.parquet(f"{tmp_path}/ledger")
    stored = Tables(lambda name: spark.read.schema(schema(name)).parquet(f"{tmp_path}/ledger"), {"stock_update": 40})
    batch = spark.createDataFrame([(1, 1, "IN", 2)], "submission_id long, part_num long, type string, quantity int")
    jobs = spark.sparkContext.statusTracker()
    before = jobs.getJobIdsForGroup()
    added = post_movements(stored, batch, TODAY).added["stock_update"]
    assert jobs.getJobIdsForGroup() == before
    assert "parquet" not in added._jdf.queryExecution().executedPlan().toString()
    assert records(added, "update_id") == [(41,)]


def test_post_orders(tables, batch):
    D = tables(purchase_order_head=[{"po_no": 40}])
    posting = post_documents(
        D,
        PURCHASE,
        batch(
            [(1, None, DAY, 5, "a"), (2, 40, DAY, 5, None), (3, 50, DAY, 5, None),
             (4, 50, DAY, 5, None), (5, None, None, 5, None), (6, None, DAY, 5, None),
             (7, None, DAY, None, None), (8, None, DAY, 5, None), (9, 60, None, 5, None),
             (10, 60, DAY, 6, None)],
            [(1, 1, "7", "2", "1.25"), (1, 2, "", "1", "1"), (1, 3, "8", "0", "3"),
             (1, 4, "8", None, "3"), (3, 1, "9", "1", "1"), (6, 1, "7", "x", "1"),
             (10, 1, "1", "3", "0.35")],
        ),
        TODAY,
    )
    heads = records(posting.added[PURCHASE.head], "po_no", "vendor", "active", "updated")
    assert sorted(heads) == [
        (50, 5, True, "2024-05-01"), (60, 6, True, "2024-05-01"),
        (61, 5, True, "2024-05-01"), (62, 5, True, "2024-05-01"),
    ]
    lines = records(posting.added[PURCHASE.tran], "po_no", "rowid", "partnum", "amount")
    assert sorted(lines) == [(50, 1, 9, 1.0), (60, 1, 1, 1.05), (61, 1, 7, 2.5), (61, 3, 8, 0.0)]
    assert reasons(posting) == {
        2: ["number exists"], 4: ["number repeated in batch"], 5: ["missing date"],
        6: ["unreadable line"], 7: ["missing party"], 9: ["missing date"],
    }
    after = posting.apply(D)
    assert after.purchase_order_head.count() == 5


def test_nested_forms_keep_line_positions(spark):
    forms = spark.createDataFrame(
        [(1, [("7", "2", "3"), ("", "1", "1"), ("9", "1", "1")]), (2, [])],
        "submission_id long, lines array<struct<part_num string, quantity string, rate string>>",
    )
    flat = explode_batch(forms)
    assert flat.heads.count() == 2
    assert sorted(records(flat.lines, "submission_id", "position", "part_num")) == [
        (1, 1, "7"), (1, 2, ""), (1, 3, "9")
    ]


def test_replacing_leaves_one_active_line_set(tables, batch):
    old = [
        {"inv_no": 1, "rowid": 1, "partnum": 5, "amount": 1},
        {"inv_no": 2, "rowid": 1, "partnum": 5, "amount": 1},
    ]
    D = tables(
        sales_invoice_head=[{"inv_no": 1, "customer": 3, "created_by": "x"}, {"inv_no": 2}],
        sales_invoice_tran=old,
    )
    head = HEAD + ", active boolean"
    edits = batch(
        [(1, 1, DAY, 8, "first", True), (2, 1, DAY, 9, "second", False), (3, 99, DAY, 9, "", True)],
        [(1, 1, "5", "1", "1"), (2, 1, "6", "2", "2"), (2, 2, "7", "1", "2"), (3, 1, "1", "1", "1")],
        head,
    )
    posting = replace_documents(D, SALES, edits, TODAY)
    heads = records(
        posting.state[SALES.head], "inv_no", "customer", "remarks", "active", "created_by"
    )
    assert sorted(heads) == [(1, 9, "second", False, "x"), (2, None, None, True, None)]
    lines = posting.state[SALES.tran]
    active = sorted(records(lines.filter("active"), "inv_no", "rowid", "partnum"))
    assert active == [(1, 1, 6), (1, 2, 7), (2, 1, 5)]
    assert lines.count() == 5
    assert reasons(posting) == {3: ["unknown document"]}
    again = replace_documents(posting.apply(D), SALES, edits, TODAY).state[SALES.tran]
    assert sorted(records(again.filter("active"), "inv_no", "rowid", "partnum")) == active


def test_soft_delete_cascades_to_lines(spark, tables):
    D = tables(
        purchase_order_head=[{"po_no": 1}, {"po_no": 2}, {"po_no": 1, "company": 2}],
        purchase_order_tran=[{"po_no": 1, "rowid": 1}, {"po_no": 2, "rowid": 1}],
    )
    keys = spark.createDataFrame([(1,), (1,), (7,)], "po_no long")
    posting = soft_delete(D, "purchase", keys, TODAY)
    heads = records(posting.state[PURCHASE.head], "company", "po_no", "active")
    assert sorted(heads) == [(1, 1, False), (1, 2, True), (2, 1, True)]
    lines = records(posting.state[PURCHASE.tran], "po_no", "active", "updated")
    assert sorted(lines) == [(1, False, "2024-05-01"), (2, True, None)]
    assert reasons(posting) == {7: ["not found"]}


def test_receipts_feed_the_ledger(tables, batch):
    D = tables(
        part=[{"part_num": 7}],
        purchase_order_head=[{"po_no": 1, "vendor": 3}, {"po_no": 2, "vendor": 4}],
        goods_receipt_head=[{"grn_no": 10}],
        stock_update=[{"update_id": 100, "part_num": 7, "type": "OUT", "qty": 1}],
    )
    posting = post_receipts(
        D,
        batch(
            [(1, 2, DAY), (2, 9, DAY), (3, 1, DAY), (4, 1, None)],
            [(1, 1, "7", "2", "1"), (1, 2, "7", "", "1"), (1, 3, "7", "3", "2"),
             (2, 1, "7", "5", "1"), (3, 1, "7", "4.5", "1")],
            "submission_id long, po_no long, grn_date date",
        ),
        TODAY,
    )
    heads = records(posting.added["goods_receipt_head"], "grn_no", "po_no", "vendor")
    assert sorted(heads) == [(11, 2, 4), (12, 1, 3)]
    moves = posting.added["stock_update"]
    assert sorted(records(moves, "update_id", "type", "qty", "update_date")) == [
        (101, "IN", 2.0, "2024-04-30"), (102, "IN", 3.0, "2024-04-30"),
        (103, "IN", 4.5, "2024-04-30"),
    ]
    received = posting.added["goods_receipt_tran"].agg(F.sum("quantity")).first()[0]
    assert received == moves.agg(F.sum("qty")).first()[0]
    assert reasons(posting) == {2: ["unknown purchase order"], 4: ["missing date"]}
    assert records(stock.ledger_level(posting.apply(D))) == [(7, 8.5)]


def test_movements_and_adjustments(spark, tables):
    D = tables(stock_update=[{"update_id": 5, "part_num": 1, "type": "IN", "qty": 1}])
    forms = spark.createDataFrame(
        [(1, 1, "OUT", 2.0), (2, None, "IN", 2.0), (3, 1, "INCREASE", 2.0), (4, 1, "IN", None)],
        "submission_id long, part_num long, type string, quantity double",
    )
    moved = post_movements(D, forms, TODAY)
    assert records(moved.added["stock_update"], "update_id", "type", "qty", "update_date") == [
        (6, "OUT", 2.0, "2024-05-01")
    ]
    assert reasons(moved) == {
        2: ["missing part"], 3: ["unknown type"], 4: ["missing quantity"]
    }
    adjusted = post_adjustments(D, forms, TODAY)
    assert records(adjusted.added["stock_update"], "update_id", "type") == [(6, "INCREASE")]


INDENT_HEAD = (
    "submission_id long, indent_id long, indent_dt date, department string,"
    " requested_by string, remarks string"
)
INDENT_LINE = (
    "submission_id long, position int, part_num string, part_desc string, quantity string,"
    " required_date string, item_remarks string"
)


def test_create_indents(tables, batch):
    D = tables(indent_request_head=[{"indent_id": 3, "status": "PENDING"}])
    posting = create_indents(
        D,
        batch(
            [(1, None, DAY, "IT", "A", ""), (2, 3, DAY, "IT", "A", ""),
             (3, None, DAY, "IT", "A", ""), (4, None, DAY, "IT", "A", "")],
            [(1, 1, "4", "x", "0", "", ""), (1, 2, "4", "x", "1.5", "", "r"),
             (2, 1, "4", "x", "1", "", ""), (3, 1, "4", "x", "-1", "", ""),
             (4, 1, "4", "x", "1", "2024-06-01", ""), (4, 2, "q", "x", "1", "", "")],
            INDENT_HEAD,
            INDENT_LINE,
        ),
        NOW,
    )
    heads = records(posting.added["indent_request_head"], "indent_id", "status", "created")
    assert heads == [(4, "PENDING", NOW)]
    lines = records(
        posting.added["indent_request_tran"], "indent_id", "rowid", "quantity", "required_date"
    )
    assert lines == [(4, 2, 1.5, None)]
    assert reasons(posting) == {
        2: ["number exists"], 3: ["no valid item"], 4: ["unreadable line"]
    }


def test_update_indents(tables, batch):
    D = tables(
        indent_request_head=[
            {"indent_id": 1, "status": "PENDING"}, {"indent_id": 2, "status": "APPROVED"}
        ],
        indent_request_tran=[{"indent_id": 1, "rowid": 1, "quantity": 1}],
    )
    posting = update_indents(
        D,
        batch(
            [(1, 1, DAY, "HR", "B", ""), (2, 2, DAY, "HR", "B", ""), (3, 9, DAY, "HR", "B", ""),
             (4, 1, DAY, "IT", "C", "")],
            [(n, 1, "4", "x", str(n), "", "") for n in (1, 2, 3, 4)],
            INDENT_HEAD,
            INDENT_LINE,
        ),
        NOW,
    )
    heads = sorted(records(posting.state["indent_request_head"], "indent_id", "department"))
    assert heads == [(1, "IT"), (2, None)]
    lines = posting.state["indent_request_tran"]
    assert records(lines.filter("active"), "indent_id", "quantity") == [(1, 4.0)]
    assert lines.count() == 3
    assert reasons(posting) == {2: ["not pending"], 3: ["not found"]}


def test_decisions(spark, tables):
    D = tables(
        indent_request_head=[
            {"indent_id": 1, "status": "PENDING"}, {"indent_id": 2, "status": "REJECTED"}
        ]
    )
    at = [dt.datetime(2024, 5, 1, h) for h in range(4)]
    decisions = spark.createDataFrame(
        [(1, "APPROVED", at[0]), (1, "REJECTED", at[1]), (2, "APPROVED", at[2]),
         (9, "APPROVED", at[3])],
        "indent_id long, status string, updated timestamp",
    )
    loose = transition_indents(D, decisions)
    status = dict(records(loose.state["indent_request_head"], "indent_id", "status"))
    assert status == {1: "REJECTED", 2: "APPROVED"}
    assert records(loose.rejects, "indent_id", "reasons") == [(9, ["not found"])]
    strict = transition_indents(D, decisions, strict=True)
    status = dict(records(strict.state["indent_request_head"], "indent_id", "status"))
    assert status == {1: "APPROVED", 2: "REJECTED"}
    assert sorted(records(strict.rejects, "indent_id", "reasons")) == [
        (1, ["not pending"]), (2, ["not pending"]), (9, ["not found"])
    ]


def test_upsert_parts(spark, tables):
    D = tables(
        part=[
            {"part_num": 1, "part_desc": "old", "created_by": "x", "active": False},
            {"part_num": 2, "part_desc": "kept"},
        ]
    )
    forms = spark.createDataFrame(
        [(1, "1", "new", "5", "on", None), (2, "", "fresh", "", None, "on"),
         (3, "8", "a", "1", None, None), (4, "8", "b", "2", None, None),
         (5, "9", "", "2", None, None), (6, "9", "c", "two", None, None)],
        "submission_id long, part_num string, part_desc string, pur_price string,"
        " active string, lot string",
    )
    posting = upsert_master(D, "part", forms, TODAY)
    got = records(
        posting.state["part"], "part_num", "part_desc", "pur_price", "active", "lot", "created_by"
    )
    assert sorted(got) == [
        (1, "new", 5.0, True, False, "x"),
        (2, "kept", None, True, None, None),
        (8, "b", 2.0, False, False, "admin"),
        (9, "fresh", None, True, True, "admin"),
    ]
    assert reasons(posting) == {5: ["missing part_desc"], 6: ["unreadable field"]}


def test_validation_rules(spark):
    lines = spark.createDataFrame(
        [("1", "0.01", "999999", "100"), ("", "0", "1", "101"), ("1", "1000000", "x", ""),
         ("1", "", "1", None)],
        "part_num string, quantity string, rate string, tax_percent string",
    )
    valid, bad = validation.validate(lines, "line")
    assert valid.count() == 2 - 1
    got = sorted(records(bad, "reasons"))
    assert got == sorted([
        (["missing part", "quantity out of range", "tax out of range"],),
        (["quantity out of range", "rate out of range"],),
        (["missing quantity"],),
    ])
    vendors = spark.createDataFrame(
        [(1, "A & B (P) Ltd.", "27ABCDE1234F1Z5", "ABCDE1234F"), (2, "A#1", "27", "AB"),
         (None, "", "", "")],
        "vendor_code int, vendor_name string, gst string, pan string",
    )
    valid, bad = validation.validate(vendors, "vendor")
    assert records(valid, "vendor_code") == [(1,)]
    assert sorted(records(bad, "reasons")) == [
        (["bad vendor_name", "bad gst", "bad pan"],),
        (["missing vendor_code", "missing vendor_name"],),
    ]


def test_receipt_validation(tables, batch):
    D = tables(
        part=[{"part_num": 7}],
        purchase_order_head=[{"po_no": 1}],
        purchase_order_tran=[{"po_no": 1, "rowid": 1, "partnum": 7, "quantity": 5}],
    )
    forms = batch(
        [(1, 1, DAY), (2, 1, DAY), (3, 1, DAY), (4, 1, DAY)],
        [(1, 1, "7", "5", "1"), (2, 1, "7", "5.01", "1"), (3, 1, "7", "0", "1")],
        "submission_id long, po_no long, grn_date date",
    )
    valid, bad = validation.validate_receipts(D, forms)
    assert records(valid, "submission_id") == [(1,)]
    assert sorted(records(bad, "submission_id", "reasons")) == [
        (2, ["more than pending"]), (3, ["nothing received"]), (4, ["nothing received"])
    ]


def test_rejects_need_no_job(spark):
    """Numbering runs jobs; a posting's checks and its list of rejects are plans only."""
    D = star_tables(spark, SF_DIR)
    spark.sparkContext.setJobGroup("building", "postings without an action")
    post_documents(D, PURCHASE, forms.order_edits(D), TODAY).rejects
    post_receipts(D, forms.receipt_forms(D), TODAY).rejects
    post_movements(D, forms.movement_forms(D), TODAY).rejects
    create_indents(D, forms.new_indents(D), NOW).rejects
    upsert_master(D, "part", forms.part_forms(D), TODAY).rejects
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs
