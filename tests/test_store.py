"""Versions of stored tables: touched months, atomic versions, replays, conflicts, compaction."""

import datetime as dt
from collections import Counter
from dataclasses import replace

import pytest
from compare import SF_DIR, records, rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyhouse.operators import stock
from tallyhouse.operators.documents import PURCHASE, RECEIPT
from tallyhouse.operators.history import purchase_history
from tallyhouse.plans.batches import Batch, Posting
from tallyhouse.plans.documents import replace_documents, soft_delete
from tallyhouse.plans.indents import transition_indents
from tallyhouse.plans.masters import upsert_master
from tallyhouse.plans import stock as post_stock
from tallyhouse.plans.stock import post_movements, post_receipts
from tallyhouse.sources import star_batches as forms
from tallyhouse.sources.star import star_tables
from tallyhouse.sources.store import NO_MONTH, Conflict, Store, balance_between, keep_levels, standing
from tallyhouse.streaming.ledger import stream_into

TODAY = dt.date(2024, 5, 1)
NAMES = ["vendor", PURCHASE.head, PURCHASE.tran, RECEIPT.head, RECEIPT.tran, "stock_update",
         "indent_request_head"]


def multiset(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


@pytest.fixture
def D(tables):
    """Ten orders, one a month, each with two lines; a vendor; a ledger of two months."""
    months = [f"2024-{m:02}-05" for m in range(1, 11)]
    return tables(
        vendor=[{"vendor_code": 1, "vendor_name": "Acme"}, {"vendor_code": 2, "vendor_name": "Bolt"}],
        purchase_order_head=[{"po_no": i, "po_date": d, "vendor": 1} for i, d in enumerate(months, 1)]
        + [{"po_no": 3, "po_date": "2024-03-05", "vendor": 1, "company": 2}],
        purchase_order_tran=[
            {"po_no": i, "rowid": r, "partnum": 7, "quantity": 2, "unit_price": 3, "amount": 6}
            for i in range(1, 11) for r in (1, 2)
        ],
        stock_update=[{"update_id": 1, "part_num": 7, "type": "IN", "qty": 9, "update_date": "2024-01-31"},
                      {"update_id": 2, "part_num": 7, "type": "OUT", "qty": 4, "update_date": None}],
        indent_request_head=[{"indent_id": 1, "indent_dt": "2024-02-01", "status": "PENDING"}],
    )


@pytest.fixture
def store(spark, tmp_path, D):
    s = Store(spark, str(tmp_path / "store"))
    s.create(D, NAMES)
    return s


@pytest.fixture
def edit(spark):
    """edit(order, day): one order under a new date with a single line."""

    def build(*orders):
        heads = [(i, no, dt.date.fromisoformat(day), 1, "edited", True) for i, (no, day) in enumerate(orders, 1)]
        layout = "submission_id long, doc_no long, doc_date date, party long, remarks string, active boolean"
        lines = [(h[0], 1, "7", "5", "2") for h in heads]
        entered = "submission_id long, position int, part_num string, quantity string, rate string"
        return Batch(spark.createDataFrame(heads, layout), spark.createDataFrame(lines, entered))

    return build


def movement(spark, *quantities):
    return spark.createDataFrame(
        [(i, 7, "IN", q) for i, q in enumerate(quantities, 1)],
        "submission_id long, part_num long, type string, quantity int",
    )


def files(store):
    """Path and time of every data file."""
    root = store.root + "/data"
    import pathlib

    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in pathlib.Path(root).rglob("*.parquet")}


def test_what_is_stored_is_read(store, D):
    current = store.tables()
    for name in NAMES:
        assert multiset(getattr(current, name)) == multiset(getattr(D, name))
    assert current.part.count() == 0
    manifest = store.manifest()
    assert manifest.marks["purchase_order_head"] == 10 and manifest.marks["stock_update"] == 2
    assert set(manifest.parts["stock_update"]) == {"2024-01", NO_MONTH}
    assert set(manifest.parts["purchase_order_tran"]) == set(manifest.parts["purchase_order_head"])


def test_edits_rewrite_their_months_only(store, D, edit):
    """Order 3 moves from March to June, order 4 stays in April."""
    before, base = files(store), store.manifest()
    batch = edit((3, "2024-06-20"), (4, "2024-04-21"), (99, "2024-07-01"))
    near = store.around(base, PURCHASE.head, batch.heads.select(F.col("doc_no").alias("po_no")))
    assert near.purchase_order_tran.count() == 4
    posting = replace_documents(near, PURCHASE, batch, TODAY)
    after = store.commit(posting, "edits", base)
    whole = replace_documents(D, PURCHASE, batch, TODAY)
    for name in (PURCHASE.head, PURCHASE.tran):
        assert multiset(getattr(store.tables(), name)) == multiset(whole.state[name])
        moved = {m for m, f in after.parts[name].items() if f != base.parts[name].get(m)}
        assert moved | set(base.parts[name]) - set(after.parts[name]) <= {"2024-03", "2024-04", "2024-06"}
        assert after.parts[name]["2024-06"][:1] == base.parts[name]["2024-06"]
    assert before.items() <= files(store).items()
    assert reads(store, base) == multiset(D.purchase_order_head)


@pytest.mark.parametrize("all_months", [True, False])
def test_edited_lines_meet_heads_and_keys_once(store, D, edit, monkeypatch, all_months):
    """Lines come from the posting with their month; from the files if it has not read all touched months."""
    joined = []
    for name in ("_with_month", "_replaced"):
        call = getattr(Store, name)
        monkeypatch.setattr(Store, name, lambda s, *a, call=call: joined.append(PURCHASE.tran in a) or call(s, *a))
    batch, base = edit((3, "2024-06-20"), (3, "2024-07-20")), store.manifest()
    near = store.around(base, PURCHASE.head, D.purchase_order_head.filter("po_no in (3, 4)").select("po_no"))
    posting = replace_documents(near, PURCHASE, batch, TODAY)
    if not all_months:
        posting = replace(posting, months={PURCHASE.tran: ["2024-04"]})
    after = store.commit(posting, "edits", base)
    assert any(joined) != all_months
    assert base.parts[PURCHASE.tran]["2024-04"] == after.parts[PURCHASE.tran]["2024-04"]
    whole = replace_documents(D, PURCHASE, batch, TODAY)
    assert multiset(store.tables().purchase_order_tran) == multiset(whole.state[PURCHASE.tran])
    lines = store.rows(after, PURCHASE.tran).filter("po_no = 3")
    assert {m for (m,) in lines.select("month").collect()} == {"2024-07"}


def reads(store, manifest):
    return multiset(store.tables(manifest).purchase_order_head)


def test_deletions_and_decisions_and_masters(spark, store, D):
    keys = spark.createDataFrame([(2,), (5,)], "po_no long")

    def deletion(base):
        return soft_delete(store.around(base, PURCHASE.head, keys), "purchase", keys, TODAY)

    after = store.post(deletion, "delete")
    whole = soft_delete(D, "purchase", keys, TODAY).state
    for name in (PURCHASE.head, PURCHASE.tran):
        assert multiset(getattr(store.tables(after), name)) == multiset(whole[name])
    decisions = spark.createDataFrame([(1, "APPROVED")], "indent_id long, status string").withColumn(
        "updated", F.lit(dt.datetime(2024, 5, 1))
    )
    store.post(lambda base: transition_indents(store.tables(base), decisions), "decide")
    assert records(store.tables().indent_request_head, "indent_id", "status") == [(1, "APPROVED")]
    entered = spark.createDataFrame(
        [(1, "2", "Bolt & Co", "on"), (2, None, "New", "on")],
        "submission_id long, vendor_code string, vendor_name string, active string",
    )
    store.post(lambda base: upsert_master(store.tables(base), "vendor", entered, TODAY), "vendors")
    assert sorted(records(store.tables().vendor, "vendor_code", "vendor_name")) == [
        (1, "Acme"), (2, "Bolt & Co"), (3, "New"),
    ]
    assert store.manifest().marks["vendor"] == 3


def test_a_receipt_is_saved_whole_and_once(spark, store):
    heads = spark.createDataFrame([(1, 4, dt.date(2024, 5, 2))], "submission_id long, po_no long, grn_date date")
    lines = spark.createDataFrame(
        [(1, 1, "7", "5", "2"), (1, 2, "8", "1", "1")],
        "submission_id long, position int, part_num string, quantity string, rate string",
    )

    def receipt(base):
        return post_receipts(store.tables(base), Batch(heads, lines), TODAY)

    after = store.post(receipt, "receipt 1")
    D = store.tables()
    assert records(D.goods_receipt_head, "grn_no", "po_no") == [(1, 4)]
    assert sorted(records(D.goods_receipt_tran, "grn_no", "rowid")) == [(1, 1), (1, 2)]
    assert sorted(records(D.stock_update, "update_id")) == [(1,), (2,), (3,), (4,)]
    assert list(after.parts[RECEIPT.tran]) == list(after.parts[RECEIPT.head]) == ["2024-05"]
    assert store.post(receipt, "receipt 1") == after  # a replay changes nothing


def test_of_two_writers_one_is_refused_or_builds_anew(spark, store):
    base = store.manifest()
    one, two = (post_movements(store.tables(base), movement(spark, q), TODAY) for q in (1, 2))
    store.commit(one, "one", base)
    with pytest.raises(Conflict):
        store.commit(two, "two", base)
    store.post(lambda b: post_movements(store.tables(b), movement(spark, 2), TODAY), "two")
    assert sorted(records(store.tables().stock_update, "update_id", "qty"))[2:] == [(3, 1.0), (4, 2.0)]


def test_writers_of_different_tables_do_not_meet(spark, store):
    base = store.manifest()
    moves = post_movements(store.tables(base), movement(spark, 1), TODAY)
    deletion = soft_delete(store.tables(base), "vendor", spark.createDataFrame([(2,)], "vendor_code long"), TODAY)
    store.commit(deletion, "delete", base)
    after = store.commit(moves, "moves", base)
    assert after.version == base.version + 2 and after.batches[-2:] == ["delete", "moves"]
    assert store.tables().vendor.filter("not active").count() == 1


def test_a_version_is_put_in_place_once(store):
    following = store.manifest()
    assert not store._put(following)
    assert store.versions() == [1] and not [n for n in store._names(f"{store.root}/versions") if "draft" in n]


def test_a_failed_posting_leaves_no_version_and_no_staging(spark, store):
    base = store.manifest()
    broken = store.tables(base).vendor.withColumn("vendor_name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.commit(Posting(rejects=broken, changed={"vendor": broken}), "broken", base)
    assert store.manifest() == base
    assert not [n for n in store._names(store.root) if n.startswith("staging")]


def test_small_folders_are_merged_behind_readers(spark, store):
    for i in range(3):
        store.post(lambda b: post_movements(store.tables(b), movement(spark, i + 1), TODAY), f"m{i}")
    before = store.manifest()
    old = store.tables(before).stock_update
    want = multiset(old)
    assert len(before.parts["stock_update"]["2024-05"]) == 3
    after = store.compact("stock_update")
    assert len(after.parts["stock_update"]["2024-05"]) == 1
    assert after.parts["stock_update"]["2024-01"] == before.parts["stock_update"]["2024-01"]
    assert multiset(store.tables().stock_update) == multiset(old) == want
    assert store.compact("stock_update") == after
    store.expire(1)
    assert store.versions() == [after.version] and multiset(store.tables().stock_update) == want
    listed = {f for t in after.parts.values() for m in t.values() for f in m}
    assert {p.split("/", 1)[1].rsplit("/", 1)[0] for p in files(store)} == listed


def test_given_orders_edited_in_months(spark, tmp_path):
    D = star_tables(spark, SF_DIR)
    store = Store(spark, str(tmp_path))
    base = store.create(D, [PURCHASE.head, PURCHASE.tran])
    every = forms.order_edits(D)
    some = every.heads.filter("doc_no % 1000 = 5")
    batch = Batch(some, every.lines.join(some.select("submission_id"), "submission_id", "left_semi"))
    near = store.around(base, PURCHASE.head, some.select(F.col("doc_no").alias("po_no")))
    after = store.commit(replace_documents(near, PURCHASE, batch, TODAY), "edits", base)
    same = [m for m, f in base.parts[PURCHASE.tran].items() if f == after.parts[PURCHASE.tran].get(m)]
    assert len(same) > 70
    whole = replace_documents(D, PURCHASE, batch, TODAY)
    for name in (PURCHASE.head, PURCHASE.tran):
        assert multiset(getattr(store.tables(), name)) == multiset(whole.state[name])


def test_streams_post_versions(spark, store, tmp_path):
    source = str(tmp_path / "arrivals")

    def run():
        stream = spark.readStream.schema("submission_id long, part_num long, type string, quantity int").parquet(source)
        query = stream_into(store, "moves", stream, str(tmp_path / "state"), TODAY)
        query.awaitTermination()
        assert query.exception() is None
        return sorted(records(store.tables().stock_update, "update_id"))

    movement(spark, 5, 6).coalesce(1).write.mode("append").parquet(source)
    assert run() == [(1,), (2,), (3,), (4,)]
    store.post(lambda b: post_movements(store.tables(b), movement(spark, 1), TODAY), "by hand")
    movement(spark, 7, None).coalesce(1).write.mode("append").parquet(source)
    assert run() == [(i,) for i in range(1, 7)]
    assert run() == [(i,) for i in range(1, 7)]
    assert store.manifest().batches == ["opening", "moves-0", "by hand", "moves-1"]
    assert spark.read.parquet(f"{store.root}/rejects/moves").count() == 1


@pytest.fixture
def ledger(spark, tmp_path, frame):
    """A ledger of a year, two rows of which have no date and no part."""

    def build(*extra):
        return frame("stock_update", *[
            {"update_id": 100 * m + i, "part_num": i % 3 or None, "type": ["IN", "OUT", "INCREASE"][i % 2 + m % 2],
             "qty": i + m, "update_date": f"2024-{m:02}-{1 + i:02}"}
            for m in range(1, 13) for i in range(6)
        ], {"update_id": 9001, "part_num": 1, "type": "IN", "qty": 1000}, *extra)

    return build


def late(day, n):
    return {"update_id": 9100 + n, "part_num": 2, "type": "IN", "qty": 10**n, "update_date": day}


def ledger_store(spark, tmp_path, rows_):
    store = Store(spark, str(tmp_path / "levels"))
    store.commit(Posting(rejects=None, added={"stock_update": rows_}), "opening", store.manifest())
    return store


def read_folders(df):
    return {f.split("month=")[1][:7] for f in df.inputFiles() if "stock_update" in f}


def test_levels_are_kept_levels_and_the_rows_since(spark, tmp_path, ledger):
    store = ledger_store(spark, tmp_path, ledger())
    keep_levels(store, "2024-04")
    current = keep_levels(store, "2024-09")
    assert read_folders(standing(store, current)) == {"2024-10", "2024-11", "2024-12"}
    assert read_folders(standing(store, current, "2024-07")) == {"2024-05", "2024-06"}
    add = [late("2024-02-03", 1), late("2024-11-30", 2), late(None, 3)]
    more = spark.createDataFrame([], ledger().schema).unionByName(ledger(*add).filter("update_id > 9100"))
    current = store.commit(Posting(rejects=None, added={"stock_update": more}), "late", current)
    whole = stock.movement_sums(ledger(*add))
    assert multiset(standing(store, current)) == multiset(whole)
    for sign in ("reference", "adjusted"):
        got = stock.ledger_level(store.tables(current), sign)
        assert multiset(got) == multiset(whole.select("part_num", F.col(f"level_{sign}").alias("current_stock")))
    before = ledger(*add).filter("update_date is null or update_date < date '2024-07-01'")
    assert multiset(standing(store, current, "2024-07")) == multiset(stock.movement_sums(before))


def test_balance_of_some_months_reads_these_months(spark, tmp_path, ledger, tables):
    add = [late("2024-02-03", 1), late(None, 3)]
    store = ledger_store(spark, tmp_path, ledger(*add))
    current = keep_levels(store, "2024-06")
    got = balance_between(store, current, "2024-07", "2024-08", "adjusted")
    assert read_folders(got) == {"2024-07", "2024-08"}
    whole = stock.stock_running_balance(tables().replace(stock_update=ledger(*add)), "adjusted")
    assert multiset(got) == multiset(whole.filter("month(update_date) in (7, 8)"))


def test_kept_levels_outlast_a_compaction_of_covered_months(spark, tmp_path, ledger):
    store = ledger_store(spark, tmp_path, ledger())
    for n, day in enumerate(["2024-03-09", "2024-08-01"], 1):
        row = ledger(late(day, n)).filter("update_id > 9100")
        store.commit(Posting(rejects=None, added={"stock_update": row}), day, store.manifest())
    keep_levels(store, "2024-05")
    want = multiset(standing(store, store.manifest()))
    current = store.compact("stock_update")
    after = standing(store, current)
    assert multiset(after) == want and min(read_folders(after)) == "2024-06"
    row = ledger(late("2024-03-10", 3)).filter("update_id > 9100")
    store.commit(Posting(rejects=None, added={"stock_update": row}), "one more", current)
    want = multiset(standing(store, store.manifest()))
    current = store.compact("stock_update")  # March is covered in part now: the levels no longer hold
    assert multiset(standing(store, current)) == want
    assert "2024-01" in read_folders(standing(store, current))
    store.expire(1)
    assert multiset(standing(store, store.manifest())) == want


def test_lookups_skip_row_groups(spark, tmp_path):
    """Sparse keys of two commits: limits and Bloom filters leave few row groups to read."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.setInt("parquet.block.size", 1 << 14)
    try:
        store, n = Store(spark, str(tmp_path / "s")), 40_000
        for i in (0, 1):
            ids = spark.range(n).selectExpr(f"id * 20 + {i} as update_id", "1 as company", "id as part_num",
                                            "date'2024-01-01' as update_date")
            store.commit(Posting(rejects=ids, added={"stock_update": ids}), f"b{i}", store.manifest())
    finally:
        hadoop.unset("parquet.block.size")
    current = store.manifest()
    keys = spark.range(100).selectExpr("id * 977 * 20 % 800000 + id % 2 as update_id")
    found = store.find(current, "stock_update", keys)
    assert sorted(records(found, "update_id")) == sorted(records(keys))
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert leaf.metrics().apply("numOutputRows").value() < n
    missing = store.find(current, "stock_update", keys.selectExpr("update_id + 7 as update_id"))
    assert missing.count() == 0 and store.find(current, "stock_update", keys.limit(0)).count() == 0
    many = spark.range(3000).selectExpr("id * 20 as update_id")
    assert store.find(current, "stock_update", many).count() == 3000


def test_history_reads_the_months_asked_for(store, D):
    near = store.between(store.manifest(), "2024-03-05", dt.date(2024, 4, 30))
    for table in (near.purchase_order_head, near.purchase_order_tran):
        assert {f.split("month=")[1][:7] for f in table.inputFiles()} == {"2024-03", "2024-04"}
    dates = {"date_from": "2024-03-05", "date_to": "2024-04-30"}
    assert multiset(purchase_history(near, **dates)) == multiset(purchase_history(D, **dates))
    assert near.purchase_order_tran.count() == 4
    assert store.between(store.manifest()).stock_update.count() == 2


def test_levels_of_stored_tables(store, D):
    assert Counter(records(stock.ledger_level(store.tables()))) == Counter(records(stock.ledger_level(D)))


def test_a_posting_reads_its_batch_from_files(spark, monkeypatch):
    """The forms and lines of a receipt batch are derived once, not by every step that reads them."""
    seen = []
    post = post_stock.post_receipts

    def watched(D, batch, as_of):
        seen.extend([*batch.heads.inputFiles(), *batch.lines.inputFiles()])
        return post(D, batch, as_of)

    monkeypatch.setattr(post_stock, "post_receipts", watched)
    entry.queries()["stored_receipts_lines"](spark, SF_DIR).count()
    assert seen and all("/staging-" in f for f in seen)


def test_staged_frames_are_removed(store, D):
    with store.staged(D.vendor, D.stock_update) as (vendors, moves):
        assert multiset(vendors) == multiset(D.vendor) and multiset(moves) == multiset(D.stock_update)
        assert any(n.startswith("staging-") for n in store._names(store.root))
    assert not any(n.startswith("staging-") for n in store._names(store.root))


def test_many_keys_are_derived_once_and_a_short_list_is_broadcast(spark, store):
    found = store.find(store.manifest(), PURCHASE.tran, spark.range(2, 9).toDF("po_no"), most=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "/keys/" in "".join(found.inputFiles()) and "Range" not in plan
    assert sorted(r.po_no for r in found.collect()) == sorted([*range(2, 9)] * 2)
    store.expire(1)
    assert not store._names(f"{store.root}/keys")


def test_keys_of_a_posting_are_short_enough_to_leave_lines_where_they_are(spark, store):
    """The keys, made by a join of unknown size, are met by lines without a shuffle of the lines."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], 20_000)
    spark.conf.set(names[1], False)
    try:
        made = spark.range(3000).toDF("po_no").join(spark.range(0, 3000, 3).toDF("po_no"), "po_no")
        lines = spark.range(0, 30_000).select(F.lit(1).alias("company"), (F.col("id") % 3000).alias("po_no"))
        keys = made.unionByName(made).select(F.lit(1).alias("company"), "po_no")
        with store.listed(keys) as listed:
            kept = lines.join(listed, ["company", "po_no"], "left_anti")
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
            assert listed.count() == 1000 and kept.count() == 20_000
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)
    assert not [n for n in store._names(store.root) if n.startswith("staging-")]
