"""Reading back what was written: appends, exports, publications, streams."""

import datetime as dt

import pytest

from compare import SF_DIR, records, rows
from pyspark.sql import functions as F

from tallyhouse.operators import documents, stock
from tallyhouse.schemas import DDL
from tallyhouse.sources.readers import load_tables, lookup
from tallyhouse.sources.sinks import append, export_report, publish, published, read_appended
from tallyhouse.sources.star import star_tables
from tallyhouse.streaming.ledger import post_stream, read_ledger


def multiset(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def test_tables_written_and_loaded_give_the_same_report(spark, tmp_path):
    D = star_tables(spark, SF_DIR)
    for name in DDL:
        getattr(D, name).write.parquet(f"{tmp_path}/{name}")
    loaded = load_tables(spark, str(tmp_path))
    assert loaded.part.schema.names == D.part.schema.names
    for report in (documents.po_register, stock.stock_on_hand):
        assert multiset(report(loaded)) == multiset(report(D))


def test_lookup_of_many_keys(spark, tables):
    D = tables(vendor=[{"vendor_code": n, "company": c} for n, c in [(1, 1), (2, 1), (2, 2)]])
    keys = spark.createDataFrame([(2,), (2,), (5,)], "vendor_code long")
    assert records(lookup(D.vendor, keys, ["vendor_code"]), "company", "vendor_code") == [(1, 2)]


def test_append_adds_months_and_reads_only_some(spark, frame, tmp_path):
    path = str(tmp_path / "ledger")
    for update_id, day in [(1, "2024-01-31"), (2, "2024-02-01"), (3, "2024-03-01"), (4, None)]:
        rows_ = frame("stock_update", {"update_id": update_id, "update_date": day, "qty": 1})
        append(rows_, path, "update_date")
    assert read_appended(spark, path, "stock_update").count() == 4
    some = read_appended(spark, path, "stock_update", "2024-02", "2024-02")
    assert records(some, "update_id", "update_date") == [(2, "2024-02-01")]
    assert "PartitionFilters: [isnotnull(month" in some._jdf.queryExecution().executedPlan().toString()


def test_export_formats(spark, frame, tmp_path):
    report = frame("purchase_order_head", {"po_no": 1, "po_date": "2024-02-03"}).select(
        "po_no", "po_date"
    )
    export_report(report, f"{tmp_path}/csv", "csv", "day_first")
    assert spark.read.text(f"{tmp_path}/csv").collect()[0].value == "po_no,po_date"
    assert spark.read.csv(f"{tmp_path}/csv", header=True).first().po_date == "03-02-2024"
    export_report(report, f"{tmp_path}/parquet", "parquet")
    assert spark.read.parquet(f"{tmp_path}/parquet").first().po_date == dt.date(2024, 2, 3)


def test_publication_shows_the_last_complete_version(spark, frame, tmp_path):
    root = str(tmp_path)
    first = {"unit": frame("unit", {"unit_id": 1}), "tax": frame("tax", {"tax_id": 7})}
    publish(spark, first, root, 9)
    publish(spark, {"unit": frame("unit", {"unit_id": 2})}, root, 10)
    frame("unit", {"unit_id": 3}).write.parquet(f"{root}/11/unit")
    assert records(published(spark, root).unit, "unit_id") == [(2,)]
    assert records(published(spark, root).tax, "tax_id") == [(7,)]
    with pytest.raises(ValueError):
        publish(spark, first, root, 10)


def test_stream_numbers_movements_across_batches(spark, frame, tmp_path):
    forms = "submission_id long, part_num long, type string, quantity decimal(18,2)"
    source = str(tmp_path / "forms")
    opening = frame("stock_update", {"update_id": 10, "part_num": 1, "type": "IN", "qty": 5})

    def arrive(*data):
        spark.createDataFrame(data, "a long, b long, c string, d double").selectExpr(
            "a as submission_id", "b as part_num", "c as type", "cast(d as decimal(18,2)) as quantity"
        ).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(forms).parquet(source)
        path = str(tmp_path / "ledger")
        query = post_stream(
            stream, opening, path, str(tmp_path / "state"), dt.date(2024, 1, 1)
        )
        query.awaitTermination()
        assert query.exception() is None
        return read_ledger(spark, path)

    arrive((1, 1, "IN", 2.0), (2, 1, "GIFT", 2.0))
    assert records(run(), "update_id") == [(11,)]
    arrive((3, 1, "OUT", 1.0), (4, None, "OUT", 1.0))
    ledger = run()
    assert sorted(records(ledger, "update_id", "type")) == [(11, "IN"), (12, "OUT")]
    total = ledger.drop("arrival").unionByName(opening)
    assert total.agg(F.count_distinct("update_id")).first()[0] == 3
