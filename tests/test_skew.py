"""One key with a third of all rows: right results, and work split over tasks."""

import datetime as dt
import random
from pathlib import Path

import pytest
from compare import SF_DIR
from pyspark.sql import functions as F

from tallyhouse.functions import ordering
from tallyhouse.functions.joins import with_per_key
from tallyhouse.functions.ordering import newest, running_totals, top_n_per
from tallyhouse.operators import dashboard, history, parties
from tallyhouse.sources.star import star_tables

ROWS = 6000


def hot_rows(spark):
    rng = random.Random(5)
    data = [
        (1 if rng.random() < 0.4 else rng.randrange(2, 400), rng.randrange(60), i,
         rng.randrange(-9, 10))
        for i in range(ROWS)
    ]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k int, day int, id int, v int").repartition(8)


def test_running_totals_equal_brute_force(spark):
    data, df = hot_rows(spark)
    want, sums, counts = {}, {}, {}
    for k, day, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        sums[k] = sums.get(k, 0) + v
        counts[k] = counts.get(k, 0) + 1
        want[i] = (sums[k], counts[k])
    got = running_totals(df, ["k"], ["day"], ["day", "id"], total=F.col("v"), n=F.lit(1))
    assert {r.id: (r.total, r.n) for r in got.collect()} == want


def test_running_totals_shuffle_the_rows_by_key_and_segment(spark):
    _, df = hot_rows(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = running_totals(df, ["k"], ["day"], ["day", "id"], total=F.col("v"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SinglePartition" not in text
    # Only the per-segment sums are shuffled by the bare key.
    by_key = [s for s in text.splitlines() if "hashpartitioning(k#" in s and "day#" not in s]
    assert len(by_key) == 1


def test_only_crowded_buckets_are_totalled_by_segment(spark, monkeypatch):
    """Rows that fit a task are windowed whole; more than ``MOST`` of a bucket go through their segments."""
    data, df = hot_rows(spark)
    assert ordering.split_buckets(df, ["k"], ["day"]).count() == 0
    monkeypatch.setattr(ordering, "MOST", 100)
    assert ordering.split_buckets(df, ["k"], ["day"]).count() == 1
    want, sums = {}, {}
    for k, _, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        want[i] = sums[k] = sums.get(k, 0) + v
    got = running_totals(df, ["k"], ["day"], ["day", "id"], total=F.col("v"))
    assert {r.id: r.total for r in got.collect()} == want


def test_running_totals_with_null_keys_and_segments(spark):
    rows = [(None, 1, 1), (None, 1, 2), (None, 2, 3), (7, None, 4), (7, 1, 5), (7, 2, 6)]
    df = spark.createDataFrame(rows, "k int, day int, id int")
    got = running_totals(df, ["k"], ["day"], ["day", "id"], n=F.lit(1))
    # Without a key there is no running on from one segment to the next.
    assert {r.id: r.n for r in got.collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 2, 6: 3}


def test_a_segment_without_values_has_no_running_total(spark):
    rows = [(7, 1, 1, 5), (7, 2, 2, None), (7, 2, 3, 4), (8, 1, 4, 6)]
    df = spark.createDataFrame(rows, "k int, day int, id int, v int")
    got = running_totals(df, ["k"], ["day"], ["day", "id"], total=F.col("v"))
    assert {r.id: r.total for r in got.collect()} == {1: 5, 2: None, 3: 9, 4: 6}


def test_top_n_is_cut_before_the_shuffle(spark):
    data, df = hot_rows(spark)
    top = top_n_per(df, ["k"], newest("v", "id"), 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    best = sorted((r[3], r[2]) for r in data if r[0] == 1)[-3:]
    assert sorted((r.v, r.id) for r in top.filter("k = 1").collect()) == best


@pytest.fixture
def eager_skew_handling(spark):
    """Thresholds small enough for test data, and no broadcasts."""
    settings = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        # Test data is so small that all of it would otherwise come from one map task.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_join_with_an_aggregate_splits_a_hot_key(spark, eager_skew_handling):
    data, df = hot_rows(spark)
    per_key = df.groupBy("k").agg(F.sum("v").alias("total"))
    joined = with_per_key(df, per_key, ["k"])
    got = {(r.id, r.total) for r in joined.collect()}
    sums = {}
    for k, _, _, v in data:
        sums[k] = sums.get(k, 0) + v
    assert got == {(i, sums[k]) for k, _, i, _ in data}
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_join_leaves_null_keys_unmatched(spark):
    rows = spark.createDataFrame([(None, 1), (2, 2), (3, 3)], "k int, id int")
    info = spark.createDataFrame([(None, "x"), (2, "y")], "k int, label string")
    got = {(r.id, r.k, r.label) for r in with_per_key(rows, info, ["k"]).collect()}
    assert got == {(1, None, None), (2, 2, "y"), (3, 3, None)}


@pytest.fixture
def hot_order(spark, tmp_path):
    """The star tables with 40 % of all lines on one vendor and month, and order keys as far
    apart as in large data, so that the hot order has many segments."""
    for source in Path(SF_DIR).iterdir():
        if source.stem != "lineitem":
            (tmp_path / source.name).symlink_to(source)
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    hot = F.col("l_orderkey") % 5 < 2
    lines.withColumns(
        {
            "l_orderkey": F.col("l_orderkey") * 1_000_000,
            "l_suppkey": F.when(hot, F.lit(1).cast("bigint")).otherwise(F.col("l_suppkey")),
            "l_shipdate": F.when(hot, F.lit("1997-03-04").cast("timestamp_ntz")).otherwise(
                F.col("l_shipdate")
            ),
        }
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    return star_tables(spark, str(tmp_path))


@pytest.mark.parametrize(
    "report",
    [
        lambda D: history.purchase_history(D, limit=None),
        parties.part_recent_purchases,
        parties.top_parts_by_vendor,
    ],
)
def test_lines_of_a_hot_order_are_split(eager_skew_handling, hot_order, report):
    df = report(hot_order)
    assert df.collect()
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "report",
    [
        history.purchase_summary,
        lambda D: dashboard.top_vendors(D, dt.date(1997, 6, 1)),
        lambda D: dashboard.revenue_vs_expense(D, dt.date(1997, 6, 1)),
    ],
)
def test_lines_are_summed_before_they_meet_the_heads(eager_skew_handling, hot_order, report):
    """Below every join of the plan, lines have passed a partial aggregate on their document."""
    df = report(hot_order)
    assert df.collect()
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {i: len(line) - len(line.lstrip(" :+-")) for i, line in enumerate(plan)}
    for i, line in enumerate(plan):
        if "Relation [" not in line or "l_quantity" not in line and "l_extendedprice" not in line:
            continue
        above, at = [], depth[i]
        for j in range(i - 1, -1, -1):
            if depth[j] < at:
                at = depth[j]
                above.append(plan[j].lstrip(" :+-").split()[0])
        assert "Aggregate" in above and above.index("Aggregate") < above.index("Join")
