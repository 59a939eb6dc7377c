"""Exact duplicates against a plain computation; the index over batches, replays and sessions."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_cases import EDGES
from tallyhouse.llm import digests
from tallyhouse.llm.shared import ROW


def sha(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return hashlib.sha256(lowered.encode()).hexdigest()


def plain(rows):
    """(doc_id, keep_id, group_size, kept, sha) a row; one row of a group is kept."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(sha(text), []).append(doc_id)
    out, kept = [], set()
    for doc_id, text in rows:
        s = sha(text)
        top = max((d for d in groups[s] if d is not None), default=None)
        stays = doc_id == top and s not in kept
        if stays:
            kept.add(s)
        out.append((doc_id, top, len(groups[s]), stays, s))
    return out


ROWS = EDGES + [(20, "Case And ÄÖ"), (21, "case and ÄÖ"), (22, "case and äö"), (20, "Case And ÄÖ")]


def test_edges(documents):
    got = [tuple(r) for r in digests.op12_digest_index(documents(ROWS)).collect()]
    assert Counter(got) == Counter(plain(ROWS))
    assert digests.op12_digest_index(documents([])).collect() == []


def test_hot_groups_take_the_broadcast_path(documents, monkeypatch):
    monkeypatch.setattr(digests, "max", lambda *a: 2, raising=False)
    rows = [(i, f"text {i % 7 if i % 2 else 0}") for i in range(60)]
    got = [tuple(r) for r in digests.op12_digest_index(documents(rows)).collect()]
    assert Counter(got) == Counter(plain(rows))


@pytest.fixture
def batch(spark):
    def build(rows):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        stored = frame.withColumn(ROW, F.monotonically_increasing_id())
        return stored.withColumn("digest", digests.digest(F.col("text")))

    return build


def judged(rows, index, name):
    found = digests.verdicts(rows, index, name).select("doc_id", "keep_id", "kept").collect()
    return sorted(map(tuple, found))


def test_later_batches_and_replays(spark, batch, tmp_path):
    path = str(tmp_path)
    first = digests.open_index(spark, path, 4)
    one, two = batch([(1, "a"), (2, "A"), (3, "b")]), batch([(9, "a"), (8, "c"), (7, "C")])
    assert judged(one, first, "one") == [(1, 2, False), (2, 2, True), (3, 3, True)]
    again = digests.open_index(spark, path, 64)
    assert again.n_buckets == 4
    want = [(7, 8, False), (8, 8, True), (9, 2, False)]
    assert judged(two, again, "two") == want
    before = again.entries().count()
    assert judged(two, again, "two") == want and again.entries().count() == before == 3
    assert judged(one, again, "one") == [(1, 2, False), (2, 2, True), (3, 3, True)]


def test_another_session_opens_the_stored_index(spark, batch, tmp_path):
    index = digests.open_index(spark, str(tmp_path), 4)
    judged(batch([(1, "a")]), index, "one")
    spark.sql(f"drop table {index.name}")  # a session without a metastore does not know the table
    reopened = digests.open_index(spark, str(tmp_path))
    assert judged(batch([(5, "a")]), reopened, "two") == [(5, 1, False)]


def test_the_index_side_of_the_anti_join_does_not_move(spark, batch, tmp_path):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = digests.open_index(spark, str(tmp_path), n)
    index.add(batch([(1, "a"), (2, "b")]).selectExpr("digest", "doc_id as keep_id"), "one")
    new = batch([(3, "c")]).groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
    joined = new.join(index.entries().hint("merge"), "digest", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan and "LeftAnti" in plan
    assert "Bucketed: true" in plan and "Python" not in plan


def test_documents_keep_their_columns(documents, spark, tmp_path):
    index = digests.open_index(spark, str(tmp_path), 4)
    docs = documents(EDGES)
    kept = digests.distinct_documents(docs, index, "one")
    assert kept.columns == docs.columns
    want = [(d, s) for d, _, _, stays, s in plain(EDGES) if stays]
    got = [(r.doc_id, sha(r.text)) for r in kept.collect()]
    assert Counter(got) == Counter(want)
