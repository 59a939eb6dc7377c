"""Recall against brute force, exact scores, and the radius guarantee of the substring index."""

import numpy as np
from pyspark.sql import functions as F

from llm_cases import SF_DIR
from tallyhouse.llm import neighbours


def test_every_code_in_the_radius_is_retrieved():
    random = np.random.RandomState(3)
    codes = random.randint(0, 256, (400, 8)).astype(np.uint8)
    asked = np.concatenate([codes[:20] ^ (random.rand(20, 8) < 0.2).astype(np.uint8), codes[20:25]])
    index = neighbours.SubstringIndex(codes)
    for radius in (0, 1, 7, 8, 13, 26, 31, 64):
        assert (index.retrieve(asked, radius) == (neighbours.hamming(asked, codes) <= radius)).all()


def test_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    got = neighbours.op1_multi_index_hashing(table).toPandas()
    rows = table.orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.array([r.embedding for r in rows], float)
    found = 0
    for q in np.nonzero(ids % 20 == 0)[0]:
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own["score"], scores[own.vec_id])
        assert (np.diff(own["score"]) <= 0).all()
        found += len(set(own.vec_id) & set(ids[np.argsort(-scores)[:20]]))
    assert found >= 0.9 * len(got)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 2.0]
    rows = [
        (0, same), (20, same), (1, same), (1, same), (3, [2.0, 4.0, 4.0]), (4, None), (5, [0.0, 0.0, 0.0]),
        (6, [1.0, nan, 0.0]), (7, [1.0, None, 0.0]), (8, [inf, 0.0, 0.0]), (9, [1.0]), (None, same), (10, []),
        (2, [-1.0, 0.0, 0.0]),
    ]
    data = [(i, v, "x", 1.0) for i, v in rows]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, row string, score double")
    got = neighbours.op1_multi_index_hashing(table).collect()
    by_query = {q: [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 20)}
    assert by_query[0] == [(1, 3, 18.0), (2, 1, 9.0), (3, 1, 9.0), (4, 20, 9.0), (5, 2, -1.0)]
    assert by_query[20] == [(1, 3, 18.0), (2, 0, 9.0), (3, 1, 9.0), (4, 1, 9.0), (5, 2, -1.0)]
    assert len(got) == 10
    assert neighbours.op1_multi_index_hashing(table.limit(0)).collect() == []
    assert neighbours.op1_multi_index_hashing(table.where("vec_id = 0")).collect() == []


def test_blocks_agree(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    random = np.random.RandomState(0)
    v = np.concatenate([random.standard_normal((300, 8)) * random.rand(300, 1), np.ones((200, 8))])
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=5).toPandas()
    assert got.groupby("query_id").size().tolist() == [5] * 25
    last = got[got.query_id == 480].sort_values("rank")
    assert last.vec_id.tolist() == [300, 301, 302, 303, 304]
