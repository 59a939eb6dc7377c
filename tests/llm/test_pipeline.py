"""The stages on planted cases, and the registered queries against DuckDB."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, difference
from llm_cases import EDGES, SF_DIR
from tallyhouse.llm import positions, queries, shared, simhash

STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_oracle(spark, name):
    got = queries.QUERIES[name](spark, SF_DIR)
    assert difference(got, connect(SF_DIR), queries.ORACLE[name]) is None


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in got} < ids and len({r.doc_id for r in got}) == len(got) > 0.5 * len(ids)


def test_stages_keep_columns_and_clean_documents(spark, documents):
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, f"document number {i} " + " ".join(f"w{i}x{j}" for j in range(40))) for i in range(30)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " " + passage), (102, passage + " and something else"), *EDGES]
    docs = documents(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        done = stage(spark, docs, SF_DIR)
        docs = spark.createDataFrame(done.collect(), done.schema)
        assert docs.columns[:5] == COLUMNS and docs.count() <= before
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert set(range(9, 30)) <= left, name
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert 100 not in texts and not {1, 2, 4, 7} & (set(texts) - {r[0] for r in rows[:30]})
    assert passage in texts[101] and passage not in texts.get(102, "")
    assert len(STAGE["tokens"](spark, docs, SF_DIR).collect()) == len(docs.collect())


def test_near_copies_lose_all_but_one(spark, documents):
    got = STAGE["near copies"](spark, documents(EDGES), SF_DIR).collect()
    assert sum(r.text is not None and r.text.startswith("the same") for r in got) == 1


def test_contaminated_documents_go(spark, documents):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    rows = [(1, "before " + item + " after"), (2, "a clean text of its own"), (3, None)]
    got = STAGE["benchmark"](spark, documents(rows), SF_DIR).collect()
    assert {r.doc_id for r in got} == {2, 3}


def test_empty_table(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).collect() == []


def test_other_splits_between_scans(spark, documents, split_anew):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first().text
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40 + i))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 40, 4)] + [(200, item)]
    docs = split_anew(documents(rows), corpus_pipeline, positions, simhash, shared)
    left = {r.doc_id for r in STAGE["near copies"](spark, docs, SF_DIR).collect()}
    assert left == {*range(40), 200}
    left = {r.doc_id for r in STAGE["benchmark"](spark, docs, SF_DIR).collect()}
    assert left == {i for i, _ in rows} - {200}


def test_no_language_to_learn(spark, documents):
    docs = documents([(i, f"clean document {i}") for i in range(6)] + [(7, "12 34"), (8, None), (9, "")])
    got = STAGE["language"](spark, docs.withColumn("lang", F.lit(None).cast("string")), SF_DIR).collect()
    assert {r.doc_id for r in got} == set(range(6))
