import itertools
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_cases import CLASHES, SF_DIR  # noqa: E402

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def documents(spark):
    """documents([(doc_id, text), ...]): the table with clashing extra columns; lang is en."""

    def build(rows):
        data = [(i, t, "en", "src", len(t or ""), *["x"] * len(CLASHES)) for i, t in rows]
        extra = ", ".join(f"`{c}` string" for c in CLASHES)
        layout = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
        return spark.createDataFrame(data, layout)

    return build


@pytest.fixture(scope="session")
def given(spark):
    """The smallest documents table as rows in doc_id order."""
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    return [(r.doc_id, r.text, r.lang) for r in rows]


@pytest.fixture
def split_anew(spark, monkeypatch, tmp_path):
    """split_anew(df, module, ...): ``df`` as a stored table of five files; after each table that a module
    stages, scans are split otherwise, as when an executor was lost or added."""

    def build(df, *modules):
        sizes = itertools.cycle(["128m", "1k", "2k"])

        def resized(f):
            def call(*args):
                out = f(*args)
                spark.conf.set(SPLIT, next(sizes))
                return out

            return call

        for m in modules:
            monkeypatch.setattr(m, "staged", resized(m.staged))
        df.repartition(5).write.parquet(f"{tmp_path}/docs")
        return spark.read.parquet(f"{tmp_path}/docs")

    before = spark.conf.get(SPLIT)
    yield build
    spark.conf.set(SPLIT, before)
