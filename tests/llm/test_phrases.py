"""Collocations against a plain count of every phrase."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import EDGES, SF_DIR
from tallyhouse.llm import phrases


def plain(rows, least, most=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    f = {key: n for key, n in f.items() if n >= least}
    found = {}
    for (lang, w), a in f.items():
        parts = [w[i : i + k] for k in range(2, len(w)) for i in range(len(w) - k + 1)]
        for part in parts:
            if 100 * a >= 80 * f[lang, part]:
                found[lang, part] = None
        if len(w) > 1 and (lang, w) not in found:
            cuts = [(f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            l, r = min(cuts, key=lambda c: 2000000 * a // sum(c))
            found[lang, w] = (2000000 * a // (l + r), a, " ".join(w), l, r)
    out = []
    for lang in total:
        kept = [v for (g, _), v in found.items() if g == lang and v]
        kept.sort(key=lambda v: (-v[0], -v[1], v[2].encode()))
        for rank, (score, a, phrase, l, r) in enumerate(kept[:most], 1):
            out.append((lang, rank, phrase, a, l, r, total[lang], score))
    return out


def check(docs, rows, least, most=2000):
    got = [tuple(r) for r in phrases.collocations(docs.select("lang", "text"), least, most).collect()]
    assert Counter(got) == Counter(plain(rows, least, most))
    return got


def test_given_documents(spark, given):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = check(docs, [(lang, t) for _, t, lang in given], 30)
    assert got and max(len(r[2].split(" ")) for r in got) == 4


@pytest.fixture
def tiny_blocks(monkeypatch):
    monkeypatch.setattr(phrases, "PLACES", 7)
    monkeypatch.setattr(phrases, "HELD", 20)
    monkeypatch.setattr(phrases, "SLICE", 11)
    monkeypatch.setattr(phrases, "DEAL", 10)


def random_rows(n):
    random = np.random.RandomState(7)
    words = ["a", "B", "cc", "dé", "e\x1ff", "g-h"]
    ends = [" ", " ", " ", "\t", ", ", "\n", "  ", ".", "\x0b"]
    texts = ["".join(words[random.randint(6)] + ends[random.randint(9)] for _ in range(random.randint(60)))
             for _ in range(n)]
    return [([None, "und", "en", "de"][i % 4], t) for i, t in enumerate(texts)]


def test_phrases_across_blocks(spark, tiny_blocks):
    """Texts much longer than a block, hand-made piece ends, a null language."""
    rows = random_rows(60) + [("en", None), ("en", ""), ("fr", "one two"), (None, " . ;")]
    check(spark.createDataFrame(rows, "lang string, text string"), rows, 3)
    check(spark.createDataFrame(rows, "lang string, text string"), rows, 2, most=5)


def test_edges(documents):
    rows = [("en", t) for _, t in EDGES]
    assert check(documents(EDGES), rows, 2)
    assert phrases.op11_setm_collocations(documents([])).collect() == []


def test_frequent_phrases_of_a_shuffled_join(spark):
    """The semi-join does not need a broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before, rows = spark.conf.get(name), random_rows(20)
    spark.conf.set(name, -1)
    try:
        check(spark.createDataFrame(rows, "lang string, text string"), rows, 2)
    finally:
        spark.conf.set(name, before)


def test_a_task_sends_a_phrase_once_a_large_block(spark):
    """1.5 million words of two languages that alternate are one block each, and their counts are whole."""
    rows = [(["en", "de"][i % 2], "one two three " * 5000) for i in range(100)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    found = phrases.blocks(docs, 1).groupBy("lang").agg(F.count("*"), F.sum("n_words")).collect()
    assert sorted(tuple(r) for r in found) == [("de", 1, 750_000), ("en", 1, 750_000)]
