"""Phrases and contamination against a scan of all texts."""

import hashlib
import re

from llm_cases import EDGES
from pyspark.sql import functions as F
from tallyhouse.llm import positions, shared

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def plain(rows, items):
    out = []
    for doc_id, text in rows:
        w, hit, names = plain_words(text), set(), set()
        for item_id, item in items:
            own = plain_words(item)
            n = min(13, len(own))
            for a in range(max(0, len(own) - n + 1) if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == own[a : a + n]:
                        hit.update(range(p, p + n))
                        names.add("" if item_id is None else str(item_id))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def items_table(spark, items):
    data = [(i, t, "x") for i, t in items]
    return spark.createDataFrame(data, "item_id long, text string, phrase string")


def check(spark, documents, rows, items):
    got = positions.op8_positional_decontamination(documents(rows), items_table(spark, items))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, items)


def test_contamination(spark, documents):
    rows = [
        (1, "start " + ITEM.upper() + " end"), (1, ITEM), (2, ITEM.replace("eta theta", "eta-theta")),
        (3, " ".join(ITEM.split()[:12])), (4, "short words here"), (None, "x " + "noise " * 400 + ITEM),
        (5, "the the the the the the the the the the the the the the the the"), (6, "Über größe"),
        (7, (ITEM + " ") * 3),
    ]
    items = [
        (10, ITEM), (9, ITEM + " pi"), (10, ITEM), (11, "short words"), (12, ""), (13, None), (None, "größe"),
        (14, "the " * 14), (15, "words that stand nowhere at all"),
    ]
    check(spark, documents, rows, items)


def test_edges(spark, documents):
    check(spark, documents, EDGES, [(1, "same text stands here")])
    check(spark, documents, EDGES[:4], [])
    check(spark, documents, [], [(1, "same text")])


def test_shuffle_joins_give_the_same(spark, documents, monkeypatch):
    monkeypatch.setattr(positions, "BROADCAST_ROWS", 0)
    check(spark, documents, EDGES, [(1, "same text stands here"), (2, "and fifty bytes")])


def test_phrase_and_proximity(spark):
    texts = ["a b c d", "a x b c d", "b a c d", "a b c", None, "d c b a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    phrases = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["nowhere", "a"])], "phrase long, window array<string>")
    terms = phrases.select(F.explode("window").alias("word")).distinct()
    keyed = positions.with_keys(phrases, positions.term_counts(docs, terms), None)
    index = positions.postings(docs, terms)

    def docs_of(slack):
        found = positions.matches(index, keyed, 4, slack).select("doc").distinct()
        return sorted(r.doc for r in found.collect())

    assert docs_of(0) == [0]
    assert docs_of(1) == [0, 1, 2]


def test_main_path_is_native(documents, spark):
    df = positions.op8_positional_decontamination(documents(EDGES), items_table(spark, [(1, "one")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_other_splits_between_scans(spark, documents, split_anew):
    rows = [(i, f"text {i} " + "filler " * (i * 7 % 50) + (ITEM if i % 3 == 0 else "")) for i in range(60)]
    docs = split_anew(documents(rows), positions, shared)
    got = positions.op8_positional_decontamination(docs, items_table(spark, [(10, ITEM)]))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, [(10, ITEM)])
