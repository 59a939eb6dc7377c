"""Held-out accuracy, and the forward sum against all segmentations."""

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np

from llm_cases import EDGES, PIECES, SF_DIR
from tallyhouse.llm import language


def all_ways(word, chance):
    @lru_cache(None)
    def total(at):
        if at == len(word):
            return 1.0
        out = language.STRANGE * total(at + 1)
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in chance:
                out += chance[word[at:end]] * total(end)
        return out

    return total(0)


def test_forward_sums_all_segmentations():
    strings = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "é"]
    p = np.random.RandomState(0).dirichlet(np.ones(len(strings)), 2).T
    words = ["a", "abab", "b", "abba", "ébab", "xyz", "ababababab"]
    got = language.word_scores(language.Pieces(strings), p, words)
    for j in range(2):
        chance = dict(zip(strings, p[:, j]))
        want = [np.log10(all_ways("▁" + w, chance)) for w in words]
        assert np.allclose(got[:, j], want)


def test_long_pieces_and_long_words():
    """Pieces of over 8 symbols, words of over 32, windows that pieces cross."""
    random = np.random.RandomState(1)
    text = "".join(random.choice(list("ab"), 150))
    strings = sorted({"▁", "a", "b", "▁" + text[:11], *(text[i : i + k] for i in range(0, 120, 3) for k in (2, 9, 16))})
    p = random.dirichlet(np.ones(len(strings)), 2).T
    words = [text[:n] for n in (5, 20, 31, 32, 33, 64, 65, 150)] + ["c" * 40, "é" + text[:60]]
    got = language.word_scores(language.Pieces(strings), p, words)
    for j in range(2):
        chance = dict(zip(strings, p[:, j]))
        want = [np.log10(all_ways("▁" + w, chance)) for w in words]
        assert np.allclose(got[:, j], want)


def test_every_letter_piece_of_the_vocabulary_counts():
    lengths = Counter(map(len, language.letter_pieces(PIECES)))
    assert max(lengths) == 16 and sum(n for k, n in lengths.items() if k > 8) == 2804


def test_expected_counts_add_up():
    """Each round's expected letters equal the letters of the words."""
    strings = ["▁", "a", "b", "ab", "▁a"]
    expected = language.learn({"ab": 3, "b": 1}, strings)
    letters = sum(n * len(s) for n, s in zip(expected, strings))
    assert abs(letters - (3 * 3 + 2)) < 1e-3


def test_held_out_accuracy(spark, given):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = {r.doc_id: r for r in language.op10_marginalised_unigrams(docs, PIECES).collect()}
    assert len(got) == len(given)
    held = [(i, lang) for i, _, lang in given if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, _ in held} == {i for i, r in got.items() if r.held_out}
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)


def test_long_words_do_not_vanish():
    scores = language.word_scores(language.Pieces(["▁", "a"]), np.array([[0.5], [0.5]]), ["a" * 5000, "日" * 5000])
    assert np.isfinite(scores).all()


def test_edges(documents):
    got = language.op10_marginalised_unigrams(documents(EDGES), PIECES).collect()
    assert len(got) == len(EDGES)
    for r in got:
        assert 0 <= r.score <= 1
        assert r.lang_pred == ("und" if r.doc_id in (1, 2, 4, 7) else r.lang_pred)
    assert {r.lang_pred for r in got} == {"und", "en"}
    assert language.op10_marginalised_unigrams(documents([]), PIECES).collect() == []


def test_nothing_learned(documents):
    from pyspark.sql import functions as F

    docs = documents([(1, "some text"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    got = language.op10_marginalised_unigrams(docs, PIECES).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
