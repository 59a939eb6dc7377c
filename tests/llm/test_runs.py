"""Runs against a comparison of every text with itself at every distance."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from llm_cases import EDGES, SF_DIR
from tallyhouse.llm import runs


def plain_runs(words):
    n, numbers, found = len(words), {}, {}
    x = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    for q in range(1, n // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], x[q:] == x[:-q], [0]])))
        for first, end in edges.reshape(-1, 2).tolist():
            if end - first + q >= max(6, 4 * q):
                found.setdefault((first, end - first + q), q)
    return sorted(((s, n_, q) for (s, n_), q in found.items()), key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    facts = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    shas = [hashlib.sha256(t.encode()).hexdigest() for t in (listed, kept)]
    return (doc_id, len(found), *facts, *shas)


def check(docs, rows):
    got = [tuple(r) for r in runs.op13_minimizer_runs(docs).collect()]
    assert Counter(got) == Counter(plain(*r) for r in rows)
    return got


def test_given_documents(spark, given):
    got = check(spark.read.parquet(f"{SF_DIR}/documents.parquet"), [(i, t) for i, t, _ in given])
    assert max(r[4] or 0 for r in got) > 4 * runs.SHORT


def test_edges(documents):
    repeated = [(100, "la " * 4000 + "end"), (101, "a b " * 3), (102, " ".join("xyxxyxyxxyxxyx" * 9))]
    check(documents(EDGES + repeated), EDGES + repeated)
    assert runs.op13_minimizer_runs(documents([])).collect() == []


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_random_runs_of_many_periods(monkeypatch, block):
    """Small alphabets and planted stretches, searched together and in small blocks."""
    monkeypatch.setattr(runs, "BLOCK", block)
    random, documents = np.random.RandomState(3), []
    for _ in range(300):
        n = random.randint(0, 300)
        x = random.randint(0, random.choice([1, 2, 3, 40]), n)
        for _ in range(random.randint(0, 3) if n > 12 else 0):
            a, p = random.randint(0, n - 5), random.randint(1, n // 4 + 1)
            e = random.randint(a, n + 1)
            x[a:e] = x[a + np.arange(e - a) % p]
        documents.append(x.astype(np.int64))
    found = runs.runs_of(documents)
    assert [list(map(tuple, f.tolist())) for f in found] == [plain_runs(d.tolist()) for d in documents]
    assert max(int(f[:, 2].max()) for f in found if len(f)) > 16


def test_one_long_run_of_a_long_period():
    x = np.tile(np.random.RandomState(5).permutation(3000), 5)[: 3000 * 4 + 17].astype(np.int64)
    assert runs.runs_of([np.arange(50), x])[1].tolist() == [[0, 12017, 3000]]


def test_words_do_not_depend_on_slices(monkeypatch):
    monkeypatch.setattr(runs, "SLICE", 5)
    words, text = runs.Words(), "ab\tcde  fghijklmn\x0b\x0c o\x1fp   ab".encode()
    assert words.text(words.numbers(text)) == b" ".join(re.split(rb"[\x20\x09-\x0D]+", text))
