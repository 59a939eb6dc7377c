"""Fingerprints and groups against brute force over all pairs."""

import re

import numpy as np
import xxhash

from llm_cases import EDGES, SF_DIR
from tallyhouse.llm import components, simhash


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, prints):
    fps = np.array(prints, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    least = {}
    for (doc_id, _), c in zip(rows, label):
        if doc_id is not None and (c not in least or doc_id < least[c]):
            least[c] = doc_id
    return [(d, f"{p:016x}", least.get(c)) for (d, _), p, c in zip(rows, prints, label)]


def check(docs, rows):
    got = [tuple(r) for r in simhash.op3_simhash_pivot_tables(docs).collect()]
    want = plain_groups(rows, [plain_fingerprint(t) for _, t in rows])
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_given_documents(spark, given):
    check(spark.read.parquet(f"{SF_DIR}/documents.parquet"), [(i, t) for i, t, _ in given])


def test_edges(documents):
    check(documents(EDGES), EDGES)
    assert simhash.op3_simhash_pivot_tables(documents([])).collect() == []


def test_one_row_of_a_group_is_kept(documents):
    kept = simhash.near_groups(documents(EDGES)).where("kept").collect()
    assert len({r.component_id for r in kept}) == len(kept)


def test_no_pair_is_lost_in_split_buckets(spark, monkeypatch):
    """A dense cloud of fingerprints, dealt out in many small chunks."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    random = np.random.RandomState(1)
    centre = random.randint(0, 1 << 62)
    fps = {centre ^ sum(1 << int(b) for b in random.choice(64, 6, replace=False)) for _ in range(150)}
    fps |= {int(x) for x in random.randint(0, 1 << 62, 150)}
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = components.components(simhash.near_edges(nodes, 3)).collect()
    roots = {r.node: r.root for r in found}
    u = np.array(signed, np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    label = np.arange(len(u))
    for _ in range(len(u)):
        label = np.array([label[n].min() for n in near])
    own = [roots.get(f, f) for f in signed]
    assert len(set(zip(own, label))) == len(set(own)) == len(set(label.tolist()))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (202, 201)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r.node: r.root for r in got}
    assert all(roots[i] == 0 for i in range(61)) and {roots[i] for i in (200, 201, 202)} == {200}
