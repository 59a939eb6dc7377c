"""Ids, digests and decoding equal the tokenizers library."""

import hashlib

import pyarrow as pa
import pytest
from hypothesis import given as forall, settings, strategies as st
from tokenizers import Tokenizer

from llm_cases import EDGES, WORD_BPE
from tallyhouse.llm import bpe, packed

LIBRARY, OWN = Tokenizer.from_file(WORD_BPE), bpe.encoder(WORD_BPE)
ODD = [
    "İstanbul ΣΑΣ", "é ́x", "<|endoftext|>", "foo<|endoftext|>bar <|STARTOFTEXT|>", "it's 'S we'll",
    "日本語テキスト", "😀😀😀 hi😀", "a\x1cb\x85c d", "\x00\x01", "x" * 500, "ab" * 300, "ǅ ß ẞ ﬁ", "\tx\r\ny  z",
]


def expected(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    digest = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), decoded)]
    return ids, decoded, (len(ids), *digest)


def check(text):
    ids, decoded, digest = expected(text)
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == decoded
    assert OWN.digest(text) == digest


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    check(text)


@settings(max_examples=200, deadline=None)
@forall(st.text(max_size=60))
def test_any_text(text):
    check(text)


def test_cuts_lie_inside_no_token():
    """No token of the vocabulary crosses a forced boundary, so fragments never merge."""
    fragments = OWN.fragments_of(OWN.symbols("ab!!cdÃ©12", True))
    assert sum(map(len, fragments)) == len("ab!!cdÃ©12")
    for a, b in zip(fragments, fragments[1:]):
        assert (a[-1], b[0]) not in OWN.inside


def test_edges(documents):
    got = bpe.op6_forced_boundary_bpe(documents(EDGES), WORD_BPE).collect()
    want = [(i, *expected(t or "")[2]) for i, t in EDGES]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.op6_forced_boundary_bpe(documents([]), WORD_BPE).collect() == []


def test_encoded_rows(documents):
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.encoded(documents([(1, "Hi there"), (2, None)]), WORD_BPE).collect()}
    assert got == {1: expected("Hi there")[:2], 2: ([], "")}


def test_words_are_encoded_once_and_forgotten_in_turn(monkeypatch):
    """Both encoders: a kept word is not encoded again, and what was forgotten gets the same ids anew."""
    texts = [f"word{i % 7} größe{i % 11}, Ünd{i % 5}!\tit's\r{i % 3}... <|endoftext|>." for i in range(60)] + ["", " \n", None]
    for kind in (bpe.Encoder, packed.WordIds):
        few, many = kind(WORD_BPE, 4), kind(WORD_BPE)
        asked = []
        own = many._encoded
        monkeypatch.setattr(many, "_encoded", lambda words: (asked.extend(words), own(words))[1])
        for _ in range(2):
            for some in (texts, texts[5:9], texts[::-1]):
                want = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in some]
                for e in (few, many):
                    ids, begins = e.flat(pa.array(some, pa.string()))
                    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == want
        assert len(asked) == len(set(asked))
        few.flat(pa.array(["a"]))
        assert len(few.kept) <= 4 < len(many.kept)


def test_neighbouring_batches_are_joined():
    batches = [pa.record_batch({"doc_id": [i], "text": ["x" * 100]}) for i in range(10)]
    got = list(packed.joined(iter(batches), 4 * batches[0].nbytes))
    assert [b.num_rows for b in got] == [4, 4, 2]
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches(batches).combine_chunks())
    assert list(packed.joined(iter([]))) == []
