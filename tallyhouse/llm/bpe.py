"""BPE encoding with forced boundaries, and decoding, equal to the tokenizers library.

No merge can join two neighbouring symbols that never stand side by side inside a token of
the vocabulary, so such a place is a certain cut. Each pre-token is cut at all of them; the fragments are
merged on their own (and remembered), and their ids are concatenated. Normalisation and
pre-tokens come from the tokenizer file through the library; merging is done here.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tallyhouse.llm.packed import TEXT_BYTES, TOGETHER, Words, joined, slices
from tallyhouse.llm.shared import Memory, release, small_batches

ID_BITS, NONE = 20, 1 << 60
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Encoder(Words):
    """Encodes and decodes by a BPE tokenizer file with word ends (``end_of_word_suffix``).

    ``most`` bounds the kept words, pre-tokens and fragments, each on its own. Few words without their marks
    are remembered, as their pre-tokens are.
    """

    def __init__(self, path: str, most: int = 400_000):
        super().__init__(most)
        self.known = Memory(most // 8)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        self.pre_tokens = library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        # Pairs and merges as numbers: (left id, right id) to (rank, id of the two).
        self.merges: dict[int, int] = {}
        for rank, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            pair = self.vocab[left] << ID_BITS | self.vocab[right]
            self.merges[pair] = rank << ID_BITS | self.vocab[left + right]
        self.inside = set()
        for t in self.vocab:
            symbols = self.symbols(t.removesuffix(self.end), t.endswith(self.end))
            self.inside.update(zip(symbols, symbols[1:]))
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.pre, self.fragments = Memory(most), Memory(most)
        self.split_ascii = self._ascii_splitter(spec)
        self.probe(self.encode)
        every = [self.token.get(i, "") for i in range(max(self.token) + 1)]
        self.as_text = pa.array(map(str, range(len(every))), pa.large_string())
        self.as_token = pa.array(every, pa.large_string())

    def _ascii_splitter(self, spec: dict):
        """The file's own pattern as a function for printable ASCII words, if splitting by it is all that the
        library does to them besides lower-casing (a probe tells); else None."""
        try:
            pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        except (KeyError, IndexError, TypeError, regex.error):
            return None
        probe = " ".join(f"a{chr(i)}Bc{chr(i)}{chr(i)}1{chr(i)}'s" for i in range(33, 127))
        found = [p for p, _ in self.pre_tokens(self.normalise(probe))]
        return pattern.findall if pattern.findall(probe.lower()) == found else None

    def symbols(self, text: str, ends: bool) -> list[str]:
        out = list(text)
        if ends and out:
            out[-1] += self.end
        return out

    def fragments_of(self, symbols: list[str]) -> list[tuple[str, ...]]:
        """``symbols`` cut wherever the pair occurs inside no token."""
        if self.inside.issuperset(zip(symbols, symbols[1:])):
            return [tuple(symbols)]
        out, first = [], 0
        for i in range(1, len(symbols)):
            if (symbols[i - 1], symbols[i]) not in self.inside:
                out.append(tuple(symbols[first:i]))
                first = i
        out.append(tuple(symbols[first:]))
        return out

    def merge(self, fragment: tuple[str, ...]) -> bytes:
        """Ids, as bytes, of one fragment: the lowest merge first, the leftmost of equals."""
        parts, merged = [self.vocab.get(s, -1) for s in fragment], self.merges.get
        ranks = [merged(a << ID_BITS | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            parts[i] = new = best & (1 << ID_BITS) - 1
            del parts[i + 1], ranks[i]
            if i > 0:
                ranks[i - 1] = merged(parts[i - 1] << ID_BITS | new, NONE)
            if i < len(ranks):
                ranks[i] = merged(new << ID_BITS | parts[i + 1], NONE)
        ids = [p for p in parts if p >= 0]
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, text: str) -> bytes:
        """Ids, as bytes, of a text without special tokens."""
        if self.split_ascii and text.isascii() and text.isprintable() and " " not in text:
            parts = self.split_ascii(text.lower())
        else:
            parts = [p for p, _ in self.pre_tokens(self.normalise(text))]
        return b"".join(map(self.pre_token, parts))

    def pre_token(self, pre: str) -> bytes:
        got = self.pre.get(pre)
        if got is None:
            got = self._merged(pre)
            self.pre.put(pre, got)
        return got

    def _merged(self, pre: str) -> bytes:
        fragments = self.fragments_of(self.symbols(pre, True))
        if len(fragments) == 1:
            return self.merge(fragments[0])
        ids = []
        for fragment in fragments:
            got = self.fragments.get(fragment)
            if got is None:
                got = self.merge(fragment)
                self.fragments.put(fragment, got)
            ids.append(got)
        return b"".join(ids)

    def _bytes_of(self, text: str) -> bytes:
        return b"".join(
            struct.pack("<I", self.special[part]) if part in self.special else self.piece(part)
            for part in self.specials.split(text)
        )

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self._bytes_of(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids)

    def _encoded(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words of letters go through the normaliser and the pre-tokenizer many in a call, if the places of the
        pre-tokens show that each is one."""
        ascii_too = self.split_ascii is not None
        letters, alone = [], []
        for w in words:
            if not w.isalpha():
                alone.append(w)
            elif ascii_too and w.isascii():
                yield w, self.pre_token(w.lower())
            else:
                letters.append(w)
        for i in range(0, len(letters), TOGETHER):
            some = letters[i : i + TOGETHER]
            normal = self.normalise(" ".join(some))
            found = self.pre_tokens(normal)
            ends = list(accumulate(len(w) + 1 for w in normal.split(" ")))
            spans = [(a, b - 1) for a, b in zip([0, *ends], ends)]
            if len(spans) == len(some) and spans == [span for _, span in found]:
                for w, (pre, _) in zip(some, found):
                    yield w, self.pre_token(pre)
            else:
                alone += some
        for w in alone:
            yield w, self._bytes_of(w)

    def digests(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """Of each text the number of ids and the SHA-256 of the ids as text and of the decoded text."""
        ids, begins = self.flat(texts)
        shas = []
        for words in (self.as_text, self.as_token):
            lists = pa.ListArray.from_arrays(begins.astype(np.int32), words.take(pa.array(ids)))
            joined = pc.binary_join(lists, pa.scalar(" ", words.type))
            shas.append([hashlib.sha256(t.as_buffer()).hexdigest() for t in joined.cast(pa.large_binary())])
        return np.diff(begins).tolist(), *shas

    def digest(self, text: str) -> tuple[int, str, str]:
        n, ids, decoded = self.digests(pa.array([text], pa.string()))
        return n[0], ids[0], decoded[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) of ``docs``: the encoder's own output, a row a document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in slices(batches, 1):
            ids = [e.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([e.decode(i) for i in ids], pa.string()),
                ],
                ["doc_id", "ids", "decoded"],
            )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(
        rows, "doc_id long, ids array<int>, decoded string"
    )


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``DIGEST`` of ``docs`` (doc_id, text), a row a row. A null text is an empty one: no id, and the
    SHA-256 of nothing. Rows are independent, so ties and repeated rows change nothing."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in slices(joined(batches, 2 * TEXT_BYTES), 1, 2 * TEXT_BYTES):
            n, ids, decoded = e.digests(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(ids, pa.string()),
                    pa.array(decoded, pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        release()

    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(rows, DIGEST)


def op6_forced_boundary_bpe(docs: DataFrame, tokenizer: str) -> DataFrame:
    return digests(docs, tokenizer)
