"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q, at least max(6, 4 q) long, that no neighbouring word
extends. Periods up to ``SHORT`` are found by comparing the words with themselves q places on (direct
lag scans). Longer ones are found scale by scale: scale K stands for periods K/2 < q <= K. Every place
gets a hash of its K words (two hashes of half the length make one), and of every K/2 neighbouring places
the one with the least hash is a minimizer. Inside a run all windows return after q words, and so
do their minima; as q <= K, equal strings of K words in it are never nearer than q. So each minimizer
and the next one with the same hash give a pair at distance q. The pairs are compared word by word, those of one
run are joined, and each stretch is extended word by word to both sides.

Strings that differ are taken for equal nowhere. A run could stay unseen only if two different strings of
one document within K words of each other had the same 64-bit hash.

Documents are independent, so copies and hot sources change nothing, and nothing is shuffled. Words are handled
as numbers: beside a text, about 40 bytes a word are held.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.llm.packed import slices
from tallyhouse.llm.shared import release, small_batches

#: Periods up to this are found by direct lag scans; a power of two.
SHORT = 8
#: Bytes of text that are searched together and that are split at once, places looked at at once.
TOGETHER, SLICE, BLOCK = 1 << 21, 1 << 22, 1 << 20

SPACE = re.compile(rb"[\x20\x09-\x0D]")
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def least_length(period: int) -> int:
    return max(6, 4 * period)


class Words:
    """Numbers for words, in order of first use."""

    def __init__(self) -> None:
        self.names: list[bytes] = []
        self.number: dict[bytes, int] = {}

    def numbers(self, text: bytes) -> np.ndarray:
        """The words ``[^\\x20\\x09-\\x0D]+`` of a text as numbers, split slice by slice."""
        parts, start = [], 0
        while start < len(text):
            end = min(start + SLICE, len(text))
            if end < len(text):
                space = SPACE.search(text, end)
                end = space.start() if space else len(text)
            words = text[start:end].split()
            for w in set(words).difference(self.number):
                self.number[w] = len(self.names)
                self.names.append(w)
            parts.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
            start = end
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def text(self, numbers: np.ndarray) -> bytes:
        return b" ".join(map(self.names.__getitem__, numbers.tolist()))


def mixed(v: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit numbers, different for different ones."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """The places, ascending, that have the least hash (the leftmost of equal ones) of some ``window``
    (a power of two) neighbouring places."""
    n, size, found = len(hashes) - window + 1, max(BLOCK, window), []
    for first in range(0, n, size):
        least = hashes[first : min(first + size, n) + window - 1]
        place = np.arange(first, first + len(least))
        step = 1
        while step < window:
            later = least[step:] < least[:-step]
            least = np.where(later, least[step:], least[:-step])
            place = np.where(later, place[step:], place[:-step])
            step *= 2
        found.append(place[np.flatnonzero(np.diff(place, prepend=-1))])  # minima never move back
    places = np.concatenate(found) if found else np.empty(0, np.int64)
    return places[np.flatnonzero(np.diff(places, prepend=-1))]


def same_words(x: np.ndarray, p: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Whether the ``n`` words from ``p`` return ``d`` places on."""
    same = np.ones(len(p), bool)
    rows = max(1, BLOCK // n)
    for i in range(0, len(p), rows):
        at = p[i : i + rows, None] + np.arange(n)
        same[i : i + rows] = (x[at] == x[at + d[i : i + rows, None]]).all(1)
    return same


def reach(x: np.ndarray, at: np.ndarray, d: np.ndarray, way: int) -> np.ndarray:
    """How many words from ``at`` on, to the right (``way`` 1) or left (-1), equal the word ``d`` places on."""
    total, open_, step = np.zeros(len(at), np.int64), np.arange(len(at)), 16
    while len(open_):
        still = []
        rows = max(1, BLOCK // step)
        for i in range(0, len(open_), rows):
            o = open_[i : i + rows]
            here = (at[o] + way * total[o])[:, None] + way * np.arange(step)
            other = here + d[o, None]
            # Past an end the separator there has stopped the comparison already.
            differ = x[np.clip(here, 0, len(x) - 1)] != x[np.clip(other, 0, len(x) - 1)]
            stops = differ.any(1)
            total[o] += np.where(stops, differ.argmax(1), step)
            still.append(o[~stops])
        open_ = np.concatenate(still)
        step = min(step * 2, 4096)
    return total


def chained(p: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (first, end, d) in which each word equals the one ``d`` on, from pairs that do so for ``n``
    words from ``p``; pairs of one ``d`` that touch are one stretch."""
    order = np.lexsort((p, d))
    p, d = p[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 0) | (np.diff(p) > n)]))
    last = np.concatenate([first[1:], [len(p)]]) - 1
    return p[first], p[last] + n, d[first]


def find_runs(x: np.ndarray, ends: Callable[[int], int]) -> np.ndarray:
    """(start, length, period) of all runs in ``x``, by start and period.

    ``x`` holds the numbers of the words; a separator (a negative number, all different) stands before,
    between and after documents, the longest document first. ``ends(n)`` is the length of the
    part of ``x`` that documents of at least ``n`` words take.
    """
    found = []

    def add(first: np.ndarray, end: np.ndarray, d: np.ndarray) -> None:
        length = end - first + d
        long = length >= np.maximum(6, 4 * d)
        found.append(np.stack([first[long], length[long], d[long]], 1))

    for q in range(1, SHORT + 1):
        part = x[: ends(least_length(q))]
        equal = np.flatnonzero(part[q:] == part[:-q]) if len(part) > q else np.empty(0, np.int64)
        if len(equal):
            begin = np.flatnonzero(np.diff(equal, prepend=-2) != 1)
            last = np.concatenate([begin[1:], [len(equal)]]) - 1
            add(equal[begin], equal[last] + 1, np.full(len(begin), q))
    hashes, scale = mixed(x.view(np.uint64)), 1
    while True:
        part = x[: ends(least_length(scale // 2 + 1))]
        if len(part) <= scale or not len(part):
            break
        hashes = hashes[: len(part) - max(scale // 2 - 1, 0)]
        if scale > 1:
            half = scale // 2
            hashes = mixed(hashes[:-half] * np.uint64(0x9E3779B97F4A7C15) + hashes[half:])
        if scale > SHORT:
            s = minimizers(hashes, scale // 2)
            order = np.argsort(hashes[s], kind="stable")
            s, h = s[order], hashes[s[order]]
            d = np.diff(s)
            pairs = (h[1:] == h[:-1]) & (d > scale // 2) & (d <= scale)
            p, d = s[:-1][pairs], d[pairs]
            same = same_words(part, p, d, scale)
            if same.any():
                first, end, d = chained(p[same], d[same], scale)
                add(first - reach(part, first - 1, d, -1), end + reach(part, end, d, 1), d)
        scale *= 2
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    # The same stretch with a multiple of its period: the smallest counts.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(documents: list[np.ndarray]) -> list[np.ndarray]:
    """The runs of each document, (start, length, period) with start counted from its first word."""
    sizes = np.array([len(d) for d in documents], np.int64)
    order = np.argsort(-sizes, kind="stable")
    separator = count(-1, -1)
    parts = [np.array([next(separator)], np.int64)]
    for i in order:
        parts += [documents[i], np.array([next(separator)], np.int64)]
    x = np.concatenate(parts)
    starts = np.concatenate([[0], np.cumsum(sizes[order] + 1)]) + 1

    def ends(n: int) -> int:
        return int(starts[np.searchsorted(-sizes[order], -n, "right")])

    runs = find_runs(x, ends)
    bounds = np.searchsorted(runs[:, 0], starts)
    out: list[np.ndarray] = [runs[:0]] * len(documents)
    for k, i in enumerate(order):
        if bounds[k] < bounds[k + 1]:
            out[i] = runs[bounds[k] : bounds[k + 1]] - [starts[k], 0, 0]
    return out


def collapse(numbers: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """``numbers`` without the words that a run holds after its first period."""
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return numbers[np.cumsum(change[:-1]) == 0]


Places = Callable[[int, int], "np.ndarray | None"]


def detect(docs: DataFrame, places: Places | None = None) -> DataFrame:
    """``RUNS`` of ``docs`` (doc_id, text, ...), a row a row: number of words, runs by start and period, and
    the text with each run cut to its first period, words joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null, empty or blank text has no word, no run and collapses to
    the empty text. ``places(doc_id, n)`` may give the places of the words to take instead of all ``n``
    in order. Whole texts are searched, of any length; ties, repeated rows and null doc_ids change
    nothing, and other columns are not read.
    """

    def found(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        words, documents = Words(), []
        for doc_id, text in zip(ids, texts):
            numbers = words.numbers(text)
            order = places(doc_id, len(numbers)) if places else None
            documents.append(numbers if order is None else numbers[order])
        runs = runs_of(documents)
        kept = [collapse(d, r) if len(r) else d for d, r in zip(documents, runs)]
        flat = np.concatenate(runs)
        structs = pa.StructArray.from_arrays(
            [pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]
        )
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(d) for d in documents], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), structs),
                pa.array([words.text(k) for k in kept], pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "n_words", "runs", "collapsed"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, TOGETHER):
            yield found(part.column(0).to_pylist(), [t or b"" for t in part.column(1).to_pylist()])
        release()

    small_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    ).mapInArrow(rows, RUNS)


def strongest(runs: Column) -> Column:
    """Of ``runs`` the one with the largest length / period, compared exactly; ties to the smallest start,
    then period. NULL without runs."""

    def better(a: Column, b: Column) -> Column:
        left, right = a.length * b.period, b.length * a.period
        return (
            F.when(left != right, left > right)
            .when(a.start != b.start, a.start < b.start)
            .otherwise(a.period < b.period)
        )

    return F.aggregate(
        runs, F.get(runs, 0), lambda best, run: F.when(better(run, best), run).otherwise(best)
    )


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The places of a document with a repeated stretch: of every tenth doc_id by crc32, the words from
    a on repeat the first p of them. A null doc_id is left as it is."""
    if doc_id is None or not n:
        return None
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def op13_minimizer_runs(docs: DataFrame) -> DataFrame:
    """All ``documents`` with the stretches that the contract plants: a row a row."""
    top = F.col("top")
    line = F.transform(
        "runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))
    )
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return (
        detect(docs, planted)
        .withColumn("top", strongest(F.col("runs")))
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            top.start.alias("start"),
            top.length.alias("length"),
            top.period.alias("period"),
            F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
            F.sha2(listed, 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )
