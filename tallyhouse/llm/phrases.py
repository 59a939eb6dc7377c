"""Phrase collocations by SETM: sorted occurrence relations, merge-joined, counted, semi-joined, extended.

A relation R(k) holds the places where a phrase of k words starts. Texts are dealt into blocks (runs of
documents of one language, at most ``PLACES`` words); in a block a place is one number for piece and position,
with a gap where a piece ends, so "same piece, next position" is "place + 1". The relations of a block
are one stored row, sorted by place. Level by level:

* merge-join: R(k-1) meets the words of R(1) at place + k - 1, in one task a block;
* group-count: each block sends every phrase it has once, with its count, dealt by a hash of the phrase;
  one task a deal adds the counts and numbers the phrases with at least ``least`` occurrences;
* semi-join: the same task answers each block with those of its phrases, and only their occurrences go
  on to the next length.

A phrase is known by the number of its first k - 1 words and that of its last one, so counts are exact. Deals
have about ``DEAL`` phrases however frequent a phrase is: a block sends it once. Every relation is
a table on shared storage; no task holds more than a few blocks or a deal, and nothing is collected.
A text longer than a block is cut with three words of overlap, so no phrase is lost.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.llm.runs import mixed
from tallyhouse.llm.shared import UPPER, release, small_batches, staged

LONGEST = 4
SHARES = 32
#: Places of a block, places held by a task before it writes its blocks, bytes of text split at once, places a
#: deal of phrases stands for. A block sends a phrase once, so few large blocks send less than many small ones.
PLACES, HELD, SLICE, DEAL = 1 << 20, 1 << 22, 1 << 20, 1 << 20

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BREAK = b"."
TABLE = bytes.maketrans(
    UPPER.encode() + BREAKS + b"\t", UPPER.lower().encode() + BREAK * len(BREAKS) + b" "
)
CUT = re.compile(rb"[\x20\x09-\x0D.,;:!?]")

SENT = pa.struct(
    [
        ("deal", pa.int32()),
        ("least", pa.int32()),
        ("n", pa.binary()),
        ("word", pa.list_(pa.binary())),
        ("first", pa.binary()),
        ("last", pa.binary()),
    ]
)
SENT_DDL = "array<struct<deal:int, least:int, n:binary, word:array<binary>, first:binary, last:binary>>"
BLOCKS = f"lang string, own int, n_words long, words binary, sent {SENT_DDL}"
RELATION = pa.schema(
    [
        ("block", pa.int64()),
        ("lang", pa.string()),
        ("own", pa.int32()),
        ("place", pa.binary()),
        ("word", pa.binary()),
        ("ids", pa.binary()),
        ("start", pa.binary()),
        ("phrase", pa.binary()),
        ("sent", pa.list_(SENT)),
    ]
)
RELATION_DDL = (
    "block long, lang string, own int, place binary, word binary, ids binary, start binary,"
    f" phrase binary, sent {SENT_DDL}"
)
ANSWER = pa.schema(
    [
        ("of", pa.int64()),
        ("idx", pa.list_(pa.int32())),
        ("gid", pa.list_(pa.int64())),
        ("n", pa.list_(pa.int64())),
        ("lang", pa.list_(pa.string())),
        ("word", pa.list_(pa.binary())),
        ("first", pa.list_(pa.int64())),
        ("last", pa.list_(pa.int64())),
    ]
)
ANSWER_DDL = (
    "of long, idx array<int>, gid array<long>, n array<long>, lang array<string>, word array<binary>,"
    " first array<long>, last array<long>"
)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, ``BREAK`` where a piece ends, slice by slice."""
    start = 0
    while start < len(text):
        end = min(start + SLICE, len(text))
        if end < len(text):
            found = CUT.search(text, end)
            end = found.start() if found else len(text)
        # After the table only spaces are white space that can stand in a text.
        yield text[start:end].translate(TABLE).replace(BREAK, b" . ").split(b" ")
        start = end


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on: their lowest bytes, then their next ones, up to the highest that is used.
    Small numbers so take few bytes, and equal bytes stand together for the shuffle's compression."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    raw = np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8)
    return bytes([width]) + raw[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    raw = np.zeros((planes.shape[1], 8), np.uint8)
    raw[:, : len(planes)] = planes.T
    return raw.view(np.int64).ravel()


def marked(places: np.ndarray) -> bytes:
    """Ascending distinct places as a bit each."""
    flags = np.zeros(int(places.max(initial=0)) + 1, bool)
    flags[places] = True
    return np.packbits(flags).tobytes() if len(places) else b""


def unmarked(data: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


def dealt(deal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the phrases of a block by deal, the deals it has, where each begins in that order)."""
    order = np.argsort(deal, kind="stable")
    deals, begins = np.unique(deal[order], return_index=True)
    return order, deals, np.append(begins, len(deal))


class Block:
    """The words of one language that a task has read and not yet written."""

    def __init__(self, lang: str, n_deals: int):
        self.lang, self.n_deals = lang, n_deals
        self.salt = zlib.crc32(lang.encode())
        self.clear()

    def clear(self) -> None:
        self.names: list[bytes] = []
        self.number: dict[bytes, int] = {BREAK: -1, b"": -2}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        for w in set(words).difference(self.number):
            self.number[w] = len(self.names)
            self.names.append(w)
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        numbers = numbers[numbers > -2]
        self.parts.append(numbers)
        self.size += len(numbers)

    def row(self, inside: bool) -> dict:
        """The block as a row, and an empty block; ``inside`` a text the last places start the next one."""
        words = np.concatenate([np.empty(0, np.int32), *self.parts])
        own = max(len(words) - (LONGEST - 1), 0) if inside else len(words)
        names, salt = self.names, self.salt
        rest = [BREAK if w < 0 else names[w] for w in words[own:].tolist()]
        counts = np.bincount(words[:own][words[:own] >= 0], minlength=len(names))
        deal = np.array([zlib.crc32(w, salt) for w in names], np.int64) % self.n_deals
        order, deals, begins = dealt(deal)
        renumbered = np.zeros(len(names) + 1, np.int64)
        renumbered[order] = np.arange(1, len(names) + 1)
        names = [names[i] for i in order.tolist()]
        counts = counts[order]
        self.clear()
        self.add(rest)
        return {
            "lang": self.lang,
            "own": own,
            "n_words": int(counts.sum()),
            "words": packed(renumbered[words]),
            "sent": [
                {"deal": d, "least": b, "n": packed(counts[b:e]), "word": names[b:e], "first": None, "last": None}
                for d, b, e in zip(deals.tolist(), begins.tolist(), begins[1:].tolist())
            ],
        }


def blocks(docs: DataFrame, n_deals: int) -> DataFrame:
    """R(1) of ``docs`` (lang, text), stored: one row a block with its words in order as numbers of the
    block's own vocabulary (from 1; 0 where a piece ends), and what it sends to each deal."""

    def batch_of(block: Block, inside: bool) -> pa.RecordBatch:
        r = block.row(inside)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r["lang"]], pa.string()),
                pa.array([r["own"]], pa.int32()),
                pa.array([r["n_words"]], pa.int64()),
                pa.array([r["words"]], pa.binary()),
                pa.array([r["sent"]], pa.list_(SENT)),
            ],
            ["lang", "own", "n_words", "words", "sent"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Block] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in held:
                    held[lang] = Block(lang, n_deals)
                block = held[lang]
                for words in tokens(text.as_py() or b""):
                    size -= block.size
                    # A slice is read in parts, so that a block is no larger than ``PLACES``.
                    for i in range(0, len(words), PLACES):
                        block.add(words[i : i + PLACES])
                        if block.size >= PLACES:
                            yield batch_of(block, inside=True)
                    size += block.size
                block.add([BREAK])
                size += 1
                if size >= HELD:
                    for b in held.values():
                        yield batch_of(b, inside=False)
                    held, size = {}, 0
        for block in held.values():
            yield batch_of(block, inside=False)
        release()

    small_batches(docs.sparkSession)
    read = docs.select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")
    )
    return stored(read.mapInArrow(rows, BLOCKS).withColumn("block", F.monotonically_increasing_id()), "words")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``staged`` for rows of some megabytes: files are cut by size, not after a hundred rows at least."""
    return staged(df, f"occurrences-{name}", **{"parquet.block.size.row.check.min": "2"})


def flat(column: pa.ChunkedArray) -> pa.Array:
    """The values of a list column, its rows one after the other."""
    return column.combine_chunks().flatten()


def merge_join(start: np.ndarray, place: np.ndarray, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index in ``start``, index in ``place``), both ascending, with place = start + after."""
    at = np.searchsorted(place, start + after)
    hit = np.flatnonzero(place[np.minimum(at, len(place) - 1)] == start + after) if len(place) else at[:0]
    return hit, at[hit]


def frequent(number: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of ``number`` whose value is in ``kept`` (ascending), its position in ``kept``)."""
    position = np.full(int(max(number.max(initial=0), kept.max(initial=0))) + 1, -1, np.int64)
    position[kept] = np.arange(len(kept))
    found = position[number]
    at = np.flatnonzero(found >= 0)
    return at, found[at]


def extended(k: int, n_deals: int):
    """The task of one block at length ``k``: its relation of length k - 1, cut to the frequent phrases
    (idx in the block, gid in the corpus), is merge-joined with its words."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        result = extend(left, right)
        release()
        return result

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        kept, gids = flat(right["idx"]).to_numpy(), flat(right["gid"]).to_numpy()
        if not left.num_rows or not len(kept):
            return RELATION.empty_table()
        order = np.argsort(kept)
        kept, gids = kept[order], gids[order]
        block = left.to_pylist()[0]
        own = block["own"]
        if k == 2:
            place, word = frequent(unpacked(block["words"]), kept + 1)
            ids = gids
            mine = np.searchsorted(place, own)
            start, phrase = place[:mine], word[:mine]
        else:
            place, word, ids = unmarked(block["place"]), unpacked(block["word"]), unpacked(block["ids"])
            at, phrase = frequent(unpacked(block["phrase"]), kept)
            start = unmarked(block["start"])[at]
        hit, at = merge_join(start, place, k - 1)
        start = start[hit]
        pairs, number, n = np.unique(
            phrase[hit] * len(ids) + word[at], return_inverse=True, return_counts=True
        )
        first, last = gids[pairs // len(ids)], ids[pairs % len(ids)]
        hashed = mixed(mixed(first.view(np.uint64)) + last.view(np.uint64))
        order, deals, begins = dealt((hashed % np.uint64(n_deals)).astype(np.int64))
        renumbered = np.empty(len(pairs), np.int64)
        renumbered[order] = np.arange(len(pairs))
        first, last, n = first[order], last[order], n[order]
        # Words that a longer phrase can still need.
        needed = np.zeros(int(place.max(initial=0)) + 1 + LONGEST, bool)
        for more in range(k, LONGEST):
            needed[start + more] = True
        use = needed[place]
        row = {
            "block": block["block"],
            "lang": block["lang"],
            "own": own,
            "place": marked(place[use]),
            "word": packed(word[use]),
            "ids": packed(ids),
            "start": marked(start),
            "phrase": packed(renumbered[number]),
            "sent": [
                {
                    "deal": d,
                    "least": b,
                    "n": packed(n[b:e]),
                    "word": None,
                    "first": packed(first[b:e]),
                    "last": packed(last[b:e]),
                }
                for d, b, e in zip(deals.tolist(), begins.tolist(), begins[1:].tolist())
            ],
        }
        return pa.Table.from_pylist([row], RELATION)

    return task


def counted(k: int, n_deals: int, least: int):
    """The task of one deal: rows (block, lang, deal, least, n, word | first, last) give one answer a block
    (idx in the block and gid of its frequent phrases) and a row without block, the phrases themselves.
    A gid is the phrase's number in the deal times the deals, plus the deal."""

    def task(rows: pa.Table) -> pa.Table:
        result = count(rows)
        release()
        return result

    def count(rows: pa.Table) -> pa.Table:
        def numbers(name: str) -> np.ndarray:
            return np.concatenate([unpacked(v) for v in rows[name].to_pylist()])

        sizes = np.array([len(unpacked(v)) for v in rows["n"].to_pylist()])
        n = numbers("n")
        if k == 1:
            lang = rows["lang"].combine_chunks().dictionary_encode()
            word = flat(rows["word"]).dictionary_encode()
            keys = [np.repeat(lang.indices.to_numpy(), sizes), word.indices.to_numpy()]
        else:
            keys = [numbers("first"), numbers("last")]
        order = np.lexsort((keys[1], keys[0]))
        a, b = keys[0][order], keys[1][order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        begins = np.flatnonzero(new)
        total = np.add.reduceat(n[order], begins)
        kept = total >= least
        number = np.where(kept, np.cumsum(kept) - 1, -1)
        of_row = np.empty(len(n), np.int64)
        of_row[order] = number[np.cumsum(new) - 1]
        gid = np.arange(kept.sum()) * n_deals + rows["deal"][0].as_py()
        answers = []
        ends = np.cumsum(sizes)
        for block, base, begin, end in zip(
            rows["block"].to_pylist(), rows["least"].to_pylist(), (ends - sizes).tolist(), ends.tolist()
        ):
            idx = np.flatnonzero(of_row[begin:end] >= 0)
            if len(idx):
                answers.append({"of": block, "idx": idx + base, "gid": gid[of_row[begin:end][idx]]})
        if len(gid):
            a, b = a[begins][kept], b[begins][kept]
            whole = {"of": None, "gid": gid, "n": total[kept]}
            if k == 1:
                whole |= {"lang": lang.dictionary.take(a).to_pylist(), "word": word.dictionary.take(b).to_pylist()}
            else:
                whole |= {"first": a, "last": b}
            answers.append(whole)
        return pa.table(
            [pa.array([r.get(f.name) for r in answers], f.type) for f in ANSWER], schema=ANSWER
        )

    return task


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, n) of all phrases of 1 to ``LONGEST`` words with n >= ``least`` occurrences,
    (lang, total) words of each language). ``docs`` has (lang, text)."""
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_deals = 1 + text_bytes // (6 * DEAL)  # a word has about six bytes
    relation = blocks(docs, n_deals)
    totals = relation.groupBy("lang").agg(F.sum("n_words").alias("total"))
    taken, levels = ["block", "lang", "own", "words"], []
    for k in range(1, LONGEST + 1):
        if k > 1:
            task = relation.select(*taken).groupBy("block").cogroup(known.groupBy("of"))
            relation = stored(task.applyInArrow(extended(k, n_deals), RELATION_DDL), str(k))
            taken = ["block", "lang", "own", "place", "word", "ids", "start", "phrase"]
        sent = relation.select("block", "lang", F.explode("sent").alias("s")).select("block", "lang", "s.*")
        answers = sent.groupBy("deal").applyInArrow(counted(k, n_deals, least), ANSWER_DDL)
        answers = stored(answers, f"frequent-{k}")
        known = answers.where("of is not null").select("of", "idx", "gid")
        names = ["gid", "n", "lang", "word"] if k == 1 else ["gid", "n", "first", "last"]
        groups = answers.where("of is null").select(F.explode(F.arrays_zip(*names)).alias("g")).select("g.*")
        if k == 1:
            level = groups.select("gid", "lang", F.col("word").cast("string").alias("phrase"), "n")
            word_of = level.selectExpr("gid as last", "phrase as word")
        else:
            before = level.select(F.col("gid").alias("first"), "lang", F.col("phrase").alias("head"))
            level = staged(
                groups.join(before, "first")
                .join(word_of, "last")
                .select("gid", "lang", F.concat_ws(" ", "head", "word").alias("phrase"), "n"),
                f"phrases-{k}",
            )
        levels.append(level.select("lang", "phrase", F.lit(k).alias("size"), "n"))
    return reduce(DataFrame.unionByName, levels), totals


def joined(words: Column, first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, F.lit(first) if isinstance(first, int) else first, size), " ")


def cut_scores(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more, at their lowest-scoring cut:
    score = floor(2,000,000 a / (l + r)), ties to the cut after fewer words. Decimals, so it is exact."""
    w = F.split("phrase", " ")
    cuts = phrases.where("size > 1").select(
        "lang",
        "phrase",
        F.col("n").alias("a"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.col("size") - 1),
                lambda k: F.struct(
                    k.alias("k"),
                    joined(w, 1, k).alias("head"),
                    joined(w, k + 1, F.col("size") - k).alias("rest"),
                ),
            )
        ).alias("cut"),
    )
    of = phrases.select("lang", "phrase", "n")
    cuts = (
        cuts.select("lang", "phrase", "a", "cut.*")
        .join(of.toDF("lang", "head", "l"), ["lang", "head"])
        .join(of.toDF("lang", "rest", "r"), ["lang", "rest"])
    )
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + r)")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    return lowest.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def subsumed(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the highest count among longer phrases that contain the phrase."""
    w = F.split("phrase", " ")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: joined(w, i, n)),
        )
    )
    parts = phrases.where("size > 2").select("lang", "n", F.explode(inner).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, share: int = 80) -> DataFrame:
    """The first ``most`` phrases of each language by score, count and phrase (in byte order).

    ``docs`` has (lang, text); a null lang counts as ``und``, a null or empty text has no words. Repeated rows
    count each time. A phrase inside a longer one that has at least ``share`` percent of its
    occurrences is left out. An empty table gives no row.
    """
    phrases, totals = frequent_phrases(docs, least)
    inside = F.coalesce("longer", F.lit(0)).cast("decimal(20,0)") * 100
    ranked = (
        cut_scores(phrases)
        .join(subsumed(phrases), ["lang", "phrase"], "left")
        .where(inside < F.col("a").cast("decimal(20,0)") * share)
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Cut in shares first: the task of a language gets SHARES * most rows, however many tasks send to it.
    share_of = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    first = F.row_number().over(Window.partitionBy("lang", share_of).orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return (
        ranked.withColumn("first", first)
        .where(F.col("first") <= most)
        .withColumn("rank", rank)
        .where(F.col("rank") <= most)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
    )


def op11_setm_collocations(docs: DataFrame) -> DataFrame:
    return collocations(docs.select("lang", "text"))
