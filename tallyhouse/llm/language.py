"""Language identification by unigrams of pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum,
over all ways to cut it into pieces, of the product of their probabilities (forward
algorithm); no piece crosses a word, so a text's is the product over its words. Probabilities
are learned by expectation-maximisation (forward-backward) on the words of at most ``SAMPLE`` training rows a
language, each language in a task of its own. Every row is scored on its whole text.

A word is a run of letters and number signs, lower-cased. It is scored whole, however long; only in learning
are words over ``LONGEST`` characters cut there. A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.llm.packed import slices
from tallyhouse.llm.shared import release, small_batches, staged

SAMPLE, ROUNDS, LONGEST, TOGETHER = 1000, 4, 32, 10_000
ALPHA, STRANGE = 0.01, 1e-7
WORD = re.compile(r"[^\W\d_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Pieces:
    """The vocabulary's pieces of letters, found in words by rolling hashes."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.keys, self.ids, self.seen = {}, {}, {}
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(strings):
            by_length.setdefault(len(s), []).append(i)
        for k, ids in by_length.items():
            ((_, hashes),) = self.hashes(np.array([strings[i] for i in ids]).view(np.uint32).reshape(-1, k), [k])
            hashes = hashes[:, 0]
            order = np.argsort(hashes)
            self.keys[k], self.ids[k] = hashes[order], np.array(ids)[order]
            self.seen[k] = np.zeros(1 << 16, bool)
            self.seen[k][hashes >> np.uint64(48)] = True

    @property
    def longest(self) -> int:
        return max(self.keys, default=0)

    @staticmethod
    def hashes(codes: np.ndarray, lengths: Collection[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Hashes of all substrings of each of the wanted lengths, made from those of the length before."""
        length = codes.shape[1]
        h, codes = np.zeros(codes.shape, np.uint64), codes.astype(np.uint64)
        for k in range(1, min(max(lengths), length) + 1):
            h = h[:, : length - k + 1] * BASE + codes[:, k - 1 :]
            if k in lengths:
                yield k, h ^ (h >> np.uint64(29))

    def find(self, words: list[str]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(end, length) -> (rows, piece ids) of all pieces in ``words`` of one length."""
        codes = np.array(words).view(np.uint32).reshape(len(words), -1)
        found = {}
        for k, h in self.hashes(codes, self.keys) if self.keys else ():
            keys = self.keys[k]
            row, at = np.nonzero(self.seen[k][h >> np.uint64(48)])
            value = h[row, at]
            place = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            hit = keys[place] == value
            row, at, ids = row[hit], at[hit], self.ids[k][place[hit]]
            order = np.argsort(at, kind="stable")
            row, at, ids = row[order], at[order], ids[order]
            cuts = np.searchsorted(at, np.arange(codes.shape[1] - k + 2))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    found[i + k, k] = row[a:b], ids[a:b]
        return found


def letter_pieces(path: str) -> list[str]:
    """Pieces of lower-case letters in the vocabulary, ``▁`` at a word's begin."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte)
    out = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        body = p.removeprefix("▁")
        if any(f(i) for f in special) or p != p.lower():
            continue
        if p == "▁" or body.isalpha():
            out.append(p)
    return out


def cut_words(words: list[str]) -> dict[int, list[tuple[str, int]]]:
    """Length -> (symbols, number of the word): in learning, long words come in several cuts."""
    out: dict[int, list[tuple[str, int]]] = {}
    for n, w in enumerate(words):
        s = "▁" + w
        for at in range(0, len(s), LONGEST):
            part = s[at : at + LONGEST]
            out.setdefault(len(part), []).append((part, n))
    return out


def forward(found: dict, n: int, length: int, table: np.ndarray) -> np.ndarray:
    """alpha[word, end, language]; a character that no piece starts or ends with costs ``STRANGE``."""
    alpha = np.zeros((n, length + 1, table.shape[1]))
    alpha[:, 0] = 1
    most = max((k for _, k in found), default=0)
    for end in range(1, length + 1):
        alpha[:, end] = alpha[:, end - 1] * STRANGE
        for k in range(1, min(most, end) + 1):
            if (end, k) in found:
                row, ids = found[end, k]
                alpha[row, end] += alpha[row, end - k] * table[ids]
    return alpha


def word_scores(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """log10 probability of each word in each language, over all segmentations of the whole word."""
    out = np.zeros((len(words), table.shape[1]))
    short = [(n, w) for n, w in enumerate(words) if len(w) < LONGEST]
    for length, cuts in cut_words([w for _, w in short]).items():
        found = pieces.find([c for c, _ in cuts])
        out[[short[n][0] for _, n in cuts]] = np.log10(forward(found, len(cuts), length, table)[:, length])
    for n, w in enumerate(words):
        if len(w) >= LONGEST:
            out[n] = long_score(pieces, table, "▁" + w)
    return out


def long_score(pieces: Pieces, table: np.ndarray, symbols: str) -> np.ndarray:
    """The same for one long word, window by window: the sums at the last places are carried on, divided by
    their largest, whose logarithm is kept."""
    back = max(pieces.longest, 1)
    carried = np.zeros((back, table.shape[1]))  # the sums at the last ``back`` places
    carried[-1] = 1
    log = np.zeros(table.shape[1])
    for start in range(0, len(symbols), LONGEST):
        context = min(back - 1, start)
        window = symbols[start - context : start + LONGEST]
        found = pieces.find([window])
        for end in range(context + 1, len(window) + 1):
            total = carried[-1] * STRANGE
            for k in range(1, min(back, end) + 1):
                if (end, k) in found:
                    total = total + carried[-k] * table[found[end, k][1][0]]
            carried = np.concatenate([carried[1:], total[None]])
            if end % 8 == 0:
                largest = carried.max(axis=0)
                log += np.log10(largest)
                carried = carried / largest
    return log + np.log10(carried[-1])


def learn(counts: dict[str, int], strings: list[str]) -> np.ndarray:
    """Expected count of every piece in the words of one language."""
    pieces = Pieces(strings)
    words = sorted(counts)
    weights = np.array([counts[w] for w in words], float)
    groups = []
    for length, cuts in cut_words(words).items():
        found = pieces.find([c for c, _ in cuts])
        groups.append((length, found, weights[[n for _, n in cuts]]))
    expected = np.zeros(len(strings))
    for _, found, weight in groups:
        for row, ids in found.values():
            np.add.at(expected, ids, weight[row])
    for _ in range(ROUNDS):
        p = (expected + ALPHA) / (expected.sum() + ALPHA * len(strings))
        expected = np.zeros(len(strings))
        for length, found, weight in groups:
            alpha = forward(found, len(weight), length, p[:, None])[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[:, length] = 1
            for at in range(length - 1, -1, -1):
                beta[:, at] = beta[:, at + 1] * STRANGE
                for k in range(1, min(pieces.longest, length - at) + 1):
                    if (at + k, k) in found:
                        row, ids = found[at + k, k]
                        beta[row, at] += beta[row, at + k] * p[ids]
            scale = weight / alpha[:, length]
            for (end, k), (row, ids) in found.items():
                np.add.at(expected, ids, alpha[row, end - k] * p[ids] * beta[row, end] * scale[row])
    return expected


class Identifier:
    """Scores texts with a learned table (piece x language); remembers ``most`` words."""

    def __init__(self, languages: list[str], strings: list[str], table: np.ndarray, most: int = 200_000):
        self.languages, self.pieces, self.table = languages, Pieces(strings), table
        self.most, self.place, self.scores = most, {}, np.zeros((0, len(languages)))

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_of(t or "") for t in texts]
        if len(self.place) > self.most:
            self.place, self.scores = {}, self.scores[:0]
        new = list(set().union(*split).difference(self.place))
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            some = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)]
            self.scores = np.concatenate([self.scores, *(word_scores(self.pieces, self.table, w) for w in some)])
        out = []
        for words in split:
            if not has_letter(words):
                out.append(("und", 0.0))
                continue
            total = self.scores[[self.place[w] for w in words]].sum(axis=0)
            best = int(np.argmax(total))
            out.append((self.languages[best], float(1 / (10.0 ** np.maximum(total - total[best], -300)).sum())))
        return out


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def held_out(remainder_of: int) -> Column:
    """Whether crc32 of the doc_id as text leaves 1; a null doc_id counts as empty text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % remainder_of == 1


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        counts: Counter = Counter()
        for lang, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
            for w, n in Counter(words_of(text)).items():
                counts[lang, w] += n
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in counts], pa.string()),
                pa.array([k[1] for k in counts], pa.string()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["lang", "word", "n"],
        )


def train(docs: DataFrame, vocabulary: str, sample: int = SAMPLE) -> tuple[list[str], list[str], np.ndarray]:
    """(languages, pieces, probabilities) learned from ``docs`` (lang, text, doc_id); rows with a null
    lang or text teach nothing. The sample is the ``sample`` rows of least hash a language."""
    rows = docs.where("lang is not null and text is not null").select(
        "lang", "text", F.xxhash64("doc_id").alias("h"), F.monotonically_increasing_id().alias("row")
    )
    first = Window.partitionBy("lang").orderBy("h", "row")
    chosen = staged(
        rows.select("lang", "h", "row")
        .withColumn("turn", F.row_number().over(first))
        .where(F.col("turn") <= sample)
        .select("row"),
        "sample",
    )
    counts = (
        rows.join(chosen, "row", "left_semi")
        .select("lang", "text")
        .mapInArrow(_word_counts, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        strings = letter_pieces(vocabulary)
        expected = learn(dict(zip(pdf["word"], pdf["n"])), strings)
        used = np.nonzero((expected > 1e-3) | (np.char.str_len(np.array(strings)) == 1))[0]
        total = expected.sum() + ALPHA * len(strings)
        return pd.DataFrame(
            {
                "lang": pdf["lang"].iloc[0],
                "piece": [strings[i] for i in used],
                "p": (expected[used] + ALPHA) / total,
                "least": ALPHA / total,
            }
        )

    learned = (
        counts.groupBy("lang").applyInPandas(fit, "lang string, piece string, p double, least double").toPandas()
    )
    languages, strings = sorted(learned["lang"].unique()), sorted(learned["piece"].unique())
    table = np.zeros((len(strings), len(languages)))
    for j, lang in enumerate(languages):
        own = learned[learned["lang"] == lang]
        table[:, j] = own["least"].iloc[0]
        table[np.searchsorted(np.array(strings, object), own["piece"].to_numpy(object)), j] = own["p"]
    return languages, strings, table


def labelled(
    docs: DataFrame,
    model: tuple[list[str], list[str], np.ndarray],
    keep_text: bool = False,
    unnamed: str = "und",
) -> DataFrame:
    """``docs`` with lang_pred and score, and without its ``text`` unless ``keep_text``; each whole
    text is scored once. If no language was learned, texts with a letter are ``unnamed``."""
    languages, strings, table = model
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    carried = ["text", *others] if keep_text else others
    schema = docs.select(*carried).schema.add("lang_pred", "string").add("score", "double")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(languages, strings, table) if languages else None
        for batch in slices(batches, 0):
            texts = batch.column(0).to_pylist()
            if identifier:
                got = identifier.label(texts)
            else:
                got = [(unnamed if has_letter(words_of(t or "")) else "und", 0.0) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[0 if keep_text else 1 :],
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([g[1] for g in got], pa.float64()),
                ],
                [*carried, "lang_pred", "score"],
            )
        del identifier
        release()

    return docs.select("text", *others).mapInArrow(rows, schema)


def identify(docs: DataFrame, vocabulary: str, folds: int = 3, sample: int = SAMPLE) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    The model learns from rows that are not held out; lang, source and doc_id are no input of a
    prediction. Ties between languages go to the first by name. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(docs.where(~held_out(folds)), vocabulary, sample)
    return labelled(docs.select("doc_id", held_out(folds).alias("held_out"), "text"), model)


def op10_marginalised_unigrams(docs: DataFrame, vocabulary: str) -> DataFrame:
    return identify(docs, vocabulary)
