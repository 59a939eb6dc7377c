"""Token ids in fixed-width bit packing, written as files and read back by block.

File layout (little endian): magic ``PKID``, version, width in bits, ids a block (4 bytes each);
the blocks, each ``block * width / 8`` bytes, the last one padded with zeros; the offset of
every block (8 bytes each); then number of blocks, number of ids and the offset of the
block table (8 bytes each). Blocks can be read and unpacked in any order.
"""

from __future__ import annotations

import math
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyhouse.llm.chunks import text_bytes
from tallyhouse.llm.shared import Memory, file_system, new_path, small_batches, staged

MAGIC, VERSION, BLOCK, HEADER, FOOTER = b"PKID", 1, 4096, 16, 24
READ_BLOCKS, STRIPE = 256, 1 << 22
TEXT_BYTES = 2 << 20
TOGETHER = 1000
MANIFEST = "doc_id long, part int, file string, turn long, begin long, n_tokens long"
DIGEST = "doc_id long, part int, begin long, n_tokens long, ids_crc32 long"


def width_of(n_ids: int) -> int:
    return max(1, (n_ids - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` (a multiple of 64 of them) in ``width`` bits each: 64 ids fill ``width`` words."""
    lanes = ids.astype(np.uint64).reshape(-1, 64)
    words = np.zeros((len(lanes), width), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[:, word] |= lanes[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= lanes[:, i] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    lanes = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        lanes[:, i] = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            lanes[:, i] |= words[:, word + 1] << np.uint64(64 - shift)
    lanes &= mask
    return lanes.reshape(-1).astype(np.uint32)


class Writer:
    """Appends ids to one file; whole blocks go out as they fill."""

    def __init__(self, uri: str, width: int):
        fs, path = file_system(uri)
        fs.create_dir(path.rpartition("/")[0])
        self.out = fs.open_output_stream(path, compression=None)
        self.width, self.n, self.open, self.blocks = width, 0, [], 0
        self.waiting = 0
        self.out.write(MAGIC + np.array([VERSION, width, BLOCK], "<u4").tobytes())

    def add(self, ids: np.ndarray) -> None:
        self.open.append(ids)
        self.n += len(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * BLOCK:
            self._flush(self.waiting // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.open) if self.open else np.empty(0, np.uint32)
        self.out.write(pack(ids[:n], self.width))
        self.blocks += n // BLOCK
        self.open, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        if self.waiting:
            self.add(np.zeros(pad := -self.waiting % BLOCK, np.uint32))
            self.n -= pad
            if self.waiting:
                self._flush(self.waiting)
        step = BLOCK * self.width // 8
        table = HEADER + np.arange(self.blocks, dtype="<u8") * step
        end = HEADER + self.blocks * step
        self.out.write(table.tobytes() + np.array([self.blocks, self.n, end], "<u8").tobytes())
        self.out.close()


class Reader:
    """Random access to the ids of one file; reads ``READ_BLOCKS`` neighbouring blocks at once."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.source = fs.open_input_file(path)
        size = self.source.size()
        head = self.source.read_at(HEADER, 0)
        if head[:4] != MAGIC:
            raise ValueError(f"{uri} is no file of packed ids")
        _, self.width, self.block = (int(x) for x in np.frombuffer(head[4:], "<u4"))
        blocks, self.n, table = (
            int(x) for x in np.frombuffer(self.source.read_at(FOOTER, size - FOOTER), "<u8")
        )
        self.offsets = np.frombuffer(self.source.read_at(8 * blocks, table), "<u8")
        self.step = self.block * self.width // 8
        self.first, self.held = 0, np.empty(0, np.uint32)

    def ids(self, begin: int, n: int) -> np.ndarray:
        """Ids ``begin`` to ``begin + n``, piece by piece if they span many blocks."""
        pieces, at = [], begin
        while at < begin + n:
            if not self.first <= at < self.first + len(self.held):
                b = at // self.block
                last = min(b + READ_BLOCKS, len(self.offsets))
                start = int(self.offsets[b])
                data = self.source.read_at(int(self.offsets[last - 1]) + self.step - start, start)
                self.first, self.held = b * self.block, unpack(data, self.width)
            piece = self.held[at - self.first : begin + n - self.first]
            pieces.append(piece)
            at += len(piece)
        return np.concatenate(pieces) if pieces else np.empty(0, np.uint32)


#: Tab, line feed, carriage return and space end a word in every text.
ENDS_WORD = np.isin(np.arange(256), [9, 10, 13, 32])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the place in them of each word of each text, number of words before each text). A word
    keeps one space where the byte that ends it was."""
    data, offsets = text_bytes(texts)
    gaps = ENDS_WORD[data]
    cuts = np.append(False, gaps)
    cuts[offsets] = True
    bounds = np.flatnonzero(cuts)
    data = np.where(gaps, np.uint8(32), data)
    each = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
    coded = each.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(bounds[:-1], offsets)


def runs_of(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of ``values`` one after another, where each begins, and the end)"""
    ends = np.cumsum(np.append(0, lengths))
    at = np.repeat(begins - ends[:-1], lengths)
    at += np.arange(len(at))
    return values[at], ends


class Words:
    """Ids of texts by a tokenizer that never joins words across spaces: each distinct word is encoded once
    by ``_encoded`` and remembered. About ``most`` words are kept as they stand in texts, in Arrow and Numpy
    arrays (those not used lately are forgotten), and ``most`` words without the marks after them."""

    #: Marks that the tokenizer splits off whatever letters stand before them.
    marks = ""

    def __init__(self, most: int = 700_000):
        self.most, self.known = most, Memory(most)
        self.kept = pa.array([], pa.large_string())
        self.ids_kept = np.empty(0, np.uint32)
        self.lengths = self.used = np.empty(0, np.int64)
        self.turn = 0

    def _encoded(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, its ids as bytes) of distinct words, in any order."""
        raise NotImplementedError

    def probe(self, ids: Callable[[str], list[int]]) -> None:
        """Finds ``marks`` by encoding them alone and after letters."""
        self.marks = "".join(
            m for m in ".,;:!?" if ids(f"ab{m}é{m}{m}") == ids("ab") + ids(m) + ids("é") + ids(m * 2)
        )

    def _of_words(self, words: list[str]) -> list[bytes]:
        marks, known = self.marks, self.known.get
        cores, tails, here = [], [], {}
        for w in words:
            w = w.rstrip(" ")
            core, tail = w.rstrip(marks), ""
            if len(core) < len(w) and core[-1:].isalpha():
                tail = w[len(core) :]
                if tail not in here:
                    here[tail] = known(tail)
            else:
                core = w
            cores.append(core)
            tails.append(tail)
            if core not in here:
                here[core] = known(core)
        for word, ids in self._encoded([w for w, ids in here.items() if ids is None]):
            here[word] = ids
            self.known.put(word, ids)
        return [here[c] + here[t] if t else here[c] for c, t in zip(cores, tails)]

    def _forget(self) -> None:
        keep = np.sort(np.argsort(self.used, kind="stable")[-(self.most // 2) :])
        begins = np.cumsum(self.lengths) - self.lengths
        self.ids_kept, _ = runs_of(self.ids_kept, begins[keep], self.lengths[keep])
        self.kept, self.lengths, self.used = self.kept.take(keep), self.lengths[keep], self.used[keep]

    def _places(self, words: pa.Array) -> np.ndarray:
        """The places of distinct words among the kept ones, which new ones join."""
        if len(self.kept) > self.most:
            self._forget()
        places = pc.fill_null(pc.index_in(words, value_set=self.kept), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = places < 0
        missing = words.filter(pa.array(new))
        if len(missing):
            found = self._of_words(missing.to_pylist())
            places[new] = np.arange(len(missing)) + len(self.kept)
            self.kept = pa.concat_arrays([self.kept, missing])
            self.ids_kept = np.append(self.ids_kept, np.frombuffer(b"".join(found), "<u4"))
            self.lengths = np.append(self.lengths, np.fromiter(map(len, found), np.int64, len(found)) // 4)
            self.used = np.append(self.used, np.zeros(len(missing), np.int64))
        self.turn += 1
        self.used[places] = self.turn
        return places

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids before each text); a null text is an empty one."""
        words, places, first = split_words(texts)
        at = self._places(words)
        begins = np.cumsum(self.lengths) - self.lengths
        ids, ends = runs_of(self.ids_kept, begins[at][places], self.lengths[at][places])
        return ids, ends[first]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, begins = self.flat(pa.array(texts, pa.string()))
        return np.split(ids, begins[1:-1]) if texts else []


class WordIds(Words):
    """Ids by a tokenizer file, each distinct word encoded by the tokenizers library."""

    def __init__(self, path: str, most: int = 700_000):
        super().__init__(most)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.probe(self.ids)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.n_ids, bool)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.ends[i] = token.endswith(suffix)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    @property
    def n_ids(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _encoded(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, its ids as bytes). Words of letters alone are one pre-token each: they are encoded many in a
        call and told apart by the ids that end a pre-token, if the numbers of both agree."""
        single = [w for w in words if w.isalpha()] if self.ends is not None else []
        alone = words if self.ends is None else [w for w in words if not w.isalpha()]
        for i in range(0, len(single), TOGETHER):
            some = single[i : i + TOGETHER]
            ids = np.array(self.ids(" ".join(some)), "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(some) or last[-1] != len(ids):
                alone += some
                continue
            data, bounds = ids.tobytes(), [0, *(4 * last).tolist()]
            yield from zip(some, [data[a:b] for a, b in zip(bounds, bounds[1:])])
        for word, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            yield word, np.array(e.ids, "<u4").tobytes()


_TOKENIZERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = TEXT_BYTES):
    """The batches in runs of rows of about ``most`` bytes of text (at least one row)."""
    for batch in batches:
        sizes = np.cumsum(
            [0, *(v or 0 for v in pc.binary_length(batch.column(text)).to_pylist())]
        )
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def joined(batches: Iterator[pa.RecordBatch], most: int = 4 * TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches as one, up to ``most`` bytes: the more text at once, the fewer its distinct words."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > most:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _writer(folder: str, tokenizer: str, end_id: int | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, uri = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}.ids"
        words, out, turn = word_ids(tokenizer), None, 0
        width = width_of(words.n_ids if end_id is None else max(words.n_ids, end_id + 1))
        for rows in slices(joined(batches), 1, 4 * TEXT_BYTES):
            if out is None:
                out = Writer(uri, width)
            ids, begins = words.flat(rows.column(1))
            if end_id is not None:
                ids = np.insert(ids, begins[1:], end_id)
                begins = begins + np.arange(len(begins))
            first = out.n
            out.add(ids)
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([part] * n, pa.int32()),
                    pa.array([uri] * n, pa.string()),
                    pa.array(range(turn, turn + n), pa.int64()),
                    pa.array(first + begins[:-1], pa.int64()),
                    pa.array(np.diff(begins), pa.int64()),
                ],
                ["doc_id", "part", "file", "turn", "begin", "n_tokens"],
            )
            turn += n
        if out is not None:
            out.close()

    return write


def write_ids(docs: DataFrame, tokenizer: str, end_id: int | None = 1) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) in ascending doc_id order to files of packed ids; returns the
    staged manifest, a row a document: its part (files in order), file, place and count.

    Null doc_ids come first; rows with equal doc_id keep their order of reading. A null or empty text has
    the end id alone. Other columns are ignored; an empty table writes no file.
    """
    small_batches(docs.sparkSession)
    folder = new_path(docs.sparkSession, "ids")
    ordered = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "text",
            F.monotonically_increasing_id().alias("_row"),
        )
        .repartitionByRange("doc_id", "_row")
        .sortWithinPartitions("doc_id", "_row")
        .select("doc_id", "text")
    )
    return staged(ordered.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, source = None, None
    for batch in batches:
        sums = []
        for file, begin, n in zip(*(batch.column(c).to_pylist() for c in ("file", "begin", "n_tokens"))):
            if file != name:
                name, source = file, Reader(file)
            sums.append(zlib.crc32(source.ids(begin, n).astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "part", "begin", "n_tokens")), pa.array(sums, pa.int64())],
            ["doc_id", "part", "begin", "n_tokens", "ids_crc32"],
        )


def read_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files themselves."""
    n_ids = manifest.agg(F.sum("n_tokens")).first()[0] or 0
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    read = (
        manifest.select("doc_id", "part", "file", "begin", "n_tokens", F.floor(F.col("begin") / STRIPE).alias("stripe"))
        .repartition(max(1, math.ceil(n_ids / STRIPE)), "file", "stripe")
        .sortWithinPartitions("file", "begin")
        .drop("stripe")
        .mapInArrow(_reader, DIGEST)
    )
    return read.join(starts, "part").select(
        "doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"
    )


def op4_packed_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``documents`` encoded, written as files of packed ids and read back."""
    return read_digests(write_ids(docs, tokenizer))
