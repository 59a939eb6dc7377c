"""SimHash near-duplicates by pivot distance tables.

Equal fingerprints are one node. For every node its Hamming distances to reference fingerprints are
computed once. The first references are the zero fingerprint and the 64 with a single bit: the
distance to the one of bit i less the distance to zero is 1 or -1, so two fingerprints within k bits differ
in at most k of these 64 coordinates, and of k+2 blocks of coordinates at least two are equal. Each pair
of blocks is one table; nodes that agree in it meet in a bucket. There the distances to further, random
references discard pairs whose largest coordinate difference is above k, and the survivors are
verified. Buckets are dealt out in pairs of chunks of at most ``CHUNK`` nodes, so a large group of near
copies spreads over tasks; a task returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.llm.components import components
from tallyhouse.llm.packed import slices
from tallyhouse.llm.shared import small_batches, staged

BITS, CHUNK, SEED = 64, 1024, 42
N_REFERENCES = 24
FINGERPRINT = "doc_id long, row long, fp long"


def fingerprint(text: str, shingle: int) -> int:
    """Words end at ASCII white space, A-Z are lower-cased; fewer words than a shingle are one shingle."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], "<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.uint32
        )
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, row: Column | None = None) -> DataFrame:
    """(doc_id, row, fp) of ``docs`` (doc_id, text); ``row`` tells equal rows apart, by the number given if any."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fps = [fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(fps, np.uint64).view(np.int64))],
                ["doc_id", "row", "fp"],
            )

    small_batches(docs.sparkSession)
    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
    )
    return staged(chosen.mapInArrow(rows, FINGERPRINT), "fingerprints")


def block_masks(most_bits: int) -> list[int]:
    """Masks of the block pairs: two of ``most_bits`` + 2 blocks of coordinates."""
    n = most_bits + 2
    ends = [round(BITS * i / n) for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:])]
    return [x | y for x, y in itertools.combinations(blocks, 2)]


def references() -> np.ndarray:
    """The random reference fingerprints of the pivot table."""
    return np.random.RandomState(SEED).randint(0, 1 << 32, (N_REFERENCES, 2)).astype(np.uint64) @ np.array(
        [1 << 32, 1], np.uint64
    )


def distances(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of ``fps`` to the references, a row a reference."""
    return np.stack([np.bitwise_count(fps ^ r) for r in references()]).astype(np.int8)


def links(fps: np.ndarray, left: np.ndarray, right: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``left`` x ``right`` within ``most_bits``: table first, then exactly."""
    table = distances(fps)
    near = np.abs(table[0][left][:, None] - table[0][right][None, :]) <= most_bits
    i, j = np.nonzero(near)
    i, j = left[i], right[j]
    for row in table[1:]:
        if not len(i):
            break
        keep = np.abs(row[i] - row[j]) <= most_bits
        i, j = i[keep], j[keep]
    keep = np.bitwise_count(fps[i] ^ fps[j]) <= most_bits
    return i[keep], j[keep]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links (root, member) of a spanning forest of the links (i, j) between n nodes."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not (root == root[root]).all():
            root = root[root]
    return [(int(r), m) for m, r in enumerate(root) if r != m]


def _bucket_links(most_bits: int):
    def groups(batches: Iterator[pa.RecordBatch]):
        """(left fps, right fps) of each bucket's chunk pair; one side empty: a chunk with itself."""
        kept, key = [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("table", "key", "first", "second", "chunk", "fp")]
            if not len(columns[0]):
                continue
            ids = np.stack(columns[:4], axis=1)
            cuts = [0, *(np.nonzero((ids[1:] != ids[:-1]).any(axis=1))[0] + 1), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                now = tuple(ids[a])
                if now != key and kept:
                    yield key, kept
                    kept = []
                key = now
                kept.append((columns[4][a:b], columns[5][a:b]))
        if kept:
            yield key, kept

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for (_, _, first, second), parts in groups(batches):
            chunk = np.concatenate([p[0] for p in parts])
            fps = np.concatenate([p[1] for p in parts]).view(np.uint64)
            if len(fps) < 2:
                continue
            side = np.arange(len(fps))
            if first == second:
                i, j = links(fps, side, side, most_bits)
                i, j = i[i < j], j[i < j]
            else:
                i, j = links(fps, side[chunk == first], side[chunk == second], most_bits)
            for r, m in forest(len(fps), i, j):
                a.append(fps[r])
                b.append(fps[m])
            if len(a) >= 1 << 14:
                yield _edges(a, b)
                a, b = [], []
        yield _edges(a, b)

    return rows


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"]
    )


def near_edges(nodes: DataFrame, most_bits: int) -> DataFrame:
    """(a, b): links that connect all of ``nodes`` (fp, distinct) within ``most_bits`` bits."""
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in block_masks(most_bits)]
    table = F.explode(
        F.array(
            *[
                F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                for t, m in enumerate(masks)
            ]
        )
    )
    rows = nodes.select("fp", table.alias("at")).select("fp", "at.table", "at.key")
    shared = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    n_chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("fp"), F.col("n_chunks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("n_chunks") - 1),
        lambda c: F.struct(
            F.least(c, F.col("chunk")).alias("first"), F.greatest(c, F.col("chunk")).alias("second")
        ),
    )
    dealt = (
        rows.join(shared, ["table", "key"])
        .withColumn("n_chunks", n_chunks)
        .withColumn("chunk", chunk)
        .select("table", "key", "fp", "chunk", F.explode(others).alias("pair"))
        .select("table", "key", "pair.first", "pair.second", "chunk", "fp")
        .repartition("table", "key", "first", "second")
        .sortWithinPartitions("table", "key", "first", "second")
    )
    return dealt.mapInArrow(_bucket_links(most_bits), "a long, b long")


def near_groups(docs: DataFrame, shingle: int = 3, most_bits: int = 3, row: Column | None = None) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text; other columns are ignored): doc_id, row, fp, ``component_id``
    and ``kept`` (one row of each component: the smallest doc_id, the first of equal ones).

    Null, empty and wordless texts have fingerprint zero, which links like any other. A null doc_id is
    larger than all others; a component of nulls alone has a null id. Links hold between any two texts, copies included.
    ``row`` is the row number that ``docs`` has stored, for a caller who goes by it; otherwise that of the scan.
    """
    docs = fingerprints(docs, shingle, row)
    order: Column = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = staged(docs.groupBy("fp").agg(F.min(order).alias("least")), "nodes")
    roots = components(near_edges(nodes.select("fp"), most_bits)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("first"))
    by_fp = staged(rooted.select("fp", "root").join(least, "root").select("fp", "first"), "groups")
    return docs.join(by_fp, "fp").select(
        "doc_id",
        "row",
        "fp",
        F.col("first.doc_id").alias("component_id"),
        (F.col("first.row") == F.col("row")).alias("kept"),
    )


def op3_simhash_pivot_tables(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
