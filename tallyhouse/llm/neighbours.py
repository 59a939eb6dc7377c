"""Nearest neighbours by inner product: multi-index hashing over learned binary codes.

Vectors are scaled by the largest length and get one more coordinate that makes all lengths one, so the
largest inner product is the smallest angle. Principal axes and ``TABLES`` learned rotations (iterative quantisation)
turn them into codes of bits. A code is split into substrings, each indexed: of two codes within Hamming radius r = m*s + a,
one of the first a + 1 substrings differs in at most s bits or one of the others in at most s - 1.
Probing those buckets retrieves every code within the radius; retrieved codes are checked and reranked on the floats.

The rotations and the radius are learned on the ``SAMPLE`` rows of least hash: the radius is the smallest with recall
``TARGET`` there. Every row is indexed. Index and queries meet in blocks of bounded size, each
index block with its own substring tables; a query's best of all blocks are merged. A query that finds
fewer than ``k`` in its radius is searched again in the largest radius, so the answer is short only if there are fewer rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.llm.shared import staged

SAMPLE, TARGET, TABLES, ROUNDS = 4096, 0.97, 2, 25
SUBSTRING = 8
INDEX_BLOCK, QUERY_BLOCK, QUERY_STEP = 8192, 1024, 128
CODED = "vec_id long, row long, vec binary, code binary, asked binary"
FOUND = "query_id long, query_row long, vec_id long, row long, score double"


def takes_part(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Coder:
    """Learned codes. Index rows and queries differ in the added coordinate only."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 42):
        self.longest, random = longest, np.random.RandomState(seed)
        points = self.lifted(sample)
        self.mean = points.mean(axis=0)
        centred = points - self.mean
        bits = sample.shape[1]
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, :bits]
        flat = centred @ axes
        turns = []
        for _ in range(TABLES):
            turn = np.linalg.qr(random.standard_normal((bits, bits)))[0]
            for _ in range(ROUNDS):
                u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
                turn = (u @ v).T
            turns.append(axes @ turn)
        self.turn = np.concatenate(turns, axis=1)
        self.bits = self.turn.shape[1]

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors / self.longest
        return np.concatenate([v, np.sqrt(np.maximum(1 - (v * v).sum(1, keepdims=True), 0))], axis=1)

    def asked(self, vectors: np.ndarray) -> np.ndarray:
        """Codes of queries, as rows of bytes."""
        v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return self._code(np.concatenate([v, np.zeros((len(v), 1))], axis=1))

    def code(self, vectors: np.ndarray) -> np.ndarray:
        return self._code(self.lifted(vectors))

    def _code(self, points: np.ndarray) -> np.ndarray:
        return np.packbits((points - self.mean) @ self.turn > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of ``a`` and each of ``b``."""
    total = np.zeros((len(a), len(b)), np.uint16)
    for x, y in zip(a.T, b.T):
        total += np.bitwise_count(x[:, None] ^ y[None, :])
    return total


def fit(sample: np.ndarray, longest: float, k: int) -> tuple[Coder, int]:
    """The coder and the smallest radius that finds ``TARGET`` of the k nearest in the sample."""
    points = np.unique(sample, axis=0)
    coder = Coder(points, longest)
    queries = np.random.RandomState(0).permutation(len(points))[:256]
    near = min(k, len(points) - 1)
    if near < 1:
        return coder, coder.bits
    scores = points[queries] @ points.T
    scores[np.arange(len(queries)), queries] = -np.inf
    best = np.argpartition(-scores, near - 1, axis=1)[:, :near]
    apart = np.take_along_axis(hamming(coder.asked(points[queries]), coder.code(points)), best, axis=1)
    return coder, int(np.quantile(apart, TARGET, method="higher"))


def probes(radius: int, n_substrings: int) -> list[int]:
    """The largest difference allowed in each substring; -1: that substring is not probed."""
    s, a = divmod(radius, n_substrings)
    return [s if i <= a else s - 1 for i in range(n_substrings)]


class SubstringIndex:
    """Codes of one block, listed by the value of each 8-bit substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.begin = [
            np.searchsorted(c[o], np.arange(257)) for c, o in zip(codes.T, self.order)
        ]

    def retrieve(self, asked: np.ndarray, radius: int) -> np.ndarray:
        """found[query, row]: the rows within ``radius``, all of them."""
        found = np.zeros((len(self.codes), len(asked)), bool)
        values = np.arange(256, dtype=np.uint8)
        for i, most in enumerate(probes(radius, self.codes.shape[1])):
            if most < 0:
                continue
            opened = np.bitwise_count(values[:, None] ^ asked[:, i][None, :]) <= most
            rows = self.order[i]
            found[rows] |= np.repeat(opened, np.diff(self.begin[i]), axis=0)
        return found.T & (hamming(asked, self.codes) <= radius)


def search_block(index: pd.DataFrame, queries: pd.DataFrame, radius: int, k: int) -> pd.DataFrame:
    """The best k of one index block for each query of one query block."""
    vectors = np.frombuffer(b"".join(index["vec"]), float).reshape(len(index), -1)
    tables = SubstringIndex(np.frombuffer(b"".join(index["code"]), np.uint8).reshape(len(index), -1))
    ids, rows = index["vec_id"].to_numpy(), index["row"].to_numpy()
    asked = np.frombuffer(b"".join(queries["asked"]), np.uint8).reshape(len(queries), -1)
    floats = np.frombuffer(b"".join(queries["vec"]), float).reshape(len(queries), -1)
    query_ids, query_rows = queries["vec_id"].to_numpy(), queries["row"].to_numpy()
    out = []
    for at in range(0, len(queries), QUERY_STEP):
        part = slice(at, at + QUERY_STEP)
        found = tables.retrieve(asked[part], radius) & (query_rows[part][:, None] != rows[None, :])
        scores = np.where(found, floats[part] @ vectors.T, -np.inf)
        least = -np.inf
        if len(rows) > k:
            least = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k]
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
        q, r = np.nonzero(found & (scores >= np.reshape(least - slack, (-1, 1))))
        exact = (floats[part][q] * vectors[r]).sum(axis=1)
        order = np.lexsort((rows[r], ids[r], -exact, q))
        q, r, exact = q[order], r[order], exact[order]
        turn = np.arange(len(q)) - np.searchsorted(q, q)
        q, r, exact = q[turn < k], r[turn < k], exact[turn < k]
        out.append(
            pd.DataFrame(
                {
                    "query_id": query_ids[part][q],
                    "query_row": query_rows[part][q],
                    "vec_id": ids[r],
                    "row": rows[r],
                    "score": exact,
                }
            )
        )
    return pd.concat(out)


def _search(index: DataFrame, queries: DataFrame, radius: int, k: int) -> DataFrame:
    n_index, n_queries = index.count(), queries.count()
    blocks = max(1, math.ceil(n_index / INDEX_BLOCK))
    query_blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        )

    left = dealt(index.drop("asked"), "block", blocks, "query_block", query_blocks)
    right = dealt(queries.drop("code"), "query_block", query_blocks, "block", blocks)

    def pair(index_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(index_rows) or not len(query_rows):
            return pd.DataFrame(columns=["query_id", "query_row", "vec_id", "row", "score"])
        return search_block(index_rows, query_rows, radius, k)

    found = (
        left.groupBy("block", "query_block")
        .cogroup(right.groupBy("block", "query_block"))
        .applyInPandas(pair, FOUND)
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score, query_row) for the rows of ``vectors`` (vec_id, embedding) where ``is_query``.

    Null, zero, or not wholly finite vectors take no part, nor do rows without vec_id or of another
    dimension than most rows have. A query is no candidate of its own, but other rows with its vec_id are; repeated
    rows are rows. Equal scores go by vec_id. Other columns are ignored. Without two rows the result is empty.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        is_query.alias("is_query"),
        F.monotonically_increasing_id().alias("row"),
    ).where(F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    sizes = (
        rows.groupBy(F.size("embedding").alias("size"))
        .agg(F.count("*").alias("n"), F.max(length).alias("longest"))
        .orderBy(F.desc("n"), "size")
        .first()
    )
    schema = "query_id long, rank int, vec_id long, score double, query_row long"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("embedding") == sizes["size"])
    drawn = rows.orderBy(F.xxhash64("vec_id"), "row").limit(sample).select("embedding").toPandas()
    coder, radius = fit(np.array(drawn["embedding"].to_list(), float), sizes["longest"], k)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            cells = [[r.tobytes() for r in x] for x in (v, coder.code(v), coder.asked(v))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in cells), batch.column(3)],
                ["vec_id", "row", "vec", "code", "asked", "is_query"],
            )

    index = staged(
        rows.select("vec_id", "row", "embedding", "is_query").mapInArrow(
            coded, f"{CODED}, is_query boolean"
        ),
        "codes",
    )
    queries = index.where("is_query").drop("is_query")
    index = index.drop("is_query")
    found = staged(_search(index, queries, radius, k), "found")
    full = min(k, index.count() - 1)
    counts = found.groupBy("query_row").agg(F.count("*").alias("n"))
    short = staged(
        queries.join(
            counts.where(F.col("n") >= full).select(F.col("query_row").alias("row")), "row", "left_anti"
        ).select(queries.columns),
        "short",
    )
    again = _search(index, short, coder.bits + 8, k)
    done = found.join(short.select(F.col("row").alias("query_row")), "query_row", "left_anti")
    return done.unionByName(again).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_row"
    )


def op1_multi_index_hashing(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 20 == 0).drop("query_row")
