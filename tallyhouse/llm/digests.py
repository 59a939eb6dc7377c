"""Exact deduplication against a persistent digest index.

The index is a Parquet table of SHA-256 digests on shared storage, bucketed and sorted by digest, with the
document that stays for each. New rows are reduced to one row a digest first (partial sums on every map
task, so a text that a third of all rows hold is one row a task). A sort-merge anti-join of those rows with the
index, bucket by bucket and without moving the index, finds the digests that are new, and they are appended.
All of it is DataFrame functions.

Every entry names the batch that brought it. A verdict is read from the index, so a batch that is run
again after a failure finds its own entries, appends nothing and gives the same verdicts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyhouse.llm.shared import ROW, lower_ascii, new_path, numbered, staged

#: A digest with at least one in so many rows is hot: there are at most so many of them.
HOT_SHARE = 1000


@dataclass(frozen=True)
class DigestIndex:
    spark: SparkSession
    name: str
    n_buckets: int

    def entries(self) -> DataFrame:
        """(digest binary, keep_id long, batch string), one row a digest."""
        return self.spark.table(self.name)

    def add(self, digests: DataFrame, batch: str) -> None:
        """Appends those of ``digests`` (digest, keep_id; one row a digest) that the index does not hold."""
        fresh = digests.join(self.entries().hint("merge"), "digest", "left_anti")
        fresh.select("digest", "keep_id", F.lit(batch)).write.insertInto(self.name)


def open_index(spark: SparkSession, path: str, n_buckets: int | None = None) -> DigestIndex:
    """The index stored at ``path`` (shared storage), made if there is none.

    A new index has ``n_buckets`` buckets, as many as the session has shuffle partitions unless given; the
    number is stored beside the table, and a later session finds it there. Choose it so that a bucket at its
    final size fits a task.
    """
    layout = f"{path}/layout"
    try:
        n = spark.read.schema("n_buckets int").json(layout).first().n_buckets
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        n = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.range(1).select(F.lit(n).alias("n_buckets")).write.json(layout)
    name = f"digests_{hashlib.sha256(path.encode()).hexdigest()[:20]}"
    spark.sql(
        f"""create table if not exists {name} (digest binary, keep_id bigint, batch string)
        using parquet clustered by (digest) sorted by (digest) into {n} buckets
        location '{path}/entries'"""
    )
    return DigestIndex(spark, name, n)


def digest(text: Column) -> Column:
    """SHA-256 of a text in UTF-8 after lower-casing A-Z; null counts as empty."""
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256))


def verdicts(rows: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Adds the digests of ``rows`` to ``index`` and judges every row.

    ``rows`` is stored and has (``_row`` unique, doc_id long, digest); the result has in addition keep_id,
    group_size (rows of this batch with the digest) and kept. Of equal texts the row with the largest
    doc_id stays, among repeats of that id the one with the largest ``_row``; a null doc_id is smaller
    than any. A text that an earlier batch brought is kept nowhere in this one, and keep_id names the
    earlier document. An empty table gives no row.
    """
    # Stored: Spark would push the anti-join below the aggregate and shuffle every copy.
    groups = staged(
        rows.groupBy("digest").agg(
            F.max(F.struct("doc_id", ROW)).alias("own"), F.count("*").alias("group_size")
        ),
        "groups",
    )
    index.add(groups.select("digest", F.col("own.doc_id").alias("keep_id")), batch)
    mine = F.col("batch") == batch
    judged = staged(
        groups.join(index.entries().hint("merge"), "digest").select(
            "digest", "keep_id", "group_size", F.when(mine, F.col(f"own.{ROW}")).alias("stays")
        ),
        "judged",
    )
    # Groups with over a thousandth of all rows are at most a thousand: they are broadcast and their rows
    # stay where they are. All others are small against a task.
    least = max(rows.count() // HOT_SHARE, 1000)
    hot = judged.where(F.col("group_size") > least)
    rare = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    cold = judged.where(F.col("group_size") <= least).hint("merge")
    found = rows.join(F.broadcast(hot), "digest").unionByName(rare.join(cold, "digest"))
    return found.withColumn("kept", F.col("stays").eqNullSafe(F.col(ROW))).drop("stays")


def distinct_documents(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) whose text is new to ``index``, one of each, with their own
    columns. ``docs`` is stored once with row numbers."""
    stored = numbered(docs)
    rows = staged(
        stored.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")),
        "digests",
    )
    kept = verdicts(rows, index, batch).where("kept").select(ROW)
    return stored.join(kept, ROW, "left_semi").select(*docs.columns)


def op12_digest_index(docs: DataFrame) -> DataFrame:
    """All ``documents`` against a new index: one row a row, dropped ones too."""
    spark = docs.sparkSession
    rows = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")
        ).withColumn(ROW, F.monotonically_increasing_id()),
        "digests",
    )
    index = open_index(spark, new_path(spark, "digest-index"))
    return verdicts(rows, index, "documents").select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
