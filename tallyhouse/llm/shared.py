"""What the operators of this subpackage share: tables, staging on shared storage, files."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROW = "_row"
#: Bytes that separate words in the contracts that take ``[^\x20\x09-\x0D]+``.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session may do without one; it gets a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path on shared storage that nothing uses yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` computed once and read back from a Parquet table on shared storage, so a lost
    executor costs a read and not the work before it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with a row number ``_row`` (long, distinct, replaces a column of that name), stored: every
    scan has the same ones, however it is split."""
    return staged(df.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a Spark path (``file:``, ``hdfs:``, ``s3a:`` or plain) and the path in it."""
    if re.match(r"^[a-z0-9]+:/", uri):
        uri = re.sub(r"^s3[an]:", "s3:", uri)
        uri = re.sub(r"^file:/+", "file:///", uri)
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts are long rows: from now on at most ``rows`` of them go to a Python task at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


class Memory:
    """A dictionary that keeps what was used lately: of two generations the older goes when the newer
    holds ``most`` / 2 entries. Between, it has ``most`` at most."""

    def __init__(self, most: int):
        self.half, self.new, self.old = max(most // 2, 1), {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


def release() -> None:
    """Gives memory that a task has freed back to the system; Spark keeps its Python workers."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def size_class(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; reads no more than that many."""
    return df.limit(most_rows + 1).count() <= most_rows


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, although ``use`` names it often."""
    return F.transform(F.array(value), use)[0]
