"""WARC archives with an index that is written first and read by byte ranges.

Writing: payloads are compared by SHA-1 digest and length; of equal payloads of at least
``least`` bytes one is kept as ``response`` and the others become ``revisit`` records without
payload. Each task writes its records to one archive on shared storage, every record a gzip
member of its own, and returns an index row (file, offset, length, url, digest) a record. Files
have names that no second attempt reuses; the staged index names the files that count.

Reading: there is a task for every ``STRIPE`` bytes that the index selects (its own rows are too
small to tell). Index rows are sorted by file and offset, near neighbours are coalesced to one ranged
read of at most ``MOST_BYTES`` (or one record, if that is longer), and the records are parsed.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.shared import ROW, file_system, new_path, numbered, staged

GAP, MOST_BYTES, STRIPE = 1 << 16, 8 << 20, 32 << 20
DATE = "2000-01-01T00:00:00Z"
INDEX = (
    "file string, offset long, length long, page_id long, url string, digest string,"
    " record_type string"
)
RECORD = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string,"
    " refers_to long, html string"
)
DIGEST_ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_bytes(page_id, url, html, kind, size, digest, refers_to) -> bytes:
    """One WARC/1.1 record. ``html`` None: a revisit of the record of page ``refers_to``."""
    target = "" if url is None else "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    block = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    ).encode()
    block += b"" if html is None else html
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")

    def page(name: str) -> int | None:
        text = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    return {
        "page_id": page("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": page("WARC-Refers-To"),
        "html": payload.decode() if kind == "response" else None,
    }


def _writer(folder: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        fs, root = file_system(folder)
        names = [f.strip().split()[0] for f in INDEX.split(",")]
        try:
            for batch in batches:
                index: dict[str, list] = {n: [] for n in names}
                for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
                    page_id, url, html, kind, size, digest, refers_to = (v.as_py() for v in row)
                    data = gzip.compress(
                        record_bytes(page_id, url, html, kind, size, digest, refers_to), level, mtime=0
                    )
                    if out is None:
                        fs.create_dir(root)
                        name = path.rpartition("/")[2]
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(data)
                    for n, v in zip(names, (path, at, len(data), page_id, url, digest, kind)):
                        index[n].append(v)
                    at += len(data)
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index[n], t) for n, t in zip(names, types)], names
                )
        finally:
            if out is not None:
                out.close()

    return write


def _responses(pages: DataFrame, least: int) -> DataFrame:
    """Per payload of at least ``least`` bytes (digest, size): the page that keeps it, the largest page_id,
    then ``_row``, and how many rows tie with it. Stored."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    facts = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.octet_length(payload).cast("long").alias("size"),
        F.sha1(payload).alias("digest"),
        F.col(ROW).cast("long").alias("row"),
    ).where(F.col("size") >= least)
    same = facts.groupBy("digest", "size", "page_id").agg(
        F.max("row").alias("row"), F.count("*").alias("ties")
    )
    return staged(
        same.groupBy("digest", "size").agg(F.max(F.struct("page_id", "row", "ties")).alias("kept")),
        "responses",
    )


def write_archives(pages: DataFrame, least: int = 1000, level: int = 3) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) and returns the index.

    A null html is an empty payload, a null url leaves out the target; other columns are ignored. Of equal
    payloads the largest page_id is the response (nulls are smallest); of rows that tie there,
    one is the response and the others revisit it. The choice is made on a narrow read of
    ``pages``, by page_id; only if rows tie are they stored with numbers first and told apart by these.
    """
    spark = pages.sparkSession
    kept = _responses(pages.withColumn(ROW, F.lit(0)), least)
    if not kept.where("kept.ties > 1").isEmpty():
        pages = numbered(pages.select("page_id", "url", "html"))
        kept = _responses(pages, least)
    else:
        pages = pages.withColumn(ROW, F.lit(0))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    records = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("size"),
        F.sha1(payload).alias("digest"),
        F.col(ROW).cast("long").alias("row"),
    )
    chosen = F.col("kept.page_id").eqNullSafe(F.col("page_id")) & (F.col("kept.row") == F.col("row"))
    revisit = F.col("kept").isNotNull() & ~chosen
    decided = records.join(kept, ["digest", "size"], "left").select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("html"),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"),
        "size",
        "digest",
        F.when(revisit, F.col("kept.page_id")).alias("refers_to"),
    )
    folder = new_path(spark, "warc")
    return staged(decided.mapInArrow(_writer(folder, level), INDEX), "warc-index")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(file, neighbouring records as (offset, length)) of sorted index rows."""
    file, run = None, []
    for batch in batches:
        for f, o, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if run and (
                f != file
                or o > run[-1][0] + run[-1][1] + GAP
                or o + n - run[0][0] > MOST_BYTES
            ):
                yield file, run
                run = []
            file = f
            run.append((o, n))
    if run:
        yield file, run


def _reader(columns: list[str], schema: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for file, run in _ranges(batches):
            if file != name:
                fs, path = file_system(file)
                name, source = file, fs.open_input_file(path)
            first = run[0][0]
            data = source.read_at(run[-1][0] + run[-1][1] - first, first)
            rows = [parse_record(zlib.decompress(data[o - first : o - first + n], 31)) for o, n in run]
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in rows], schema)

    return read


def read_archives(index: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The records that ``index`` selects, one row a record; ``columns`` of ``RECORD``."""
    columns = columns or [f.strip().split()[0] for f in RECORD.split(",")]
    kinds = dict(f.strip().split() for f in RECORD.split(","))
    arrow = {"long": pa.int64(), "string": pa.string()}
    stripe = F.floor(F.col("offset") / STRIPE)
    size = index.agg(F.sum("length")).first()[0] or 0
    ordered = (
        index.select("file", "offset", "length", stripe.alias("stripe"))
        .repartition(max(1, math.ceil(size / STRIPE)), "file", "stripe")
        .sortWithinPartitions("file", "offset")
        .drop("stripe")
    )
    return ordered.mapInArrow(
        _reader(columns, pa.schema([(c, arrow[kinds[c]]) for c in columns])),
        ", ".join(f"{c} {kinds[c]}" for c in columns),
    )


def op9_warc_index_first(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives and reads every record back through the index."""
    return read_archives(
        write_archives(pages), ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    )
