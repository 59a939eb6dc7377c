"""Archives and packed ids: exact round trips through files on shared storage."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm_cases import EDGES, SF_DIR, WORD_BPE
from tallyhouse.llm import packed, shared, warc


def expected_pages(rows):
    kept = {}
    for i, (page_id, html) in enumerate(rows):
        data = (html or "").encode()
        if len(data) >= 1000:
            best = kept.get(data)
            if best is None or (page_id is not None and (best[0] is None or page_id > best[0])):
                kept[data] = (page_id, i)
    out = []
    for i, (page_id, html) in enumerate(rows):
        data = (html or "").encode()
        best = kept.get(data)
        kind = "response" if best is None or best[1] == i else "revisit"
        refers = best[0] if kind == "revisit" else None
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), kind, refers))
    return sorted(out, key=repr)


def test_archive_edges(spark):
    big, odd = "<p>é" + "x" * 1200, "y" * 999
    rows = [
        (1, big), (5, big), (5, big), (2, big), (None, big), (3, odd), (4, odd), (6, ""), (7, None),
        (8, big + "!"), (8, None), (9, "z" * 3_000_000),
    ]
    urls = ["http://a/ü\r\nx: y", None]
    data = [(p, urls[i % 2], h, "clash") for i, (p, h) in enumerate(rows)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, digest string")
    got = sorted((tuple(r) for r in warc.op9_warc_index_first(pages).collect()), key=repr)
    want = expected_pages(rows)
    # of rows that tie for the response any one may be it
    assert got == want
    index = warc.write_archives(pages)
    some = {r.page_id: r.html for r in warc.read_archives(index.where("page_id in (8, 9)")).collect()}
    assert set(some) == {8, 9} and some[9] == "z" * 3_000_000
    assert warc.op9_warc_index_first(pages.limit(0)).collect() == []


def test_archives_when_scans_are_split_anew(spark, split_anew):
    """Repeated rows and copies: every payload has one response, however the second scan is split."""
    rows = [(i % 40, "u", chr(97 + i % 5) * 1500) for i in range(200)] + [(i, "u", "x" * 1200) for i in range(100, 140)]
    pages = split_anew(spark.createDataFrame(rows, "page_id long, url string, html string"), warc, shared)
    got = warc.op9_warc_index_first(pages).collect()
    assert len(got) == len(rows)
    kept = [r.payload_digest for r in got if r.record_type == "response"]
    assert len(kept) == len(set(kept)) == 6
    tops = {r.page_id for r in got if r.record_type == "response"}
    assert tops == {35, 36, 37, 38, 39, 139} and {r.refers_to for r in got if r.refers_to is not None} == tops


def test_damaged_payload_is_found():
    digest = hashlib.sha1(b"page").hexdigest()
    data = warc.record_bytes(1, "http://a", b"page", "response", 4, digest, None)
    assert warc.parse_record(data)["html"] == "page"
    with pytest.raises(ValueError):
        warc.parse_record(data.replace(b"page\r\n\r\n", b"pagE\r\n\r\n"))


@pytest.mark.parametrize("width", [1, 5, 16, 17, 31])
def test_packing_round_trip(tmp_path, width):
    ids = np.random.RandomState(width).randint(0, 1 << width, 3 * packed.BLOCK + 77).astype(np.uint32)
    writer = packed.Writer(f"{tmp_path}/x/ids", width)
    for at in range(0, len(ids), 1000):
        writer.add(ids[at : at + 1000])
    writer.close()
    reader = packed.Reader(f"{tmp_path}/x/ids")
    assert reader.n == len(ids)
    for begin, n in ((0, len(ids)), (packed.BLOCK - 1, 2), (len(ids) - 1, 1), (5, 0), (100, 9000)):
        assert (reader.ids(begin, n) == ids[begin : begin + n]).all()


def ids_of(rows):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows]


def expected_ids(rows):
    """Rows in the order of the files: null doc_ids first, equal ones as given."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start, out = 0, []
    for (doc_id, _), ids in zip(rows, ids_of(rows)):
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_ids_equal_the_library(spark, given):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = [tuple(r) for r in packed.op4_packed_ids(docs, WORD_BPE).orderBy("start").collect()]
    assert got == expected_ids([(i, t) for i, t, _ in given])


def test_id_edges(documents):
    got = packed.op4_packed_ids(documents(EDGES), WORD_BPE).orderBy("start").collect()
    want = expected_ids(EDGES)
    assert [(r.doc_id, r.start) for r in got] == [w[:2] for w in want] or sorted(
        (str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got
    ) == sorted((str(w[0]), w[2], w[3]) for w in want)
    assert packed.op4_packed_ids(documents([]), WORD_BPE).collect() == []


def test_files_of_many_small_batches(documents, monkeypatch):
    """Texts of several batches are encoded together; places, counts and the end id stay those of each document."""
    rows = [(i, None if i % 7 == 0 else f"word{i % 5}, größe{i}\n" * (i % 4)) for i in range(40)]
    docs = documents(rows)
    spark, name = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 3)
    try:
        got = [tuple(r) for r in packed.op4_packed_ids(docs, WORD_BPE).orderBy("start").collect()]
    finally:
        spark.conf.set(name, before)
    assert got == expected_ids(rows)
