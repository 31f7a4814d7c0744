import base64
import hashlib
import io

import pytest
import zstandard
from symdex.llm import warc
from symdex.llm.registry import QUERIES

PAGES = [(1, "http://a.example/\r\nX: y", "<p>one</p>"), (2, "http://b.example/", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "é", "ünï🙂"), (5, "é", "ünï🙂"), (None, "n", "<p>one</p>"), (6, "big", "z" * 3_000_000), (7, "u", "<p>two</p>")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_pages_come_back(spark, folder):
    path = folder(pages=PAGES)
    rows = QUERIES["op4_warc_archives"](spark, path).collect()
    assert all(r["error"] is None for r in rows)
    winner = {}
    for p, _, html in PAGES:
        winner[html or ""] = max(winner.get(html or "", -1), -1 if p is None else p)
    wanted = [(p, len((h or "").encode()), digest(h), "response" if p == winner[h or ""] else "revisit", None if p == winner[h or ""] else winner[h or ""]) for p, _, h in PAGES]
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, wanted))


def archive_of(records, dictionary=b"", tail=b""):
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
    lead = warc.skippable_frame(warc.DICTIONARY_FRAME, dictionary) if dictionary else b""
    return lead + b"".join(coder.compress(r) + warc.SEPARATOR.encode() for r in records) + tail


def record(page, html, refers=None):
    return warc.encode_record(page, "http://x.example/", html.encode(), refers, refers is not None)


def test_archives_are_zstandard_streams(spark, tmp_path, folder):
    """Files as written decode with a plain reader that knows only the dictionary."""
    df = spark.read.parquet(folder(pages=PAGES) + "/pages.parquet").select("page_id", "url", "html")
    warc.archive(df, str(tmp_path / "w"), volume_bytes=2000)
    files = sorted((tmp_path / "w").rglob("part-*"))
    assert len(files) > 2
    whole = b""
    for f in files:
        data = f.read_bytes()
        found, start = warc.leading_dictionary(data)
        assert found and start > 8
        whole += zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(found)).stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == len(PAGES)
    assert warc.read_archives(spark, str(tmp_path / "w")).where("error is null").count() == len(PAGES)


@pytest.mark.parametrize("dictionary", [b"", b"<p>plain content as a dictionary</p>" * 20])
def test_an_archive_is_read_record_by_record(dictionary):
    data = archive_of([record(1, "<p>x</p>"), record(2, "<p>x</p>", 1)], dictionary)
    found = [r for _, r in warc.read_archive(data)]
    assert [(r.kind, warc.page_of(r.headers["warc-record-id"]), r.payload_bytes) for r in found] == [("response", 1, 8), ("revisit", 2, 8)]
    assert found[0].payload == b"<p>x</p>" and found[1].payload is None and found[1].digest == digest("<p>x</p>")


def test_without_the_dictionary_nothing_decodes():
    dictionary = zstandard.train_dictionary(2000, [f"sample text number {i} with much in common".encode() for i in range(500)]).as_bytes()
    data = archive_of([record(1, "sample text number 7 with much in common")], dictionary)
    assert [type(r) for _, r in warc.read_archive(data)] == [warc.Record]
    assert all(isinstance(r, warc.ArchiveError) for _, r in warc.read_archive(data[warc.frame_end(memoryview(data), 0) :]))


GOOD = record(1, "<p>x</p>")
BAD = {
    "version": GOOD.replace(b"WARC/1.1", b"WARC/9.9"),
    "no header end": b"WARC/1.1\r\nWARC-Type: response\r\n",
    "length": GOOD.replace(b"Content-Length: 8\r\n", b"Content-Length: 9\r\n"),
    "long tail": GOOD + b"x",
    "missing header": GOOD.replace(b"WARC-Date", b"X-Date"),
    "repeated header": GOOD.replace(b"WARC-Date: ", b"WARC-Type: response\r\nWARC-Date: "),
    "header": GOOD.replace(b"WARC-Date: ", b"WARC Date "),
    "id": GOOD.replace(b"<urn:x-page:1>", b"urn:x-page:1"),
    "payload": GOOD.replace(b"<p>x</p>", b"<p>y</p>"),
    "revisit of nothing": record(2, "a", 1).replace(b"WARC-Refers-To", b"X-Refers-To"),
}


@pytest.mark.parametrize("case", BAD)
def test_faults_are_told_and_the_next_record_is_read(case):
    found = [r for _, r in warc.read_archive(archive_of([BAD[case], GOOD]))]
    assert isinstance(found[0], warc.ArchiveError) and isinstance(found[1], warc.Record) and len(found) == 2


def test_a_broken_frame_costs_that_frame():
    data = bytearray(archive_of([GOOD, GOOD, GOOD]))
    at = warc.frame_end(memoryview(data), warc.frame_end(memoryview(data), 0))
    data[at + 20] ^= 0xFF
    found = [r for _, r in warc.read_archive(bytes(data))]
    assert isinstance(found[0], warc.Record) and isinstance(found[-1], warc.Record) and any(isinstance(r, warc.ArchiveError) for r in found)
    cut = [r for _, r in warc.read_archive(bytes(data[:at - 3]))]
    assert isinstance(cut[0], warc.Record)
    assert [r for _, r in warc.read_archive(b"")] == []
    assert isinstance(next(warc.read_archive(b"garbage that is no frame"))[1], warc.ArchiveError)


def test_records_below_the_least_size_are_all_responses(spark, folder):
    df = spark.read.parquet(folder(pages=PAGES) + "/pages.parquet").select("page_id", "url", "html")
    assert warc.plan_records(df, 11).where("revisit").count() == 0 and warc.plan_records(df, 10).where("revisit").count() == 2
