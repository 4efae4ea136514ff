import base64
import hashlib

import pytest

from halyard.llm import warc


def test_pages_without_ids_share_a_payload(spark):
    rows = [(None, "a", "<p>x</p>"), (None, "b", "<p>x</p>"), (None, "c", None), (None, "d", ""), (None, "e", "once"), (1, "f", "once more")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(warc.shared_dir(spark, "warc"))
    manifests = warc.write_archive(pages, folder)
    assert sum(r.records for r in manifests["payloads"].collect()) == 4
    out = warc.read_archive(spark, folder, manifests, payloads=True).collect()
    assert len(out) == 6 and sorted(bytes(r.payload).decode() for r in out) == sorted(h or "" for _, _, h in rows)
    assert all(r.record_type == "response" for r in out)


def test_records_come_back_byte_for_byte(spark):
    rows = [(1, "http://a/b  c", "<p>a</p>"), (2, "v\r\nx: y", "<p>a</p>"), (3, None, ""), (4, "é", "日本" * 700_000), (4, "other", "same id, other page"), (None, "n", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(warc.shared_dir(spark, "warc"))
    manifests = warc.write_archive(pages, folder)
    heads = {(r.page_id, r.sha256): r for r in warc.read_archive(spark, folder, manifests).collect()}
    got = sorted(bytes(r.record) for r in warc.rebuild_records(spark, folder, manifests).collect())
    want = []
    for i, url, html in rows:
        raw = html.encode()
        r = heads[i, hashlib.sha256(raw).hexdigest()]
        head = warc.header_block(i, url, r.record_type, r.refers_to, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), r.sha256)
        want.append(head + (b"" if r.record_type == "revisit" else raw) + b"\r\n\r\n")
    assert got == sorted(want)
    for record in got:
        h, body = warc.parse_headers(record), record.split(b"\r\n\r\n", 1)[1]
        assert record.startswith(b"WARC/1.1\r\n") and len(body) == int(h["Content-Length"]) + 4


def test_equal_ids_of_different_pages(spark):
    rows = [(9, "a", "one"), (9, "b", "two"), (8, "c", "one"), (8, "d", "one")]
    out = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in out) == [(8, 3, "revisit", 9), (8, 3, "revisit", 9), (9, 3, "response", 0), (9, 3, "response", 0)]


def test_cut_files_are_errors():
    blob = warc._member(b"abc" * 5000) + warc._member(b"x")
    assert list(warc._records(blob)) == [b"abc" * 5000, b"x"]
    with pytest.raises(ValueError):
        list(warc._records(blob[:-3]))
