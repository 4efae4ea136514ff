"""A content-addressed WARC archive.

Payload bytes are stored once for each distinct payload, in `resource` records addressed by the payload's SHA-256,
which is computed anew and compared on reading. The exact header block of every record is stored apart, in
header-only records, so a revisit costs a few hundred bytes. Original records come back by joining the two on the
digest. Both kinds of file are series of gzip members, one for each record, as WARC files are.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm._common import materialise, shared_dir
from halyard.llm.files import put, read_files

#: A task closes a file at so many bytes.
FILE_BYTES = 32 << 20
#: Every record carries this date: the pages table has none, and reruns give the same bytes.
DATE = "1970-01-01T00:00:00Z"


def _member(block: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(block) + z.flush()


def _clean(value: str | None) -> str:
    """A header value on one line: line breaks as URLs write them, all else as it is."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def header_block(page_id: int | None, url: str | None, record_type: str, refers_to: int | None, size: int, sha1: str, sha256: str) -> bytes:
    """The WARC header of a page's record, up to and with its blank line."""
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-SHA256: {sha256}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8"]
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {0 if record_type == 'revisit' else size}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _write(folder: str, kind: str):
    """Writes records of Arrow batches into files; yields the names of the files written and their records."""

    def run(batches):
        parts, held, n = [], 0, 0

        def close():
            name = put(folder, kind, b"".join(parts))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "records"])

        for batch in batches:
            for row in batch.to_pylist():
                if kind == "payloads":
                    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:{row['sha256']}>\r\nWARC-Date: {DATE}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(row['payload'])}\r\n\r\n".encode()
                    parts.append(_member(head + row["payload"] + b"\r\n\r\n"))
                else:
                    parts.append(_member(header_block(row["page_id"], row["url"], row["record_type"], row["refers_to"], row["size"], row["sha1"], row["sha256"]) + b"\r\n\r\n"))
                held, n = held + len(parts[-1]), n + 1
                if held >= FILE_BYTES:
                    yield close()
                    parts, held, n = [], 0, 0
        if parts:
            yield close()

    return run


def _records(blob: bytes):
    """The unpacked blocks of a file's gzip members.

    A member is fed piece by piece, so what lies behind it is looked at, and copied, by a piece only.
    """
    view, at = memoryview(blob), 0
    while at < len(view):
        z, parts, step = zlib.decompressobj(31), [], 2048
        while not z.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise ValueError("an archive file ends within a record")
            parts.append(z.decompress(piece))
            at, step = at + len(piece) - len(z.unused_data), min(4 * step, 1 << 20)
        yield parts[0] if len(parts) == 1 else b"".join(parts)


def parse_headers(block: bytes) -> dict[str, str]:
    lines = block.split(b"\r\n\r\n", 1)[0].decode().split("\r\n")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])


def _read_headers(batches):
    names = ["page_id", "record_type", "refers_to", "size", "sha1", "sha256", "header"]
    for batch in batches:
        for blob in batch.column(1):
            out = {k: [] for k in names}
            for block in _records(blob.as_py()):
                h = parse_headers(block)
                number = lambda v: int(x) if (x := v[len("<urn:page:") : -1]) else None
                for k, v in zip(names, (number(h["WARC-Record-ID"]), h["WARC-Type"], number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:], h["X-Payload-SHA256"], block[:-4]), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["page_id"], pa.int64()), pa.array(out["record_type"], pa.string()), pa.array(out["refers_to"], pa.int64()), pa.array(out["size"], pa.int64()), pa.array(out["sha1"], pa.string()), pa.array(out["sha256"], pa.string()), pa.array(out["header"], pa.binary())], names)


def _read_payloads(keep: bool):
    def run(batches):
        for batch in batches:
            for blob in batch.column(1):
                rows = []
                for block in _records(blob.as_py()):
                    head, rest = block.split(b"\r\n\r\n", 1)
                    h = parse_headers(head + b"\r\n\r\n")
                    payload = rest[: int(h["Content-Length"])]
                    sha256 = hashlib.sha256(payload).hexdigest()
                    if h["WARC-Record-ID"] != f"<urn:sha256:{sha256}>" or rest[len(payload) :] != b"\r\n\r\n":
                        raise ValueError(f"payload {h['WARC-Record-ID']} doesn't match its digest")
                    rows.append((sha256, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), payload if keep else None))
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary())], ["sha256", "payload_bytes", "payload_digest", "payload"])

    return run


def _digests(batches):
    for batch in batches:
        raw = [v.as_py() for v in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in raw], pa.int64()), pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in raw]), pa.array([hashlib.sha256(x).hexdigest() for x in raw])], ["page_id", "url", "size", "sha1", "sha256"])


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0) -> dict[str, DataFrame]:
    """Writes one record for each row of pages(page_id, url, html) and returns the manifests of the files written.

    Of the records of one payload of at least least_bytes, that with the largest page_id is the response and the
    others revisit it; smaller payloads are all responses. A null html is an empty payload; a null page_id ranks
    below all others; repeated rows of the largest page_id are all responses, with one stored payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    headers = materialise(rows.mapInArrow(_digests, "page_id long, url string, size long, sha1 string, sha256 string"), "digests")
    # Written before it meets the records: a payload with very many records is then split over tasks by adaptive execution.
    only = materialise(headers.groupBy("sha256").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")), "payloads")
    typed = headers.join(only, "sha256")
    revisit = (F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("last"))
    typed = typed.select("page_id", "url", "size", "sha1", "sha256", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"))
    # One row of the table stands for each payload; its bytes are read again, not shuffled.
    keys = rows.select("page_id", "payload", F.sha2("payload", 256).alias("sha256"))
    repeated = only.where("n > 1").select("sha256", F.col("last").alias("stands"), F.lit(True).alias("again"))
    # Payloads of one record need no join; of repeated ones, the rows with the largest page_id go on (null, if no page has one).
    marked = keys.join(repeated if repeated.count() > BROADCAST_DIGESTS else F.broadcast(repeated), "sha256", "left").where("again IS NULL OR page_id <=> stands")
    first = marked.where("again IS NULL").select("sha256", "payload").union(marked.where("again").groupBy("sha256").agg(F.min("payload").alias("payload")))
    return {
        "payloads": materialise(first.mapInArrow(_write(folder + "/payloads", "payloads"), "name string, records long"), "manifest"),
        "headers": materialise(typed.mapInArrow(_write(folder + "/headers", "headers"), "name string, records long"), "manifest"),
    }


#: Digests of repeated payloads are broadcast up to this many (about 100 bytes each).
BROADCAST_DIGESTS = 100_000


def _files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    return read_files(spark, folder).join(manifest.select("name"), "name", "left_semi")


def read_archive(spark: SparkSession, folder: str, manifests: dict[str, DataFrame], payloads: bool = False) -> DataFrame:
    """The archive's records: header fields, the exact header block, and length and SHA-1 of the verified payload.

    With payloads, the payload bytes come along, so `header` and `payload` are the record as it was.
    """
    heads = _files(spark, f"{folder}/headers", manifests["headers"]).mapInArrow(_read_headers, "page_id long, record_type string, refers_to long, size long, sha1 string, sha256 string, header binary")
    bodies = _files(spark, f"{folder}/payloads", manifests["payloads"]).mapInArrow(_read_payloads(payloads), "sha256 string, payload_bytes long, payload_digest string, payload binary")
    return heads.join(bodies if payloads else bodies.drop("payload"), "sha256")


def rebuild_records(spark: SparkSession, folder: str, manifests: dict[str, DataFrame]) -> DataFrame:
    """(page_id, record): every record's bytes as a WARC file holds them, its exact header block and its payload put together.

    A revisit has no body; its payload is that of the record it refers to.
    """
    end = F.lit(b"\r\n\r\n")
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return read_archive(spark, folder, manifests, payloads=True).select("page_id", F.concat("header", body, end).alias("record"))


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the archive into the shared folder, reads it back and returns one row per record.

    Columns: page_id, payload_bytes, payload_digest (upper-case base32 SHA-1, recomputed from the stored payload),
    record_type, refers_to. An empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    manifests = write_archive(pages, folder, least_bytes)
    return read_archive(spark, folder, manifests).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
