"""WARC archives written and read by Spark tasks as chunked records.

``write_warc`` puts a record for each page into gzip members of one file a task, streaming the
payload from the Arrow buffer in slices. A file counts only once its task's manifest row is there,
so a task that is run again leaves at most an unlisted file. ``read_warc`` gives a table of chunks:
record identifier, chunk number, the chunk's bytes, and the byte count and SHA-256 digest carried so
far; a payload of any length passes through one buffer of ``chunk_bytes``.

Of records with equal payloads of at least ``min_revisit_bytes``, that with the smallest page_id is a
response and the others are revisits: HTTP headers without the payload, its digest and length, and
the response they refer to.

Files are opened with ``pyarrow.fs`` from the shared folder's URI (local, HDFS, S3, GCS).

Defined results: a NULL payload is empty; a row with NULL page_id is always a response; rows with one
page_id and one payload are records of one type; a NULL url has no target line, control characters
in a url are percent-encoded.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, read, small_batches, small_side, stage

CHUNK_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = ("file string, record_id string, page_id long, url string, record_type string, refers_to long, chunk_no int, "
          "chunk binary, bytes_so_far long, digest_so_far string, last boolean")
MANIFEST = "file string, n_records long, n_bytes long"


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def record_head(page_id: int | None, url: str | None, digest: str, length: int, refers_to: int | None, date: str = DATE) -> bytes:
    """WARC and HTTP headers of a record, up to where the payload begins."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
             f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response",
             f"Content-Length: {len(http) + (length if refers_to is None else 0)}"]
    if url is not None:
        lines.insert(3, "WARC-Target-URI: " + "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _write_task(folder: str, chunk_bytes: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _files(folder)
        name, out, n, size = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for part in parts:
            if part.num_rows and out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            ids, urls, digests, firsts = (part.column(c).to_pylist() for c in ("page_id", "url", "digest", "first_id"))
            for i, url, digest, first, html in zip(ids, urls, digests, firsts, part.column("html")):
                payload = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
                refers_to = first if i is not None and first is not None and first != i else None
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                pieces = [record_head(i, url, digest, len(payload), refers_to)]
                if refers_to is None:
                    pieces += [payload[k:k + chunk_bytes] for k in range(0, len(payload), chunk_bytes)]
                for piece in (*pieces, b"\r\n\r\n"):
                    data = pack.compress(piece)
                    if data:
                        out.write(data)
                        size += len(data)
                data = pack.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "n_records", "n_bytes"])

    return run


def write_warc(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 100, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives below ``folder``; the manifest: file, n_records, n_bytes."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    first = stage(rows.filter((F.col("n") >= min_revisit_bytes) & F.col("page_id").isNotNull()).groupBy("digest")
                  .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "first_payloads")
    planned = rows.join(small_side(first, first.count(), 96), "digest", "left").select("page_id", "url", "html", "digest", "first_id")
    return stage(planned.mapInArrow(_write_task(folder, chunk_bytes), MANIFEST), "warc_manifest")


def _fields(block: Iterator[bytes]) -> dict[str, str]:
    out = {}
    for line in block:
        if line in (b"\r\n", b"\n", b""):
            break
        k, _, v = line.decode("utf-8", "replace").partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def chunks_of(stream, file: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of CHUNKS from an open archive, holding one chunk at a time."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # the blank lines between records
        head = _fields(iter(stream.readline, b""))
        left = int(head["content-length"])
        http, size = {}, 0
        for x in iter(stream.readline, b""):
            size += len(x)
            if x == b"\r\n":
                break
            k, _, v = x.decode("latin-1").partition(":")
            http[k.strip().lower()] = v.strip()
        left -= size
        record, target = head["warc-record-id"].strip("<>"), head.get("warc-target-uri")
        base = (file, record, _page(record), target, head["warc-type"], _page(head.get("warc-refers-to")))
        if head["warc-type"] == "revisit":
            yield (*base, 0, b"", int(http["content-length"]), head["warc-payload-digest"].partition(":")[2], True)
            continue
        digest, done, k = hashlib.sha256(), 0, 0
        while True:
            chunk = stream.read(min(chunk_bytes, left))
            if len(chunk) < min(chunk_bytes, left):
                raise ValueError(f"{file}: {record} ends early")
            digest.update(chunk)
            done, left = done + len(chunk), left - len(chunk)
            so_far = digest.hexdigest()
            if not left and so_far != head["warc-payload-digest"].partition(":")[2]:
                raise ValueError(f"{file}: {record} does not have its digest")
            yield (*base, k, chunk, done, so_far, not left)
            k += 1
            if not left:
                break


def _read_task(chunk_bytes: int, batch_bytes: int = 4 << 20):
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file in part.column("file").to_pylist():
                fs, path = _files(file)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as unpacked:
                    for row in chunks_of(io.BufferedReader(unpacked, 1 << 16), file, chunk_bytes):
                        rows.append(row)
                        held += len(row[7]) + 200
                        if held >= batch_bytes:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_warc(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table (CHUNKS) of the archives that ``manifest`` lists, a file a task."""
    small_batches(manifest.sparkSession)
    n = manifest.count()
    return manifest.select("file").repartition(max(1, min(n, 20_000))).mapInArrow(_read_task(chunk_bytes), CHUNKS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to WARC archives, read them back: a row for each record's last chunk."""
    chunks = read_warc(write_warc(read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return chunks.filter("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"),
                                        F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id <> page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
