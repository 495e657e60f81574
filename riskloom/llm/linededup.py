"""Line dedup with two Bloom filters.

Pass 1 reads every line once. Each task keeps two bit sets over its line hashes, *once* and
*twice*; a line hash counts once per document. The sets are merged segment by segment (a shuffle
of bit words, not of lines): ``once = o1 | o2`` and ``twice = t1 | t2 | (o1 & o2)``.
Pass 2 shuffles only lines whose hash is in *twice*: (line digest, document) pairs, counted
exactly by a 128-bit digest of the whole key, which also gives the document that keeps its lines.
Pass 3 rewrites the documents that hold a repeated line and passes the others on.

The filter has ``BITS_PER_LINE`` bits a line up to ``MAX_FILTER_BITS``. Beyond that it fills up and
lets more lines through to the exact count: the shuffle grows, the result stays the same.

Defined results: a NULL or empty text is one empty line; keys shorter than ``min_chars`` code
points never count; several lines of one document with one key count once and stay or go together;
rows that share a doc_id are one document; a row with NULL doc_id belongs to no document, so its
lines neither count nor go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, small_batches, stage

BITS_PER_LINE = 12
MIN_FILTER_BITS, MAX_FILTER_BITS = 1 << 20, 1 << 28
SEGMENT_BYTES = 1 << 14
BLANK = " \t\n\x0b\x0c\r"
BIT = np.array([128, 64, 32, 16, 8, 4, 2, 1], np.uint8)


def long_keys(text: str | None, min_chars: int) -> list[bytes]:
    """Keys of the lines of at least ``min_chars`` code points, in line order."""
    return [s.encode("utf-8", "surrogatepass").lower() for x in (text or "").split("\n")
            if len(s := x.strip(BLANK)) >= min_chars]


def probes(digests: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two filter positions of 64-bit hashes; ``bits`` is a power of two."""
    mask = np.uint64(bits - 1)
    return digests & mask, (digests >> np.uint64(32)) * np.uint64(0x9E3779B1) & mask


def _filter_words(bits: int, min_chars: int):
    """Task of pass 1: the non-empty segments of its two bit sets."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for part in parts:
            for text in part.column("text"):
                keys = set(long_keys(text.as_py(), min_chars))
                if not keys:
                    continue
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
                at = np.unique(np.concatenate(probes(h, bits)))
                byte, bit = (at >> np.uint64(3)).astype(np.int64), BIT[(at & np.uint64(7)).astype(np.int64)]
                np.bitwise_or.at(twice, byte, once[byte] & bit)
                np.bitwise_or.at(once, byte, bit)
        for k in range(0, once.size, SEGMENT_BYTES):
            o, t = once[k:k + SEGMENT_BYTES], twice[k:k + SEGMENT_BYTES]
            if o.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // SEGMENT_BYTES], pa.int32()), pa.array([o.tobytes()], pa.binary()), pa.array([t.tobytes()], pa.binary())], ["segment", "once", "twice"])

    return run


def _merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of one number come one after another; only the current one is held."""
    number, once, twice = None, None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["segment", "twice"])

    for part in parts:
        for n, o, t in zip(*(part.column(c).to_pylist() for c in ("segment", "once", "twice"))):
            o, t = np.frombuffer(o, np.uint8), np.frombuffer(t, np.uint8)
            if n == number:
                twice, once = twice | t | (once & o), once | o
                continue
            if number is not None and twice.any():
                yield row()
            number, once, twice = n, o, t
    if number is not None and twice.any():
        yield row()


def twice_filter(docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The merged *twice* filter, one byte per 8 bits: at most MAX_FILTER_BITS / 8 bytes."""
    rows = (docs.mapInArrow(_filter_words(bits, min_chars), "segment int, once binary, twice binary")
            .repartition("segment").sortWithinPartitions("segment")
            .mapInArrow(_merge, "segment int, twice binary").collect())
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["segment"] * SEGMENT_BYTES:][:SEGMENT_BYTES] = np.frombuffer(r["twice"], np.uint8)
    return out


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """line (128-bit digest), n_docs, keeper (largest doc_id): the keys of at least ``min_docs`` documents."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text").filter("doc_id is not null and length(text) >= %d" % min_chars)
    lines = docs.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, 1 << int(lines * BITS_PER_LINE).bit_length()))
    seen = spark.sparkContext.broadcast(twice_filter(docs.select("text"), min_chars, bits))

    def suspects(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = seen.value
        for part in parts:
            ids, out = [], []
            for i, t in zip(part.column("doc_id").to_pylist(), part.column("text")):
                keys = list(set(long_keys(t.as_py(), min_chars)))
                if not keys:
                    continue
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
                hit = np.ones(len(keys), bool)
                for p in probes(h, bits):
                    hit &= (have[(p >> np.uint64(3)).astype(np.int64)] & BIT[(p & np.uint64(7)).astype(np.int64)]) > 0
                for j in np.flatnonzero(hit):
                    ids.append(i)
                    out.append(xxhash.xxh3_128_digest(keys[j]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(ids, pa.int64())], ["line", "doc_id"])

    pairs = docs.mapInArrow(suspects, "line binary, doc_id long")
    return (pairs.groupBy("line", "doc_id").agg(F.lit(1).alias("one"))
            .groupBy("line").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
            .filter(F.col("n_docs") >= min_docs))


def _line_table(min_chars: int):
    """line, doc_id for each long line key of a document, once a document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, out = [], []
            for i, t in zip(part.column("doc_id").to_pylist(), part.column("text")):
                for d in {xxhash.xxh3_128_digest(k) for k in long_keys(t.as_py(), min_chars)}:
                    ids.append(i)
                    out.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(ids, pa.int64())], ["line", "doc_id"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Every column of ``docs``, text without the repeated lines, n_lines (before) and n_dropped.

    A text that is NULL stays NULL. Columns named n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    found = stage(repeated_lines(docs, min_chars, min_docs), "repeated_lines")
    n = found.count()
    schema = docs.select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    if n * 120 <= BROADCAST_BYTES:  # a bounded table: digest -> keeper
        table = spark.sparkContext.broadcast({r["line"]: r["keeper"] for r in found.select("line", "keeper").collect()})

        def drop(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keepers = table.value
            for part in parts:
                yield _rewrite(part, min_chars, lambda i, _, d: keepers.get(d, i) != i)

        return docs.mapInArrow(drop, schema)
    # too many repeated lines to hold in a task: give each document the list of its own
    own = (docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(_line_table(min_chars), "line binary, doc_id long")
           .join(found, "line").filter("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set("line").alias("_gone")))
    joined = docs.join(own, "doc_id", "left").select(*docs.columns, "_gone")

    def drop_listed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            gone = [set(x or ()) for x in part.column("_gone").to_pylist()]
            yield _rewrite(part.drop_columns(["_gone"]), min_chars, lambda _, k, d: d in gone[k])

    return joined.mapInArrow(drop_listed, schema)


def _rewrite(part: pa.RecordBatch, min_chars: int, goes) -> pa.RecordBatch:
    """The batch with lines dropped where ``goes(doc_id, row, digest)``, and the two counts."""
    texts, totals, dropped = [], [], []
    for k, (i, t) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("text"))):
        t = t.as_py()
        lines = (t or "").split("\n")
        kept = lines if i is None else [
            x for x in lines if len(s := x.strip(BLANK)) < min_chars or not goes(i, k, xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass").lower()))]
        totals.append(len(lines))
        dropped.append(len(lines) - len(kept))
        texts.append(t if len(kept) == len(lines) else "\n".join(kept))
    arrays = [pa.array(texts, pa.string()) if n == "text" else part.column(n) for n in part.schema.names]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], [*part.schema.names, "n_lines", "n_dropped"])


def op3_line_dedup(spark, sf_dir):
    """Contract digest of the deduplicated texts of all documents."""
    from .common import read

    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, x.i AS i, x.line AS line,
         translate(trim(x.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_transform(range(1, len(s) + 1), lambda j: {'i': j, 'line': s[j]})) AS x
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, h.k IS NOT NULL AND l.doc_id <> h.keeper AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
