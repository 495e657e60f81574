"""Exact-by-bound nearest neighbours with a block matrix join.

Queries and candidates are dealt into blocks; a tile is one block of each. In a tile the unit
vectors are quantised to int8 and multiplied as one matrix product. Each product carries an error
bound from the two quantisation errors (Cauchy-Schwarz), so that a candidate whose upper bound is
below the k-th best lower bound of its query can't be among the k nearest of the tile. The pairs that
survive are computed again on the original vectors in double precision, and a heap per query keeps
the k nearest. Heaps of the tiles are merged per query.

Int8 products are summed in float32 matrix products over at most ``EXACT_DIMS`` dimensions at a time,
where every partial sum is an integer below 2^24 and therefore exact.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components take no
part, nor do rows with NULL vec_id; vectors of other lengths than the query's are no candidates;
several rows of one vec_id count as one candidate with its best score (and as one query with the best
score of any of its vectors).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, read, stage

QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
EXACT_DIMS = 1024
#: Slack for the rounding of the bounds themselves.
ROUNDING = 1e-5


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the norm of each row's error and of each quantised row."""
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt(((unit - back) ** 2).sum(axis=1)), np.sqrt((back ** 2).sum(axis=1))


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, as float64."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, k:k + EXACT_DIMS].astype(np.float32) @ b[:, k:k + EXACT_DIMS].astype(np.float32).T
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products in double precision, summed from the first component to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def nearest_in_tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, cosine) of the k nearest candidates of each query, ties to the smaller id.

    q and c: double-precision rows, none of them zero or non-finite.
    """
    qn, cn = np.sqrt(dots(q, q)), np.sqrt(dots(c, c))
    qi, qs, qe, _ = quantise(q / qn[:, None])
    ci, cs, ce, cb = quantise(c / cn[:, None])
    out: dict[int, dict[int, float]] = {}
    by_id = np.argsort(c_ids, kind="stable")  # ids may repeat: a k-th place of rows isn't one of ids
    _, first_of = np.unique(c_ids[by_id], return_index=True)
    ids = len(first_of)
    for at in range(0, len(q), 256):  # 256 rows of bounds at a time
        rows = slice(at, at + 256)
        rough = int8_products(qi[rows], ci) * qs[rows, None] * cs
        # u.v - u'.v' = u.(v - v') + (u - u').v', and |u| = 1
        bound = ce[None, :] + qe[rows, None] * cb[None, :] + ROUNDING
        own = q_ids[rows, None] == c_ids[None, :]
        low = np.where(own, -np.inf, rough - bound)
        if ids < len(c_ids):
            low = np.maximum.reduceat(low[:, by_id], first_of, axis=1)
        kth = np.partition(low, -k, axis=1)[:, -k] if ids >= k else np.full(low.shape[0], -np.inf)
        i, j = np.nonzero((rough + bound >= kth[:, None]) & ~own)
        for s in range(0, len(i), 1 << 16):  # survivors: exact, 65,536 pairs at a time
            a, b = i[s:s + (1 << 16)] + at, j[s:s + (1 << 16)]
            score = dots(q[a], c[b]) / (qn[a] * cn[b])
            order = np.lexsort((c_ids[b], -score, q_ids[a]))
            who = q_ids[a][order]
            first = np.searchsorted(who, who, side="left")
            # only the best of this slice can matter; with repeated ids all are looked at
            keep = order if ids != len(c_ids) else order[np.arange(len(order)) - first < k]
            for x, y, v in zip(q_ids[a[keep]].tolist(), c_ids[b[keep]].tolist(), score[keep].tolist()):
                best = out.setdefault(x, {})
                if v > best.get(y, -np.inf):
                    best[y] = v
    return [(x, y, v) for x, best in out.items() for y, v in heapq.nsmallest(k, best.items(), key=lambda e: (-e[1], e[0]))]


def _usable(part: pa.RecordBatch) -> list[tuple]:
    """(vec_id, length, vector as bytes of doubles) of the rows that take part."""
    rows = []
    for i, v in zip(part.column("vec_id").to_pylist(), part.column("embedding")):
        if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all() and x.any() and np.isfinite(x @ x) and x @ x > 0:
            rows.append((i, len(x), x.tobytes()))
    return rows


def _vector_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows = list(zip(*_usable(part))) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], ["vec_id", "dim", "vector"])


def _tile_task(k: int):
    """Rows come by (dim, q, c); one tile is held at a time."""

    def solve(rows):
        side = [[r for r in rows if r[2] == x] for x in (True, False)]
        if not side[0] or not side[1]:
            return None
        (qi, qv), (ci, cv) = ((np.array([r[0] for r in s]), np.frombuffer(b"".join(r[1] for r in s), np.float64).reshape(len(s), -1)) for s in side)
        found = list(zip(*nearest_in_tile(qi, qv, ci, cv, k))) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []
        for part in parts:
            for *key, i, v, query in zip(*(part.column(c).to_pylist() for c in ("dim", "q", "c", "vec_id", "vector", "is_query"))):
                if key != tile:
                    if rows and (out := solve(rows)) is not None:
                        yield out
                    tile, rows = key, []
                rows.append((i, v, query))
        if rows and (out := solve(rows)) is not None:
            yield out

    return run


def _merge_task(k: int):
    """Merge the tiles' heaps: rows come by query_id; one heap is held at a time."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(x, best):
            top = heapq.nsmallest(k, best.items(), key=lambda e: (-e[1], e[0]))
            return [(x, r, y, v) for r, (y, v) in enumerate(top, 1)]

        now, best = None, {}
        for part in parts:
            out = []
            for x, y, v in zip(*(part.column(c).to_pylist() for c in ("query_id", "vec_id", "score"))):
                if x != now:
                    out += result(now, best) if best else []
                    now, best = x, {}
                if v > best.get(y, -np.inf):
                    best[y] = v
                if len(best) > 64 * k:
                    best = dict(heapq.nsmallest(k, best.items(), key=lambda e: (-e[1], e[0])))
            if out:
                yield _ranked(out)
        if best:
            yield _ranked(result(now, best))

    return run


def _ranked(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["query_id", "rank", "vec_id", "score"])


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of largest cosine for each query.

    Both sides: vec_id long, embedding array of float or double. A query's own vec_id is no candidate.
    Each side is copied once for each block of the other, and hashes of (vec_id, vector) deal both, so
    tiles are of even size whatever the vectors are.
    """
    def clean(df):
        return stage(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_vector_task, "vec_id long, dim int, vector binary").distinct(), "vectors")

    qs, cs = clean(queries), clean(candidates)
    nq, nc = blocks(qs.count(), query_block), blocks(cs.count(), candidate_block)
    q = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(nq)).cast("int")
    c = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(nc)).cast("int")
    left = qs.withColumn("q", q).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(nc - 1)))).withColumn("is_query", F.lit(True))
    right = cs.withColumn("c", c).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("is_query", F.lit(False))
    cols = ["dim", "q", "c", "vec_id", "vector", "is_query"]
    tiles = (left.select(cols).unionByName(right.select(cols)).repartition("dim", "q", "c").sortWithinPartitions("dim", "q", "c")
             .mapInArrow(_tile_task(k), "query_id long, vec_id long, score double"))
    return (tiles.repartition("query_id").sortWithinPartitions("query_id")
            .mapInArrow(_merge_task(k), "query_id long, rank int, vec_id long, score double"))


def op1_ann(spark, sf_dir):
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows.filter("vec_id % 50 = 0"), rows, k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (SELECT vec_id, e, list_inner_product(e, e) AS s FROM v),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) / (sqrt(q.s) * sqrt(c.s)) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.s > 0 AND c.s > 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
