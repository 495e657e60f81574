"""Ranked lexical search: each item's best documents, term at a time with limited accumulators.

1. One pass over the texts counts each document's terms and the occurrences of the items' terms, and
   writes them as postings (numbers only). From these come the corpus figures: documents, terms, and the
   documents that hold each term.
2. Each task inverts blocks of at most ``BLOCK_DOCS`` documents and scores every item in a block, its
   rarest term first. An accumulator is made for every document a term meets, until the bounds of the terms
   left (weight times the largest impact in the block) together cannot reach the k-th partial score; from
   then on only the accumulators that may still reach it are updated, exactly. The k-th score found in earlier
   blocks counts too. A task returns k rows an item.
3. Those are merged in two steps, first by item and salt, then by item.

Items are the stated query set: they are collected and broadcast in blocks of about ``ITEM_BYTES`` of text,
each of which is a pass of its own (a single longer item is a block).

Defined results: a NULL text has no terms; rows that share an item_id are one item with the terms of all its
texts, NULL item_ids among them; rows that share a doc_id are documents of their own; of equal scores the
smaller doc_id comes first, NULL before the others; items or corpora without terms have no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import BROADCAST_BYTES, blocks, read, small_batches, stage

TOP = 10
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 22
ITEM_BYTES = 4 * 1024 * 1024
SALTS = 64
#: A-Z to a-z, ASCII characters other than letters and digits to spaces, all bytes of other characters as they are.
_FOLD = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of UTF-8 bytes: maximal runs of letters, digits and characters outside ASCII, lower-cased in ASCII."""
    return text.translate(_FOLD).split()


def _utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), term and tf (the vocabulary's terms in the text and their occurrences)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in parts:
            sizes, ids, tfs = [], [], []
            for text in _utf8(part.column("text")):
                found = terms(text or b"")
                counts = Counter(found)
                mine = [(known[t], c) for t, c in counts.items() if t in known] if len(counts) < len(known) else [(i, counts[t]) for t, i in known.items() if t in counts]
                sizes.append(len(found)), ids.append([i for i, _ in mine]), tfs.append([c for _, c in mine])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                                             ["doc_id", "n", "term", "tf"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Some documents' postings by term, with impacts.

    n, term, tf: arrays a document (terms with repeats) and a posting, ``doc`` the posting's document.
    """

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int):
        self.size = len(n)
        m = 25 + (75 * n * n_docs) // max(1, n_terms)
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        tf, term = tf[order], term[order]
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc])
        ids, starts = np.unique(term, return_index=True)
        ends = [*starts[1:].tolist(), len(term)]
        most = np.maximum.reduceat(self.impact, starts).tolist() if len(ids) else []
        self.lists = {t: (s, e, x) for t, s, e, x in zip(ids.tolist(), starts.tolist(), ends, most)}
        self.acc = np.zeros(self.size, np.int64)

    def search(self, query: list[tuple[int, int]], k: int, floor_score: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that hold every document among the best ``k`` that reaches ``floor_score``.

        query: (term, weight times its repeats), the rarest first.
        """
        found = [(w, *self.lists[t]) for t, w in query if w and t in self.lists]
        left = np.cumsum([0, *(w * most for w, _, _, most in reversed(found))])[::-1].tolist()  # bound of the terms from i on
        acc, kth, at = self.acc, floor_score, 0
        acc[:] = 0
        for at, (w, s, e, _) in enumerate(found):
            if left[at] < kth:
                break
            acc[self.doc[s:e]] += w * self.impact[s:e]
            if self.size > k:
                kth = max(kth, int(np.partition(acc, -k)[-k]))
        else:
            at = len(found)
        live = np.flatnonzero(acc)
        for i in range(at, len(found)):
            live = live[acc[live] + left[i] >= kth]
            w, s, e, _ = found[i]
            spot = np.searchsorted(self.doc[s:e], live)
            hit = spot < e - s
            hit[hit] = self.doc[s:e][spot[hit]] == live[hit]
            acc[live[hit]] += w * self.impact[s:e][spot[hit]]
            if len(live) > k:
                kth = max(kth, int(np.partition(acc[live], -k)[-k]))
        return live, acc[live]


def best(ids: np.ndarray, known: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: by score, then doc_id, NULL (not ``known``) first."""
    return np.lexsort((ids, known, -scores))[:k]


def _score_task(shared, k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, n_docs, n_terms = shared.value
        top: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        held: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            lists, tf = table.column("term").combine_chunks(), table.column("tf").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            block = Block(table.column("n").to_numpy(), np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(), tf.flatten().to_numpy(), n_docs, n_terms)
            column = table.column("doc_id").combine_chunks()
            known, ids = column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False)
            for q, query in enumerate(queries):
                mine = top.get(q)
                docs, scores = block.search(query, k, int(mine[2][-1]) if mine and len(mine[2]) == k else 0)
                if len(docs):
                    found = ids[docs], known[docs], scores
                    if mine:
                        found = tuple(np.concatenate(x) for x in zip(mine, found))
                    pick = best(*found, k)
                    top[q] = tuple(x[pick] for x in found)

        docs = size = 0
        for part in parts:
            if part.num_rows:
                held.append(part)
                docs, size = docs + part.num_rows, size + len(part.column("term").flatten())
            if docs >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                flush()
                docs = size = 0
        if held:
            flush()
        for q, (ids, known, scores) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(ids), pa.int32()), pa.array(ids, pa.int64(), mask=~known), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return run


def _merged(rows: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each item with rank; many tasks' rows of an item are first cut down by salt."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).filter(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    counts: dict = {}
    for row in items.select("item_id", F.col("text").cast("binary").alias("text")).toArrow().to_pylist():
        counts.setdefault(row["item_id"], Counter()).update(terms(bytes(row["text"] or b"")))
    names = sorted((i for i, c in counts.items() if c), key=lambda i: (i is not None, i))
    vocabulary = {t: n for n, t in enumerate(sorted(set().union(*(counts[i] for i in names))))}
    if not names:
        return None
    rows = stage(postings(docs, vocabulary), "postings")
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["term"]: r["count"] for r in rows.select(F.explode("term").alias("term")).groupBy("term").count().collect()}  # one row a term of the block
    queries = [[(t, c * weight(n_docs, df[t])) for t, c in sorted(((vocabulary[t], c) for t, c in counts[i].items() if vocabulary[t] in df), key=lambda x: (df[x[0]], x[0]))] for i in names]
    shared = spark.sparkContext.broadcast((queries, n_docs, n_terms))
    found = stage(rows.filter(F.size("term") > 0).select("doc_id", "n", "term", "tf").mapInArrow(_score_task(shared, k), "item int, doc_id long, score long"), "found")
    ids = spark.createDataFrame([(q, i) for q, i in enumerate(names)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
    return _merged(found, k).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item with a score above 0.

    docs: doc_id (long), text. items: item_id, text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select("item_id", "text").filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n, most = blocks(total, ITEM_BYTES), None
    while most is None or most > BROADCAST_BYTES:  # until no block of several items is too large
        n = n if most is None else 2 * n
        sized = items.groupBy("item_id").agg(F.sum(F.octet_length("text")).alias("b")).groupBy(_block(n)).agg(F.sum("b").alias("b"), F.count("*").alias("c"))
        most = sized.filter("c > 1").agg(F.coalesce(F.max("b"), F.lit(0))).first()[0]
    found = [x for b in range(n) if (x := _search_block(docs, items.filter(_block(n) == b), k)) is not None]
    empty = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found) if found else empty


def _block(n: int):
    return F.pmod(F.xxhash64("item_id"), F.lit(n))


def op13_lexical(spark, sf_dir):
    """The ten best of all documents for each benchmark item."""
    return search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, s GROUP BY t),
q AS (SELECT item_id, t, count(*) AS qtf FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, r, doc_id, sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN df USING (t), s GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
