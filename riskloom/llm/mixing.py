"""Mix sources to target weights on a low-discrepancy schedule.

Each source's documents stand in a shuffled order (md5 of the id) and are cut into blocks of
``block_words`` words. The schedule is a row of slots: slot *t* takes the golden-ratio point
``frac(t * phi)`` (64-bit arithmetic), and the point's place in the cumulative weights names the
source. A slot's rank among its source's slots names the block: rank modulo the number of blocks,
so a second pass over a source starts when its first is over. Every source's share therefore stays
near its weight in every prefix of the mix, and the last block a source gives is cut where its target
is reached, so its total is its target, rounded down.

Nothing is ranked in one task: word offsets and slot ranks come from totals of small buckets
(about ``BUCKET_ROWS`` documents or ``CHUNK`` slots) plus a window inside each bucket.

Defined results: a NULL text has size 0 and is never taken; NULL is a source of its own, the last;
sources of size 0 have target 0; rows that share a doc_id are separate pieces; no more than
``MAX_SOURCES`` sources may be mixed (one weight each is held by the driver): more raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, read, small_side, stage

MAX_SOURCES = 1_000_000
BUCKET_ROWS = 4096
CHUNK = 1 << 16
#: 2^64 / golden ratio, made odd: the step of the Weyl sequence frac(t * phi).
GOLDEN = 0x9E3779B97F4A7C15


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def capped_targets(sizes: Sequence[int], weights: Sequence[int], share: tuple[int, int] = (3, 2), cap: int = 2) -> list[float]:
    """Targets by weight of ``share`` times all sizes, none above ``cap`` times its size.

    The excess is shared again by weight. A source is capped if it would be above its cap when all
    sources with a smaller size per weight are; integers decide, one division makes the target.
    """
    up, down = share
    total = sum(sizes)
    order = sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i])
    left, weight, level = up * total, sum(weights), {}
    for i in order:
        if weights[i] * left > down * cap * sizes[i] * weight:
            left -= down * cap * sizes[i]
            weight -= weights[i]
            level[i] = float(cap * sizes[i])
        else:
            break
    return [level[i] if i in level else weights[i] * left / (down * weight) for i in range(len(sizes))]


def _positions(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """start: the words that stand before the document in its source's shuffled order."""
    rows = (docs.join(plan.select("idx", "name", "buckets"), docs["source"].eqNullSafe(F.col("name")))
            .drop("name").withColumn("bucket", F.expr("CAST(CAST(conv(substr(deal, 1, 8), 16, 10) AS BIGINT) * buckets DIV 4294967296 AS INT)")))
    before = Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("idx", "bucket").agg(F.sum("size").alias("words"))
               .withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).select("idx", "bucket", "offset"))
    inside = Window.partitionBy("idx", "bucket").orderBy("deal", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(stage(offsets, "offsets"), ["idx", "bucket"])
            .select("doc_id", "idx", "size", (F.col("offset") + F.col("ahead")).alias("start")))


def _chunk_slots(bounds: np.ndarray, slots: int, counts_only: bool):
    """Slots of each chunk: the source of every golden-ratio point and its rank in the chunk."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for chunk in part["id"].tolist():
                t = np.arange(chunk * CHUNK, min(slots, (chunk + 1) * CHUNK), dtype=np.uint64)
                idx = np.searchsorted(bounds, (t + np.uint64(1)) * np.uint64(GOLDEN), side="right")
                if counts_only:
                    who, n = np.unique(idx, return_counts=True)
                    yield pd.DataFrame({"chunk": chunk, "idx": who, "n": n})
                    continue
                order = np.argsort(idx, kind="stable")
                first = np.searchsorted(idx[order], idx[order], side="left")
                yield pd.DataFrame({"chunk": chunk, "idx": idx[order], "slot": t[order].astype(np.int64), "nth": np.arange(len(t)) - first})

    return run


def schedule(spark, need: Sequence[int]) -> DataFrame:
    """slot, idx, rank: ``need[idx]`` slots for each source, spread evenly over the whole schedule.

    The sequence gives each source its count but for a few slots: those above it are left out,
    those it lacks follow at the end.
    """
    slots, cum, bounds = sum(need), 0, []
    for n in need[:-1]:
        cum += n
        bounds.append(min((1 << 64) - 1, (cum << 64) // max(1, slots)))
    bounds = np.array(bounds, np.uint64)
    n_chunks = blocks(slots, CHUNK) if slots else 0
    chunks = spark.range(0, n_chunks, 1, max(1, min(n_chunks, 10_000)))
    counts = stage(chunks.mapInPandas(_chunk_slots(bounds, slots, True), "chunk long, idx int, n long"), "slot_counts")
    got = {r["idx"]: r["n"] for r in counts.groupBy("idx").agg(F.sum("n").alias("n")).collect()}  # a row a source
    before = Window.partitionBy("idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("chunk", "idx", "offset")
    # written first: Spark would take what a task makes of a small range for small, and broadcast it
    drawn = (stage(chunks.mapInPandas(_chunk_slots(bounds, slots, False), "chunk long, idx int, slot long, nth long"), "slots")
             .join(stage(offsets, "slot_offsets"), ["chunk", "idx"])
             .select("slot", "idx", (F.col("offset") + F.col("nth")).alias("rank")))
    tail, at = [], slots
    for i, n in enumerate(need):
        if n > (g := got.get(i, 0)):
            tail.append((i, g, n, at))
            at += n - g
    if not tail:
        return drawn
    rest = (spark.createDataFrame(tail, "idx int, got long, need long, at long")
            .select("idx", "at", "got", F.explode(F.expr("sequence(got, need - 1)")).alias("rank"))
            .select((F.col("at") + F.col("rank") - F.col("got")).alias("slot"), "idx", "rank"))
    return drawn.unionByName(rest)


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), cap: int = 2,
        block_words: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(documents, mix).

    documents: doc_id, size, source_size, target, idx, start, a row for each row of ``docs``.
    mix: slot, source, doc_id, idx, start, from_word, n_words: what each slot takes, in the order of slots.
    Sources in code-point order, NULL last, weigh ``weights``, repeating; ``share`` (a fraction) of all
    words is shared out, and no source gives more than ``cap`` times its own.
    """
    spark = docs.sparkSession
    ident = F.col("doc_id").cast("string")
    deal = F.md5(F.coalesce(ident, F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit(""))))))
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), deal.alias("deal")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    found = totals.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in found]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, cap) if sum(sizes) else [0.0] * len(sizes)
    rows, need = [], []
    for i, (r, t) in enumerate(zip(found, targets)):
        passes, rest = divmod(int(t), r["words"]) if r["words"] else (0, 0)
        n_blocks = -(-r["words"] // block_words)
        need.append(passes * n_blocks + -(-rest // block_words))
        rows.append((i, r["source"], r["words"], t, blocks(r["n"], BUCKET_ROWS), n_blocks, passes, rest))
    plan = spark.createDataFrame(rows, "idx int, name string, source_size long, target double, buckets int, n_blocks long, passes long, rest long")
    plan = small_side(plan, len(rows), 128)
    documents = stage(_positions(sized, plan), "positions")
    pieces = documents.filter("size > 0").select("doc_id", "idx", "start", "size", F.explode(
        F.expr(f"sequence(start DIV {block_words}, (start + size - 1) DIV {block_words})")).alias("block"))
    slots = (schedule(spark, need).join(plan, "idx").filter("n_blocks > 0")
             .withColumn("turn", F.expr("rank DIV n_blocks")).withColumn("block", F.expr("rank % n_blocks"))
             .withColumn("until", F.expr("CASE WHEN turn < passes THEN source_size WHEN turn = passes THEN rest ELSE 0 END"))
             .filter(F.col("block") * block_words < F.col("until")).select("slot", F.col("name").alias("source"), "idx", "block", "until"))
    mixed = (slots.join(pieces, ["idx", "block"])
             .withColumn("at", F.greatest("start", F.col("block") * block_words))
             .withColumn("n_words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words, "until") - F.col("at"))
             .filter("n_words > 0")
             .select("slot", "source", "doc_id", "idx", "start", (F.col("at") - F.col("start")).alias("from_word"), "n_words"))
    return documents.join(plan.select("idx", "source_size", "target"), "idx"), mixed


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    documents, mixed = mix(docs, **options)
    taken = mixed.groupBy("idx", "start", "doc_id").agg(F.sum("n_words").alias("n"))
    on = [documents["idx"] == taken["idx"], documents["start"] == taken["start"], documents["doc_id"].eqNullSafe(taken["doc_id"]), documents["size"] > 0]
    return documents.join(taken, on, "left").select(
        documents["doc_id"], "size", "source_size", "target", F.coalesce("n", F.lit(0)).cast("long").alias("taken"))


def op7_mixing(spark, sf_dir):
    """Words that the mix takes of every document."""
    return taken_words(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def taken_sql(table: str) -> str:
    """The same totals in closed form: whole passes over a source, then the first words of its shuffled order."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS deal FROM {table}
), s AS (
  SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
c AS (
  SELECT a.source, a.words, a.weight,
         3 * (SELECT sum(words) FROM w) - 4 * coalesce(sum(b.words) FILTER (WHERE b.words * a.weight < a.words * b.weight), 0) AS l,
         (SELECT sum(weight) FROM w) - coalesce(sum(b.weight) FILTER (WHERE b.words * a.weight < a.words * b.weight), 0) AS v
  FROM w a CROSS JOIN w b GROUP BY ALL
), e AS (SELECT *, weight * l > 4 * words * v AS capped FROM c),
f AS (
  SELECT 3 * (SELECT sum(words) FROM w) - 4 * coalesce(sum(words) FILTER (WHERE capped), 0) AS l, sum(weight) FILTER (WHERE NOT capped) AS v FROM e
), t AS (
  SELECT e.source, words, CASE WHEN capped THEN (2 * words)::DOUBLE ELSE (weight * f.l)::DOUBLE / (2 * f.v)::DOUBLE END AS target FROM e, f
), p AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY deal, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d
)
SELECT p.doc_id, p.size, t.words AS source_size, t.target,
       CASE WHEN t.words = 0 THEN 0 ELSE (p.size * (floor(t.target)::BIGINT // t.words)
            + greatest(0, least(p.start + p.size, floor(t.target)::BIGINT % t.words) - p.start)) END::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""


OP7_SQL = taken_sql("documents")
