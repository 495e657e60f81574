"""Benchmark decontamination by winnowing, in DataFrame functions alone.

1. Fingerprints: of a text's word ``GRAM``-gram hashes, the smallest of every ``WINDOW`` consecutive ones.
   Two texts that share ``GRAM + WINDOW - 1`` = 13 consecutive words share a fingerprint.
   An item of fewer than 13 words is one window of its own length: its first gram (of
   ``min(GRAM, words)`` words) is looked up among all such grams of the documents.
2. Documents that share a fingerprint with an item are candidates.
3. A candidate's grams are joined with the items' fingerprints at their positions. Each hit fixes a
   diagonal (document position less item position), along which the hit is extended: the item's words
   are compared with the document's words at that offset, and every run of a whole window counts.
4. The words inside such runs, and the items, are counted per document.

The item side is broadcast below a checked size, else shuffled. Positions and words of candidate
documents alone are kept.

Defined results: a NULL text, document or item, has no words. An item with NULL item_id takes no part.
Rows that share a doc_id are told apart by their texts; equal rows get equal results. Rows that share
an item_id are one item with the windows of all its texts. A NULL doc_id is a document like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, read, stage

SPAN, GRAM = 13, 6
WINDOW = SPAN - GRAM + 1
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _pairs(df: DataFrame, name: str, left: str, right: str, ahead: int, of) -> DataFrame:
    """Add ``name``: ``of`` each entry of ``left`` and the one of ``right`` that stands ``ahead`` places further."""
    n = F.greatest(F.lit(0), F.least(F.size(left), F.size(right) - ahead))
    return df.withColumn(name, F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(ahead + 1), n), of))


def add_grams(df: DataFrame, most: int = GRAM) -> DataFrame:
    """Add g``most`` and the shorter ones it needs: hashes of the n-grams of the word hashes ``h``, put together from shorter ones."""
    df = df.withColumn("g1", F.col("h"))
    for n in _NEEDS[most]:
        if f"g{n}" not in df.columns:
            a, b = _MADE_OF[n]
            df = _pairs(df, f"g{n}", f"g{a}", f"g{b}", a, lambda x, y: F.xxhash64(x, y))
    return df


#: An n-gram is an a-gram and the b-gram behind it; the grams that one needs.
_MADE_OF = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (4, 2)}
_NEEDS = {1: (), 2: (2,), 3: (2, 3), 4: (2, 4), 5: (2, 4, 5), 6: (2, 4, 6)}


def add_winnowed(df: DataFrame, gram_hashes: str, name: str) -> DataFrame:
    """Add the distinct minima of the windows of ``WINDOW`` = 8 hashes: minima of two, of four, of eight."""
    for k, (a, b) in enumerate(((gram_hashes, "_m2"), ("_m2", "_m4"), ("_m4", "_m8"))):
        df = _pairs(df, b, a, a, 1 << k, lambda x, y: F.least(x, y))
    return df.withColumn(name, F.array_distinct("_m8")).drop("_m2", "_m4", "_m8")


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("w", words(F.col("text"))).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))


def item_fingerprints(items: DataFrame) -> DataFrame:
    """item (row key), pos, gram, n (gram's words): where an item's looked-up grams stand."""
    # written before they are exploded: else the filters that Spark infers repeat the grams' expressions many times over
    rows = stage(add_winnowed(add_grams(items.filter(F.size("h") > 0)), f"g{GRAM}", "f"), "item_grams")
    long = (rows.filter(F.size("h") >= SPAN)
            .select("item", "f", F.posexplode(f"g{GRAM}").alias("pos", "gram")).filter(F.array_contains("f", F.col("gram")))
            .select("item", "pos", "gram", F.lit(GRAM).alias("n")))
    short = rows.filter(F.size("h") < SPAN).withColumn("n", F.least(F.size("h"), F.lit(GRAM)))
    for n in range(1, GRAM + 1):
        short = add_grams(short, n)
    first = F.coalesce(*(F.when(F.col("n") == n, F.get(f"g{n}", F.lit(0))) for n in range(1, GRAM + 1)))
    return long.unionByName(short.select("item", F.lit(0).alias("pos"), first.alias("gram"), "n"))


#: Up to so many grams of items under 13 words are picked out of each document's grams at once.
PICKED_GRAMS = 1000


def find_windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text), item_id, start, length: every occurrence of an item's window.

    docs: doc_id, text. benchmark: item_id, text.
    """
    return _find(docs, benchmark)[0]


def _find(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(windows as above, doc_id, tag and n_words of every row of ``docs``)."""
    items = stage(_hashed(benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text"))
                  .withColumn("item", F.struct("item_id", F.xxhash64("text").alias("tag"))).filter(F.size("w") > 0)
                  .select("item", "w", "h").distinct(), "items")
    prints = stage(item_fingerprints(items), "item_fingerprints")
    n_prints, n_words = prints.count(), items.agg(F.sum(F.size("w"))).first()[0] or 0
    shorter = [r["n"] for r in prints.join(items, "item").filter(F.size("w") < SPAN).select("n").distinct().collect()]  # at most GRAM values
    fits = (n_prints + n_words) * 96 <= BROADCAST_BYTES

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if fits else df

    tagged = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    hashed = _hashed(tagged)
    for n in sorted({GRAM, *shorter}, reverse=True):
        hashed = add_grams(hashed, n)
    hashed, looked_up = add_winnowed(hashed, f"g{GRAM}", "f"), ["f"]
    for n in sorted(shorter):  # of short items any place of a document may be the window: all its grams are compared
        own = prints.join(items, "item").filter((F.size("w") < SPAN) & (F.col("n") == n)).select("gram").distinct()
        few = [r["gram"] for r in own.limit(PICKED_GRAMS + 1).collect()]
        looked_up.append(F.array_intersect(f"g{n}", F.array(*map(F.lit, few)).cast("array<bigint>")) if len(few) <= PICKED_GRAMS else F.col(f"g{n}"))
    # what is written is the winnowed sketch and the words' number: the texts are not read again for either
    sketches = stage(hashed.select("doc_id", "tag", F.size("w").cast("long").alias("n_words"), F.array_distinct(F.concat(*looked_up)).alias("f") if len(looked_up) > 1 else F.col("f")), "sketches")
    sketch = sketches.select("doc_id", "tag", F.explode("f").alias("gram"))
    known = prints.select("gram").distinct()
    candidates = stage(sketch.join(side(known), "gram", "left_semi").select("doc_id", "tag").distinct(), "candidates")
    n = candidates.count()
    few = F.broadcast(candidates) if n * 48 <= BROADCAST_BYTES else candidates
    kept = stage(_hashed(tagged.filter("text is not null").join(few, tagged["doc_id"].eqNullSafe(few["doc_id"]) & (tagged["tag"] == few["tag"]), "left_semi").distinct())
                 .select("doc_id", "tag", "w", "h"), "candidate_words")

    hits = None
    for n in sorted({GRAM, *shorter}):
        at = (add_grams(kept, n).select("doc_id", "tag", F.posexplode_outer(f"g{n}").alias("at", "gram"))  # the join drops NULL
              .join(side(prints.filter(F.col("n") == n)), "gram").select("doc_id", "tag", "item", (F.col("at") - F.col("pos")).alias("shift")))
        hits = at if hits is None else hits.unionByName(at)
    hits = stage(hits.distinct(), "diagonals")
    texts = kept.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), F.col("w").alias("dw"))
    aligned = (hits.join(side(items.select("item", F.col("w").alias("iw"))), "item")
               .join(texts, hits["doc_id"].eqNullSafe(texts["d"]) & (hits["tag"] == texts["t"]))
               .withColumn("low", F.greatest(F.lit(0), -F.col("shift")))
               .withColumn("high", F.least(F.size("iw"), F.size("dw") - F.col("shift")))
               .withColumn("length", F.least(F.lit(SPAN), F.size("iw")))
               .filter(F.col("high") - F.col("low") >= F.col("length"))
               .select("doc_id", "tag", "item", "shift", "low", "length", F.slice("iw", F.col("low") + 1, F.col("high") - F.col("low")).alias("iw"),
                       F.slice("dw", F.col("shift") + F.col("low") + 1, F.col("high") - F.col("low")).alias("dw")))
    same = F.zip_with("iw", "dw", lambda x, y: x == y)
    starts = F.filter(F.sequence(F.lit(1), F.size("same") - F.col("length") + 1), lambda i: F.forall(F.slice("same", i, F.col("length")), lambda x: x))
    windows = (aligned.withColumn("same", same).select("doc_id", "tag", "item", "length", F.explode(starts).alias("i"), "shift", "low")
               .select("doc_id", "tag", F.col("item.item_id").alias("item_id"), (F.col("shift") + F.col("low") + F.col("i") - 1).alias("start"), "length"))
    return windows, sketches.select("doc_id", "tag", "n_words")


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """doc_id, tag, n_words, n_hit, n_items, items, contaminated for each row of ``docs``.

    items: the item_ids with occurring windows as a sorted array of strings. contaminated: at least one
    word is hit, and one in ``share`` words or more.
    """
    found, rows = _find(docs, benchmark)
    found = stage(found, "windows")
    spots = (found.select("doc_id", "tag", F.explode(F.expr("sequence(start, start + length - 1)")).alias("at")).distinct()
             .groupBy("doc_id", "tag").agg(F.count("*").alias("n_hit")))
    items = (found.select("doc_id", "tag", "item_id").distinct().groupBy("doc_id", "tag")
             .agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("items")))
    hit = stage(spots.withColumnsRenamed({"doc_id": "d", "tag": "t"}).join(items, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tag")))
                .select("d", "t", "n_hit", "n_items", "items"), "hit_documents")
    return (rows.join(hit, rows["doc_id"].eqNullSafe(hit["d"]) & (rows["tag"] == hit["t"]), "left")
            .select("doc_id", "tag", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))))


def clean_documents(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are."""
    bad = stage(contamination(docs.select("doc_id", "text"), benchmark, share).filter("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct(), "contaminated")
    n = bad.count()
    side = F.broadcast(bad) if n * 32 <= BROADCAST_BYTES else bad
    return docs.withColumn("_text_tag", F.xxhash64("text")).join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_tag") == F.col("_tag")), "left_anti").drop("_text_tag")


def op2_decontamination(spark, sf_dir):
    """Benchmark windows in the whole texts of all documents."""
    out = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def contamination_sql(table: str) -> str:
    return rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}
), bw AS (
  SELECT item_id, w, least(len(w), 13) AS l FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), bx AS (
  SELECT DISTINCT item_id, l, array_to_string(list_slice(w, i, i + l - 1), ' ') AS s FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM bw)
), dx AS (
  SELECT doc_id, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS s
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM bx) WHERE len(w) >= l)
), m AS (SELECT doc_id, item_id, dx.i, dx.l FROM dx JOIN bx ON dx.l = bx.l AND dx.s = bx.s),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN h ON h.doc_id = dw.doc_id LEFT JOIN t ON t.doc_id = dw.doc_id
"""


OP2_SQL = contamination_sql("documents")
