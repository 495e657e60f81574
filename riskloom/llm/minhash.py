"""Near-duplicate documents with b-bit MinHash.

1. Sketch (Arrow task, one pass over the texts): the set of distinct n-word shingles as 64-bit
   hashes, ``BANDS * ROWS`` minima, a 64-bit key for each band, and the low ``BITS`` bits of each
   minimum packed into a signature. Documents of equal sets collapse to their smallest doc_id.
2. Buckets: band keys of two or more sets. Buckets with the same members count once.
3. Star pass: each set is compared with the smallest member of its buckets: first the signatures
   (equal bit groups, corrected for chance collisions, less ``SIGMAS`` standard errors), then the
   full shingle sets.
4. The links so far give components. Only buckets that still hold several components go on: in
   them the sets outside the first component are compared with all the others, in blocks of
   ``BLOCK`` by ``BLOCK`` sets: signatures first, then 32-bit shingle hashes, inside the task, so that
   similar pairs below the threshold never become rows. What is left is confirmed on full sets.
5. Components of all confirmed links.

No pair of a bucket is left out, and no pairs within a component are listed. A pair at the
threshold shares no band with probability (1 - 0.8^ROWS)^BANDS = 3e-6.

Defined results: sets are linked, and a row belongs to its set, so rows that share a doc_id are one
document if their texts have one set, else each row has its own links. A row with NULL doc_id takes
part; component_id is the smallest doc_id that is not NULL, so a component of such rows alone has NULL
and keeps them. An empty or NULL text, or one without words, has the empty set and is linked with
nothing: its component is its own doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, small_side, stage
from .components import connected_components

BANDS, ROWS, BITS = 32, 5, 4
HASHES = BANDS * ROWS
SIGMAS = 5.0
BLOCK = 512
#: Members of a hub that one task compares; a larger hub's set is sent to several tasks.
HUB_CHUNK = 64
SEED = 20240229

_rng = np.random.default_rng(SEED)
_MULTIPLY = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; with fewer words, of the whole sequence.

    Words are runs without ASCII white space, A-Z lower-cased (what bytes.lower and bytes.split do).
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k])
    return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of the set; memory is bounded by blocks of 1,024 shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(low, (x[k:k + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of ROWS minima, the band's number mixed in."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return key.view(np.int64)


def signature(low: np.ndarray) -> bytes:
    """The low BITS bits of each (mixed) minimum, packed."""
    bits = _mix(low.astype(np.uint64) + np.uint64(1))
    return np.packbits(((bits[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)).tobytes()


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of a packed signature and each row of ``many``, corrected for chance collisions.

    BITS is 4: equal groups are half bytes that are 0 in the exclusive or.
    """
    x = one ^ many
    x |= x >> 1  # or-fold each half byte into its lowest bit
    x |= x >> 2
    equal = HASHES - _POPCOUNT[x & 0x11].sum(axis=-1, dtype=np.int64)
    chance = 1.0 / (1 << BITS)
    return (equal / HASHES - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """What a pair at the threshold stays above, but for SIGMAS standard errors."""
    chance = 1.0 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return threshold - SIGMAS * np.sqrt(p * (1 - p) / HASHES) / (1 - chance)


def node_of(shingles: np.ndarray) -> int | None:
    """The identity of a shingle set: 64 bits over all of it; None for the empty set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles)).view(np.int64))) if len(shingles) else None


def _sketch_task(n: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            size, node, bands, sig = [], [], [], []
            for t in part.column("text"):
                s = shingle_set(t.as_py(), n)
                size.append(len(s))
                node.append(node_of(s))
                low = minima(s) if len(s) else None
                bands.append(None if low is None else band_keys(low))
                sig.append(None if low is None else signature(low))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), pa.array(size, pa.int64()), pa.array(node, pa.int64()),
                                              pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                                             ["doc_id", "tag", "n_shingles", "node", "bands", "sig"])

    return run


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, tag (hash of the text), n_shingles, node (identity of the set), bands, sig for each row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tag")).mapInArrow(
        _sketch_task(n), "doc_id long, tag long, n_shingles long, node long, bands array<long>, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Packed signatures as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _screen_task(least: float):
    """Pairs whose estimated similarity reaches ``least``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                keep = estimates(_matrix(part.column("sig")), _matrix(part.column("hub_sig"))) >= least
                yield part.select(["hub", "node"]).filter(pa.array(keep))

    return run


def _tile_task(least: float, threshold: tuple[int, int]):
    """Pairs of different components in each tile (key, a, o); one tile is held at a time.

    A pair is looked at in the first of its common buckets. Pairs that pass the signatures are compared
    on their sets of 32-bit shingle hashes, likely ones first; what a sure link joins is not compared
    again. Chance collisions of 32 bits decide nothing: links and doubtful pairs go on to ``confirm``.
    """
    up, down = threshold

    def pairs(key: int, rows) -> pa.RecordBatch:
        node, comp, other = (np.array(x) for x in zip(*((r[0], r[1], r[3]) for r in rows)))
        sig = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
        every, found = np.flatnonzero(~other), []
        for k in np.flatnonzero(other):
            e = estimates(sig[k], sig[every])
            near = np.flatnonzero((comp[every] != comp[k]) & (e >= least))
            found += zip(e[near].tolist(), [int(k)] * len(near), every[near].tolist())
        root = {c: c for c in comp.tolist()}

        def top(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out, keys = [], [frozenset(r[4]) for r in rows]
        sets: dict[int, np.ndarray] = {}
        for _, i, j in sorted(found, reverse=True):
            ci, cj = top(int(comp[i])), top(int(comp[j]))
            if ci == cj or min(keys[i] & keys[j]) != key:
                continue
            x, y = (sets.setdefault(q, np.frombuffer(rows[q][5], np.uint32)) for q in (i, j))
            both = len(np.intersect1d(x, y, assume_unique=True))
            margin = (up + down) * (1 + len(x) * len(y) / 2 ** 28)  # of both, in the comparison
            sure = down * both - up * (len(x) + len(y) - both)
            if sure >= -margin:
                out.append((max(rows[i][0], rows[j][0]), min(rows[i][0], rows[j][0])))
                if sure >= margin:
                    root[ci] = cj
        us, vs = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(vs, pa.int64()), pa.array(us, pa.int64())], ["hub", "node"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []
        for part in parts:
            for *at, node, comp, sig, other, keys, shingles in zip(*(part.column(c).to_pylist() for c in ("key", "a", "o", "node", "component", "sig", "other", "keys", "shingles"))):
                if at != tile:
                    if rows:
                        yield pairs(tile[0], rows)
                    tile, rows = at, []
                rows.append((node, comp, sig, other, keys, shingles))
        if rows:
            yield pairs(tile[0], rows)

    return run


def _set_task(n: int, bits: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingle_set(t.as_py(), n) for t in part.column("text")]
            kept = sets if bits == 64 else [np.unique(s.astype(np.uint32)) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in kept], pa.binary())], ["node", "shingles"])

    return run


def shingle_sets(docs: DataFrame, reps: DataFrame, nodes: DataFrame, n: int, bits: int) -> DataFrame:
    """node, shingles (packed 64- or 32-bit hashes) of the given nodes, from the texts of one document each."""
    wanted = stage(nodes.join(reps.select("node", "rep_id"), "node").select("rep_id", "node"), "wanted")
    size = wanted.count()
    ids = wanted.select("rep_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(small_side(ids, size, 16), texts["doc_id"].eqNullSafe(ids["rep_id"]), "left_semi")
    # rows that share a doc_id may hold another text: only wanted sets go on
    return stage(texts.select("text").mapInArrow(_set_task(n, bits), "node long, shingles binary")
                 .join(small_side(wanted.select("node"), size, 16), "node", "left_semi"), "sets")


def _confirm_task(threshold: tuple[int, int]):
    """Rows come by (hub, chunk), the hub's own set first; only that set is held."""
    up, down = threshold

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = own = None
        for part in parts:
            us, vs = [], []
            for h, node, s in zip(part.column("hub").to_pylist(), part.column("node").to_pylist(), part.column("shingles")):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if h == node:
                    hub, own = h, s.copy()
                    continue
                if h != hub:
                    raise ValueError("a hub's set is missing")
                both = len(np.intersect1d(own, s, assume_unique=True))
                if down * both >= up * (len(own) + len(s) - both):
                    us.append(node), vs.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def confirm(docs: DataFrame, reps: DataFrame, pairs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (hub, node) whose full shingle sets are similar enough, as u, v.

    Sets are computed again from the texts of the documents concerned only. A hub's set goes to as
    many tasks as it has chunks of HUB_CHUNK members.
    """
    chunks = stage(pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_CHUNK).cast("int").alias("chunks")), "hubs")
    sets = shingle_sets(docs, reps, pairs.select("node").unionByName(chunks.select(F.col("hub").alias("node"))).distinct(), n, 64)
    members = (pairs.join(chunks, "hub").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
               .select("hub", "chunk", "node").join(sets, "node").select("hub", "chunk", "node", "shingles"))
    hubs = (chunks.join(sets.withColumnRenamed("node", "hub"), "hub")
            .select("hub", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.col("hub").alias("node"), "shingles"))
    return (members.unionByName(hubs).withColumn("member", F.col("hub") != F.col("node"))
            .repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "member").select("hub", "node", "shingles")
            .mapInArrow(_confirm_task(threshold), "u long, v long"))


def _open_tiles(docs: DataFrame, members: DataFrame, linked: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """Members of buckets that hold several components, dealt into tiles (key, a, o).

    The largest component of a bucket is its main one. Each tile has a block of the others and a
    block of all members, so nothing is compared within the main component.
    """
    now = stage(members.join(linked, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "members_now")
    counts = now.groupBy("key", "component").agg(F.count("*").alias("n"))
    buckets = (counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"),
                                         F.max("n").alias("most"), F.count("*").alias("components"))
               .filter("components > 1")
               .select("key", "main", F.expr(f"CAST(CEIL(n / {BLOCK}) AS INT)").alias("as"), F.expr(f"CAST(CEIL((n - most) / {BLOCK}) AS INT)").alias("os")))
    rows = stage(now.join(stage(buckets, "open_buckets"), "key"), "open_members")
    keys = rows.groupBy("node").agg(F.collect_set("key").alias("keys"))  # at most BANDS
    facts = keys.join(reps.select("node", "sig"), "node").join(shingle_sets(docs, reps, rows.select("node").distinct(), n, 32), "node")
    every = rows.withColumn("a", F.expr("CAST(pmod(xxhash64(node, 1), `as`) AS INT)")).withColumn("o", F.explode(F.expr("sequence(0, os - 1)"))).withColumn("other", F.lit(False))
    others = (rows.filter("component <> main").withColumn("o", F.expr("CAST(pmod(xxhash64(node, 2), os) AS INT)"))
              .withColumn("a", F.explode(F.expr("sequence(0, `as` - 1)"))).withColumn("other", F.lit(True)))
    cols = ["key", "a", "o", "node", "component", "other"]
    return (every.select(cols).unionByName(others.select(cols)).join(stage(facts, "open_facts"), "node")
            .repartition("key", "a", "o").sortWithinPartitions("key", "a", "o"))


def near_duplicates(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, tag (hash of the text), n_shingles, component_id, kept for each row of ``docs``.

    Linked are documents whose n-word shingle sets have ``threshold`` (a fraction) of their union in
    common; component_id is the smallest doc_id of the component, ``kept`` marks that document.
    """
    least = least_estimate(threshold[0] / threshold[1])
    rows = stage(sketches(docs, n), "sketches")
    reps = stage(rows.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep_id"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "sets_once")
    keys = reps.select("node", F.explode("bands").alias("key"))
    buckets = (keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                       F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("n > 1")
               .groupBy("hub", "n", "x", "y").agg(F.min("key").alias("key")))  # the same members once
    members = stage(keys.join(stage(buckets.select("key", "hub"), "buckets"), "key"), "members")
    star = members.filter("node <> hub").groupBy("node").agg(F.min("hub").alias("hub"))
    screened = (star.join(reps.select("node", "sig"), "node").join(reps.select(F.col("node").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
                .select("hub", "node", "sig", "hub_sig").mapInArrow(_screen_task(least), "hub long, node long"))
    edges = stage(confirm(docs, reps, stage(screened, "star_pairs"), n, threshold), "star_links")
    linked = stage(connected_components(edges), "star_components")
    more = stage(_open_tiles(docs, members, linked, reps, n).mapInArrow(_tile_task(least, threshold), "hub long, node long").distinct(), "cross_pairs")
    if not more.isEmpty():
        found = stage(confirm(docs, reps, more, n, threshold), "cross_links")
        linked = stage(connected_components(found.unionByName(linked.select(F.col("node").alias("u"), F.col("component").alias("v")))), "components")
    named = reps.select("node", "rep_id").join(linked, "node", "left").select("node", "rep_id", F.coalesce("component", "node").alias("component"))
    first = stage(named.groupBy("component").agg(F.min("rep_id").alias("component_id")), "component_ids")
    named = stage(named.join(first, "component").select("node", "component_id"), "named_sets")
    return (rows.select("doc_id", "tag", "n_shingles", "node").join(named, "node", "left")
            .select("doc_id", "tag", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def one_of_each(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``docs`` that their group of near-duplicates keeps, all columns as they are.

    Of rows with one doc_id and one text one stays.
    """
    found = stage(near_duplicates(docs, n, threshold).withColumnsRenamed({"doc_id": "_id", "tag": "_tag"}), "classes")
    gone = found.filter(~F.col("kept")).select("_id", "_tag").distinct()
    again = found.filter("kept").groupBy("_id", "_tag").agg(F.count("*").alias("n")).filter("n > 1").select("_id", "_tag")
    tagged = docs.withColumn("_text_tag", F.xxhash64("text"))

    def on(side):
        return F.col("doc_id").eqNullSafe(side["_id"]) & (F.col("_text_tag") == side["_tag"])

    n_gone, n_again = gone.count(), again.count()
    out = tagged.join(small_side(gone, n_gone, 32), on(gone), "left_anti") if n_gone else tagged
    if n_again:
        again = small_side(stage(again, "repeated_rows"), n_again, 32)
        out = out.join(again, on(again), "left_anti").unionByName(out.join(again, on(again), "left_semi").dropDuplicates(["doc_id", "_text_tag"]))
    return out.drop("_text_tag")


def op9_minhash(spark, sf_dir):
    """Near-duplicate classes of all documents on 2-word shingles."""
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), n=2).drop("tag")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 1), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS both FROM s p JOIN s q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * x.both >= 80 * (na.n + nb.n - x.both)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
