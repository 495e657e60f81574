"""Merkle manifest of a dataset: built level by level, proved by a recursive query that climbs it.

Leaves (a digest a row) ascend by doc_id within their source; every ``FAN`` consecutive nodes become the
node above them, until one is left: the source's subroot. Subroots, ordered by source, become the root the
same way. A node's digest is the hex SHA-256 of its children's hex digests; a lone leaf is its own subroot.

``build`` numbers the leaves by a range partitioning (no window over a source) and writes

* ``runs``: a row for each run of sibling leaves, with its leaves;
* ``nodes``: the rows of all levels above, linked to their parents, each with its children's digests.

``climb`` is one recursive query over them. From its own run upward a leaf has the siblings of all leaves
of the run, so that a run's leaves ascend together: each step appends the siblings at that height to the
proof (32 bytes a sibling) and folds the distinct digests claimed for the leaves with them. What a row
carries is bounded by FAN and the height. Upper levels are broadcast below a checked size. Below them a
parent has at most FAN**height rows to meet, which bounds the join's groups.

Defined results: NULL source is a source of its own, before the others; NULL doc_id comes before the
others; rows that share a doc_id are leaves of their own, ascending by digest (equal rows have equal
results); a claim of NULL is the leaf itself; an empty table has no root and no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import inf

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import BROADCAST_BYTES, ascii_lower, read, small_side, stage

FAN = 16
HEX = 64
#: Limits of recursive queries: Spark's own for levels and rows are for queries that might not end.
_LIMITS = {"spark.sql.cteRecursionRowLimit": "-1"}


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, ``:`` and the value (integers in decimal)."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with pos (from 0 within ``group`` by ``order``), and the group sizes (group columns, n).

    Rows are dealt to tasks by ranges of group, order and their place in the files, so that neither a large
    group nor equal rows fill one task; within a task the position is its row number. The first rows of
    groups in tasks (tasks + groups rows) give the offsets.
    """
    df = stage(df, f"{name}_rows").withColumn("_at", F.monotonically_increasing_id())
    keys = [*group, *order, "_at"]
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_at")
    rows = stage(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), f"{name}_sorted")
    part, at = F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = stage(rows.groupBy(part, *group).agg(F.count("*").alias("_n"), F.min(at).alias("_first")), f"{name}_counts")
    before = F.sum("_n").over(Window.partitionBy(*group or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stage(counts.select("_part", *(F.col(g).alias(f"_{g}") for g in group), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_offset")), f"{name}_offsets")
    same = F.shiftright("_id", 33) == F.col("_part")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = rows.join(small_side(offsets, offsets.count(), 128), same).withColumn("pos", at + F.col("_offset"))
    return out.select(*df.drop("_at").columns, "pos"), counts.groupBy(*group).agg(F.sum("_n").alias("n"))


def _parts(children: Column, slot: Column) -> tuple[Column, Column]:
    """The hex digests left and right of a child."""
    return F.substring(children, F.lit(1), slot * HEX), F.substring(children, slot * HEX + (HEX + 1), F.length(children))


def _key(tree: Column, level: int, idx: Column) -> Column:
    return F.concat_ws("/", tree, F.lit(str(level)), idx.cast("string"))


def _above(level: DataFrame) -> DataFrame:
    """tree, idx, m (nodes of the tree at this height), children, digest: the nodes made of ``level``'s.

    level: tree, idx, m, digest, all of trees with several nodes.
    """
    return (level.groupBy("tree", F.expr(f"idx div {FAN}").alias("up")).agg(F.max("m").alias("m"), F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("c"))
            .select("tree", F.col("up").alias("idx"), F.expr(f"(m + {FAN - 1}) div {FAN}").alias("m"), F.array_join(F.col("c.digest"), "").alias("children"))
            .withColumn("digest", digest(F.col("children"))))


def _levels(first: DataFrame, most: int, height: int, name: str) -> list[tuple[int, DataFrame]]:
    """(height, nodes) of all levels above ``first``, which has at most ``most`` nodes in a tree."""
    out, now = [], first
    while most > 1:
        height, most = height + 1, -(-most // FAN)
        now = stage(_above(now.filter("m > 1")), f"{name}_{height}")
        out.append((height, now))
    return out


@dataclass
class Manifest:
    """runs: run, parent, slot, lone, members (pos, doc_id, leaf, claim), children, subroot. nodes: node,
    parent, slot, children, subroot, height. sizes: nodes at each height (the root's tree above the sources')."""

    root: str | None
    runs: DataFrame
    nodes: DataFrame
    sizes: dict[int, int]


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves``: doc_id, source, leaf (hex digest), claim (hex digest or NULL)."""
    placed, counts = numbered(leaves.select("doc_id", "source", "leaf", "claim"), ["source"], ["doc_id", "leaf"], "leaves")
    trees, _ = numbered(counts, [], ["source"], "sources")
    trees = stage(trees.select(F.col("source").alias("_source"), "n", F.col("pos").alias("tree")), "trees")
    n_trees, most = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    members = placed.join(small_side(trees, n_trees, 128), F.col("source").eqNullSafe(F.col("_source")))
    runs = stage(members.groupBy("tree", F.expr(f"pos div {FAN}").alias("idx"))
                 .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "doc_id", "leaf", "claim"))).alias("members"))
                 .withColumn("children", F.array_join(F.col("members.leaf"), "")).withColumn("lone", F.col("n") == 1)
                 .withColumn("digest", F.when(F.col("lone"), F.col("children")).otherwise(digest(F.col("children"))))
                 .withColumn("m", F.expr(f"(n + {FAN - 1}) div {FAN}")), "runs")
    in_sources = _levels(runs.select("tree", "idx", "m", "digest"), -(-most // FAN), 1, "level")
    tops = [runs, *(x for _, x in in_sources)]
    subroots = None
    for x in tops:
        x = x.filter("m = 1").select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("m"), "digest")
        subroots = x if subroots is None else subroots.unionByName(x)
    subroots = stage(subroots, "subroots")
    base = 1 + len(in_sources)
    over_sources = _levels(subroots, n_trees, base, "top")
    last = (over_sources[-1][1] if over_sources else subroots).select("digest").first()

    tree, idx = F.col("tree"), F.col("idx")
    up_top = F.when(F.lit(n_trees > 1), _key(F.lit("top"), base + 1, F.expr(f"tree div {FAN}")))

    def linked(df: DataFrame, height: int, top: bool) -> DataFrame:
        one = F.col("m") == 1
        name = F.lit("top") if top else tree.cast("string")
        up = _key(name, height + 1, F.expr(f"idx div {FAN}"))
        rank = idx if top else F.when(one, tree).otherwise(idx)
        return df.select(_key(name, height, idx).alias("node"), F.when(~one, up).otherwise(F.lit(None) if top else up_top).alias("parent"),
                         (rank % FAN).cast("int").alias("slot"), "children", F.when(one & F.lit(not top), F.col("digest")).alias("subroot"), F.lit(height).alias("height"),
                         *([F.col("members"), F.col("lone")] if "members" in df.columns else []))

    nodes = None
    for k, x in [*in_sources, *over_sources]:
        x = linked(x, k, k > base)
        nodes = x if nodes is None else nodes.unionByName(x)
    if nodes is None:
        nodes = linked(runs.filter("false"), 0, False).drop("members", "lone")
    nodes = stage(nodes, "nodes")
    sizes = {r["height"]: r["count"] for r in nodes.groupBy("height").count().collect()}
    return Manifest(last and last["digest"], linked(runs, 1, False).withColumnRenamed("node", "run").drop("height"), nodes, sizes)


def recursive(spark: SparkSession, query: str, name: str, **frames: DataFrame) -> DataFrame:
    """The rows of a recursive query, written; the session's limits are lifted meanwhile."""
    before = {k: spark.conf.get(k) for k in _LIMITS}
    try:
        for k, v in _LIMITS.items():
            spark.conf.set(k, v)
        return stage(spark.sql(query, **frames), name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def climb(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each leaf."""
    spark = manifest.runs.sparkSession
    left, right = _parts(F.col("children"), F.col("at"))
    first = F.transform("members", lambda m, i: F.when(F.col("lone"), F.coalesce(m["claim"], m["leaf"])).otherwise(
        digest(*_around(F.col("children"), i, F.coalesce(m["claim"], m["leaf"])))))
    runs = stage(manifest.runs.withColumn("first", first), "first_fold")
    anchor = runs.select("run", "parent", "slot", F.lit(b"").alias("proof"), F.array_distinct("first").alias("folds"), "subroot")
    # the levels from which on all nodes together may be broadcast
    room, from_height = BROADCAST_BYTES, inf
    for h in sorted(manifest.sizes, reverse=True):
        room -= manifest.sizes[h] * (FAN * HEX + 256)
        if room < 0:
            break
        from_height = h
    low = any(h < from_height for h in manifest.sizes)
    columns = ("parent", "slot", "children", "subroot")
    pick = {c: f"coalesce(h.{c}, l.{c})" if low else f"h.{c}" for c in ("node", *columns)}
    siblings = f"substr({pick['children']}, 1, c.slot * {HEX})", f"substr({pick['children']}, c.slot * {HEX} + {HEX + 1})"
    query = f"""
        WITH RECURSIVE climb(run, parent, slot, proof, folds, subroot) MAX RECURSION LEVEL {len(manifest.sizes) + 2} AS (
          SELECT run, parent, slot, proof, folds, subroot FROM {{anchor}}
          UNION ALL
          SELECT /*+ BROADCAST(h) */ c.run, {pick['parent']}, {pick['slot']}, concat(c.proof, unhex(concat({siblings[0]}, {siblings[1]}))),
                 transform(c.folds, f -> sha2(concat({siblings[0]}, f, {siblings[1]}), 256)), coalesce(c.subroot, {pick['subroot']})
          FROM climb c {'LEFT JOIN {low} l ON l.node = c.parent LEFT' if low else ''} JOIN {{high}} h ON h.node = c.parent
          {'WHERE l.node IS NOT NULL OR h.node IS NOT NULL' if low else ''}
        )
        SELECT run, proof, folds, subroot FROM climb WHERE parent IS NULL"""
    frames = {"anchor": anchor, "high": manifest.nodes.filter(F.col("height") >= (from_height if from_height < inf else 1 << 30)).select("node", *columns)}
    if low:
        frames["low"] = manifest.nodes.filter(F.col("height") < (from_height if from_height < inf else 1 << 30)).select("node", *columns)
    top = recursive(spark, query, "climbed", **frames).withColumnRenamed("subroot", "found_subroot")
    rows = runs.join(top, "run").withColumn("tail", F.lower(F.hex("proof"))).withColumn("start", F.array_distinct("first"))
    rows = rows.select("children", "tail", "folds", "start", "first", F.col("found_subroot").alias("subroot"), F.posexplode("members").alias("at", "m"))
    folded = F.element_at("folds", F.array_position("start", F.get("first", F.col("at"))).cast("int"))
    root = F.lit(manifest.root).cast("string")
    return rows.select(F.col("m.doc_id").alias("doc_id"), F.col("m.leaf").alias("leaf"), "subroot", root.alias("root"),
                       digest(left, right, F.col("tail")).alias("proof_sha256"), folded.alias("folded_root"), (folded == root).alias("verified"))


def _around(children: Column, slot: Column, value: Column) -> tuple[Column, Column, Column]:
    left, right = _parts(children, slot)
    return left, value, right


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, claim of documents; where 5 divides crc32(doc_id), the claim has the text's A-Z lower-cased."""
    def leaf(text: Column) -> Column:
        return digest(*(field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)))

    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(changed, leaf(ascii_lower(F.col("text")))).alias("claim"))


def op11_merkle(spark, sf_dir):
    """Merkle proofs of all documents, those with a tampered text among them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return climb(build(document_leaves(docs)))


OP11_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, row_number() OVER () AS r,
         coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
           || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars, '-') AS head,
         text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
), crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)) AS t
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(low)::VARCHAR || ':' || low, '-')) AS lowered,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
           lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::BIGINT])), 4294967295::UBIGINT) AS crc
  FROM d, crc_table
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaves
), up AS (
  SELECT 0 AS level, tree, pos AS idx, leaf AS digest, n FROM placed
  UNION ALL
  SELECT level + 1, tree, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (max(n) + 15) // 16 FROM up WHERE n > 1 GROUP BY level, tree, idx // 16
), subroots AS (SELECT tree, digest, level, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, tree AS idx, digest, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (max(n) + 15) // 16 FROM top WHERE n > 1 GROUP BY level, idx // 16
), path AS (
  SELECT p.tree, p.pos, p.pos AS idx, 0 AS level, false AS over, n = 1 AS done FROM placed p
  UNION ALL
  SELECT path.tree, path.pos, CASE WHEN done THEN path.tree ELSE idx // 16 END, CASE WHEN done THEN 0 ELSE path.level + 1 END, over OR done,
         CASE WHEN done THEN (SELECT max(n) FROM top) = 1 WHEN over THEN path.level + 1 = (SELECT max(level) FROM top) ELSE path.level + 1 = s.level END
  FROM path JOIN subroots s ON s.tree = path.tree WHERE NOT (over AND done)
), steps AS (
  SELECT path.tree, pos, over, path.level, path.idx, string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx < path.idx) AS l, string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx > path.idx) AS r
  FROM path JOIN (SELECT false AS o, level, tree, idx, digest FROM up UNION ALL SELECT true, level, -1, idx, digest FROM top) u
    ON u.o = over AND u.level = path.level AND u.tree = CASE WHEN over THEN -1 ELSE path.tree END AND u.idx // 16 = path.idx // 16
  WHERE NOT done GROUP BY ALL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY tree, pos ORDER BY over, level) AS k FROM steps
), fold AS (
  SELECT tree, pos, 0::BIGINT AS k, CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END AS h FROM placed
  UNION ALL
  SELECT fold.tree, fold.pos, fold.k + 1, sha256(coalesce(l, '') || h || coalesce(r, '')) FROM fold JOIN numbered x ON x.tree = fold.tree AND x.pos = fold.pos AND x.k = fold.k + 1
), folded AS (SELECT tree, pos, arg_max(h, k) AS h FROM fold GROUP BY ALL),
proofs AS (SELECT tree, pos, string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY k) AS proof FROM numbered GROUP BY ALL)
SELECT p.doc_id, p.leaf, s.digest AS subroot, root.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root, f.h = root.digest AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN (SELECT digest FROM top ORDER BY level DESC LIMIT 1) root ON true
JOIN folded f ON f.tree = p.tree AND f.pos = p.pos LEFT JOIN proofs q ON q.tree = p.tree AND q.pos = p.pos
"""
