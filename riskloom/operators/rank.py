"""Distributed order positions and running sums (G3, G4, I3) -- the one hard primitive.

A window without ``partitionBy`` puts every row into one task, and a stratum window
puts a whole (possibly huge, possibly skewed) stratum into one task. Instead:

1. derive a *monotone* bucket from the order key (leading hex digits of an md5 key, as many
   as the rows need, or approximate-quantile boundaries of distinct numbers), so a hot
   stratum is split into many similar-sized pieces;
2. aggregate bucket totals -- at most strata x buckets rows -- and turn them into
   exclusive prefix offsets with a window partitioned by stratum (each partition holds
   at most ``buckets`` rows);
3. join the offsets back on (stratum, bucket): that join's hash partitioning is the
   same one the in-bucket window needs, so the big side is shuffled exactly once;
4. position / running sum = offset + in-bucket running window.

Positions by a value, where a third of the rows may share one, need no bucket: the rows are dealt to
tasks by ranges of (stratum, value, ties, place in the file), which splits equal rows too, sorted there, and a
row's position is its number in the task plus the offset of its stratum's first row (``position_by_value``).

The DuckDB oracles express the same thing as a plain ``row_number()`` / ``sum() OVER``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from math import ceil

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: Rows that a bucket should hold; the number of buckets follows from the rows.
BUCKET_ROWS = 50_000


def buckets_for(rows: int) -> int:
    return max(1, ceil(rows / BUCKET_ROWS))


def digits_for(rows: int) -> int:
    """Hex digits that give at least ``buckets_for(rows)`` buckets."""
    n, digits = buckets_for(rows), 1
    while 16 ** digits < n:
        digits += 1
    return digits


def md5_key(*parts: str | Column, seed: int | str = 42) -> Column:
    """Portable seeded order key: ``md5(p1|p2|...|seed)`` (same text in DuckDB)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed))))


def hex_prefix_int(key: str | Column, digits: int) -> Column:
    """Integer value of the first ``digits`` hex characters (monotone in the key)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(k, 1, digits), 16, 10).cast("long")


def hex_bucket(key: str | Column, digits: int) -> Column:
    return hex_prefix_int(key, digits)


def quantile_bucket(df: DataFrame, col: str, n_buckets: int | None = None,
                    rel_error: float = 0.001) -> DataFrame:
    """Add ``_b``: equal-depth bucket of numeric ``col`` (approx quantiles + Bucketizer), as many as the rows need.

    For distinct values: rows of one value share a bucket. Only ``n_buckets`` boundary values travel to the
    driver; NULLs go to an extra bucket.
    """
    n_buckets = buckets_for(df.count()) if n_buckets is None else n_buckets
    rel_error = min(rel_error, 0.1 / n_buckets)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    qs = df.approxQuantile(col, probs, rel_error) if n_buckets > 1 else []
    splits = sorted({q for q in qs if q is not None})
    if not splits:
        return df.withColumn("_b", F.col(col).isNull().cast("long"))
    splits = [float("-inf")] + splits + [float("inf")]
    bk = Bucketizer(splits=splits, inputCol=col, outputCol="_b", handleInvalid="keep")
    return bk.transform(df).withColumn("_b", F.col("_b").cast("long"))


def running_totals(df: DataFrame, order_cols: Sequence[Column | str],
                   values: Mapping[str, Column], partition_cols: Sequence[str] = (),
                   bucket: Column | None = None, inclusive: bool = True) -> DataFrame:
    """Add one running-sum column per entry of ``values``, in ``order_cols`` order within
    ``partition_cols``. ``bucket`` must be monotone (non-decreasing) in the order, or
    the input must already carry a ``_b`` column. Ties in ``order_cols`` are broken
    arbitrarily (ROWS frame) -- give unique keys for deterministic positions.
    """
    part = list(partition_cols)
    b = df if bucket is None else df.withColumn("_b", bucket)
    for name, v in values.items():
        b = b.withColumn(f"_v_{name}", v)
    totals = b.groupBy(*part, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    wo = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, "_b", *[
        F.coalesce(F.sum(f"_t_{n}").over(wo), F.lit(0)).alias(f"_o_{n}") for n in values])
    joined = b.join(offsets, part + ["_b"])
    wi = Window.partitionBy(*part, "_b").orderBy(*order_cols)
    frame = wi.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    out = joined
    for n in values:
        run = F.coalesce(F.sum(f"_v_{n}").over(frame), F.lit(0))
        out = out.withColumn(n, F.col(f"_o_{n}") + run)
    # keep the input's column order (a USING join moves the keys to the front)
    keep = [c for c in df.columns if c not in values and c != "_b"]
    return out.select(*keep, *values.keys())


def position_by_hash(df: DataFrame, key: str, partition_cols: Sequence[str] = (),
                     out: str = "pos", digits: int | None = None) -> DataFrame:
    """0-based position of each row when sorted by the md5 hex ``key`` within strata.

    The key spreads evenly, so that its leading digits (as many as the rows need) split any stratum."""
    digits = digits_for(df.count()) if digits is None else digits
    r = running_totals(df, [F.col(key)], {out: F.lit(1).cast("long")}, partition_cols,
                       bucket=hex_bucket(key, digits))
    return r.withColumn(out, F.col(out) - 1)


def sorted_parts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` written in the order of ``keys`` with ``_id``: task number and row number of a sort by ranges.

    The place in the written input is the last key, so that rows equal in all keys are split among tasks too.
    """
    rows = staged(df, "unsorted").withColumn("_at", F.monotonically_increasing_id())
    order = [*(F.col(f"`{k}`").asc_nulls_first() for k in keys), F.col("_at")]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_at")
    return staged(parts.withColumn("_id", F.monotonically_increasing_id()), "sorted")


def position_by_value(df: DataFrame, order_col: str, tie_cols: Sequence[str] = (),
                      partition_cols: Sequence[str] = (), out: str = "pos") -> DataFrame:
    """0-based position by a column (ties broken by ``tie_cols``, then by place) within strata.

    One shuffle by ranges and no window over rows: neither a hot value nor a hot stratum fills a task. The
    offsets come from a table of tasks x strata rows at most.
    """
    part = [f"`{c}`" for c in partition_cols]
    rows = sorted_parts(df, [*partition_cols, order_col, *tie_cols])
    task, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(task.alias("_part"), *part).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*(part or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", *(F.col(p).alias(f"_s{k}") for k, p in enumerate(part)), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_offset"))
    same = task == F.col("_part")
    for k, p in enumerate(part):
        same &= F.col(p).eqNullSafe(F.col(f"_s{k}"))
    keep = [f"`{c}`" for c in df.columns if c != out]
    return rows.join(staged(offsets, "offsets"), same).select(*keep, (at + F.col("_offset")).alias(out))


def seeded_shuffle(df: DataFrame, id_cols: Sequence[str], seed: int = 42,
                   out: str = "shuffle_pos") -> DataFrame:
    """A reproducible random permutation: position by ``md5(ids|seed)``."""
    keyed = df.withColumn("_shuffle_key", md5_key(*id_cols, seed=seed))
    return position_by_hash(keyed, "_shuffle_key", out=out).drop("_shuffle_key")


def renumber(df: DataFrame, order_col: str, tie_cols: Sequence[str] = (),
             out: str = "sample_id") -> DataFrame:
    """Ids 1..n in ``order_col`` order (after a union)."""
    r = position_by_value(df, order_col, tie_cols, out="_pos")
    return r.withColumn(out, F.col("_pos") + 1).drop("_pos")
