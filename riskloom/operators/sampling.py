"""Oversampling, seeded shuffles, stratified splits and CV folds.

Randomness is replaced by portable md5 keys so that a split is a pure function of
(ids, seed) -- reproducible across runs, executor losses and engines (the DuckDB
oracle recomputes the very same split). numpy's permutation is not reproducible in
Spark, so the reference's exact rows are not the target; its arithmetic is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from ..sources.contract import ID_COL, LABEL_COL
from .rank import hex_prefix_int, md5_key, position_by_hash, position_by_value

CLONE_COL = "clone_ord"
SPLIT_COL = "split"


def class_balance(df: DataFrame, label: str = LABEL_COL) -> DataFrame:
    """total, defaults, non-defaults, default rate."""
    y = F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(y).cast("bigint").alias("defaults"),
        F.sum(1 - y).cast("bigint").alias("non_defaults"),
        F.avg(y.cast("double")).alias("default_rate"),
    )


def class_balance_by(df: DataFrame, by: str = "industry_code", label: str = LABEL_COL) -> DataFrame:
    """class balance per industry."""
    y = F.col(label)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(y).cast("bigint").alias("defaults"),
        F.avg(y.cast("double")).alias("default_rate"),
        F.sum(1 - y).cast("bigint").alias("non_defaults"),
    )


def clones_needed(n_total: int, n_pos: int, target_rate: float) -> int:
    """x = int((t*N - D) / (1 - t)); <= 0 means no-op."""
    return int((target_rate * n_total - n_pos) / (1 - target_rate))


def oversample_minority(df: DataFrame, label: str = LABEL_COL, target_rate: float = 0.085,
                        seed: int = 42, id_col: str = ID_COL) -> DataFrame:
    """Append ``x`` minority clones drawn with replacement; adds ``clone_ord``
    (0 = original row, i >= 1 = i-th draw).

    The two counts come back as one aggregate row. Minority rows get positions
    0..D-1 by a seeded md5 key (distributed rank); draw i picks position
    ``md5('draw'|i|seed) mod D``. Draws are generated by ``spark.range`` (no driver
    data) and equi-joined to the ranked minority on position.
    """
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("d")).first()
    n_total, n_pos = int(row["n"]), int(row["d"] or 0)
    x = clones_needed(n_total, n_pos, target_rate)
    base = df.withColumn(CLONE_COL, F.lit(0).cast("long"))
    if x <= 0 or n_pos == 0:
        return base
    spark = df.sparkSession
    minority = df.filter(F.col(label) == 1).withColumn("_mk", md5_key(id_col, seed=seed))
    ranked = position_by_hash(minority, "_mk", out="_pos").drop("_mk")
    draws = spark.range(x).select(
        (F.col("id") + 1).alias(CLONE_COL),
        F.pmod(hex_prefix_int(md5_key(F.lit("draw"), F.col("id"), seed=seed), 15),
               F.lit(n_pos)).alias("_pos"))
    clones = draws.join(ranked, "_pos").select(*df.columns, CLONE_COL)
    return base.unionByName(clones)


def shuffle_key(id_col: str = ID_COL, seed: int = 42, clone_col: str | None = CLONE_COL) -> Column:
    parts = [id_col] + ([clone_col] if clone_col else [])
    return md5_key(*parts, seed=seed)


def stratified_split(df: DataFrame, strata: Sequence[str] = ("industry_code", LABEL_COL),
                     train_size: float = 0.70, val_size: float = 0.15, seed: int = 42,
                     id_col: str = ID_COL, clone_col: str | None = CLONE_COL) -> DataFrame:
    """Per stratum, shuffled by md5(id|clone|seed): first int(n*train) rows train,
    next int(n*val) val, rest test. Adds ``split``; empty strata simply do not occur.

    Positions come from the bucketed rank, so a stratum holding a third of all rows
    is spread over thousands of tasks; stratum sizes are one small aggregate.
    """
    if clone_col and clone_col not in df.columns:
        clone_col = None
    keyed = df.withColumn("_sk", shuffle_key(id_col, seed, clone_col))
    ranked = position_by_hash(keyed, "_sk", partition_cols=list(strata), out="_pos")
    # one row per stratum, broadcast after a size check: re-shuffling the ranked rows by
    # stratum would pull a hot stratum back into a single task
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    j = ranked.join(sizes, list(strata))
    n_train = F.floor(F.col("_n") * F.lit(float(train_size)))
    n_val = F.floor(F.col("_n") * F.lit(float(val_size)))
    split = (F.when(F.col("_pos") < n_train, "train")
             .when(F.col("_pos") < n_train + n_val, "val").otherwise("test"))
    return j.select(*df.columns, split.alias(SPLIT_COL))


def split_summary(df: DataFrame, label: str = LABEL_COL) -> DataFrame:
    """rows, share of total, default rate per split (share via a window over the
    three aggregated rows, not over the data)."""
    agg = df.groupBy(SPLIT_COL).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col(label).cast("double")).alias("default_rate"))
    total = F.sum("rows").over(Window.partitionBy())
    return agg.withColumn("share", F.col("rows") / total)


def split_industry_mix(df: DataFrame, by: str = "industry_code") -> DataFrame:
    """industry count and share within each split."""
    agg = df.groupBy(SPLIT_COL, by).agg(F.count(F.lit(1)).alias("rows"))
    return agg.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(SPLIT_COL)))


def contiguous_folds(df: DataFrame, order_key: str, k: int = 5, out: str = "fold") -> DataFrame:
    """G7 (regression CV): unshuffled KFold -- the first n % k folds get one extra row."""
    ranked = staged(position_by_value(df, order_key, out="_pos"), "positions")
    n = ranked.count()
    base, extra = divmod(n, k)
    # boundary of fold f = f*base + min(f, extra)
    big = (base + 1) * extra
    fold = F.when(F.col("_pos") < F.lit(big), F.floor(F.col("_pos") / F.lit(base + 1))) \
        .otherwise(F.lit(extra) + F.floor((F.col("_pos") - F.lit(big)) / F.lit(max(base, 1))))
    return ranked.withColumn(out, fold.cast("int")).drop("_pos")


def stratified_folds(df: DataFrame, label: str = LABEL_COL, k: int = 5, seed: int = 42,
                     id_col: str = ID_COL, out: str = "fold") -> DataFrame:
    """G7 (classifier CV): within each class, shuffled position mod k."""
    keyed = df.withColumn("_fk", md5_key(id_col, F.lit("fold"), seed=seed))
    r = position_by_hash(keyed, "_fk", partition_cols=[label], out="_pos")
    return r.withColumn(out, (F.col("_pos") % k).cast("int")).drop("_fk", "_pos")

