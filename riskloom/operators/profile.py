"""Statistical profiles.

Scale notes: column statistics are fused into *one* wide aggregate per pass (map-side
partial aggregation; a hot group costs nothing extra) and reshaped to long form with
``stack`` on the aggregated row(s) -- never by unpivoting the data, which would
multiply the shuffled rows by the number of features. Quantiles are exact and counted
in bounded memory (``quantiles.py``); ``approx=True`` asks for ``percentile_approx``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (approx_quantiles, inverse_normal_cdf, numeric_columns,
                                 round_half_up, safe_div)
from ..session import staged
from ..sources.contract import ALL_FEATURES, ID_COL, LABEL_COL, MODULES
from .duplicates import count_duplicates
from .quantiles import exact_quantiles

SAFE = "`{}`"


def _q(name: str) -> str:
    return SAFE.format(name)


STAT_EXPRS = {
    "count": F.count,
    "mean": F.avg,
    "std": F.stddev_samp,
    "std_pop": F.stddev_pop,
    "min": F.min,
    "max": F.max,
    "skew": F.skewness,
    "nulls": lambda c: F.sum(F.when(c.isNull(), 1).otherwise(0)),
}
QUANTILE_STATS = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def wide_to_long(wide: DataFrame, group_cols: Sequence[str], features: Sequence[str],
                 stats: Sequence[str], feature_col: str = "feature") -> DataFrame:
    """Reshape ``{stat}__{feature}`` columns to rows (feature, stat1, stat2, ...)."""
    parts = []
    for f in features:
        parts.append(f"'{f}'")
        parts += [_q(f"{s}__{f}") for s in stats]
    expr = f"stack({len(features)}, {', '.join(parts)}) AS ({feature_col}, {', '.join(stats)})"
    return wide.selectExpr(*[_q(g) for g in group_cols], expr)


def describe(df: DataFrame, cols: Sequence[str], stats: Sequence[str] = ("count", "mean", "std", "min", "max"),
             group_cols: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Long-form describe: one row per (group..., feature) with the requested stats.

    All stats of all columns are computed in a single aggregate, but for the quantiles, which
    are counted; ``count`` is the non-null count, ``std`` the sample std (pandas), quantiles linear (pandas).
    """
    wanted = [s for s in stats if s in QUANTILE_STATS]
    plain = [s for s in stats if s not in QUANTILE_STATS]
    aggs = []
    for c in cols:
        x = F.col(_q(c)).cast("double")
        for s in plain or ["count"]:
            aggs.append(STAT_EXPRS[s](x).cast("long" if s in ("count", "nulls") else "double").alias(f"{s}__{c}"))
        if approx:
            q = approx_quantiles(x, [QUANTILE_STATS[s] for s in wanted]) if wanted else None
            aggs += [q[k].cast("double").alias(f"{s}__{c}") for k, s in enumerate(wanted)]
    wide = df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)
    if approx or not wanted:
        return wide_to_long(wide, group_cols, cols, stats)
    long = wide_to_long(wide, group_cols, cols, plain or ["count"])
    found = exact_quantiles(df, {c: F.col(_q(c)) for c in cols}, [QUANTILE_STATS[s] for s in wanted], by=group_cols)
    found = found.select(*(F.col(_q(g)).alias(f"_g{k}") for k, g in enumerate(group_cols)), F.col("feature").alias("_f"),
                         *(F.col("q")[k].alias(s) for k, s in enumerate(wanted)))
    same = F.col("feature") == F.col("_f")
    for k, g in enumerate(group_cols):
        same &= F.col(_q(g)).eqNullSafe(F.col(f"_g{k}"))
    return long.join(found, same, "left").select(*(F.col(_q(g)) for g in group_cols), "feature", *stats)


def industry_distribution_stats(df: DataFrame, ratio_cols: Sequence[str], by: str = "industry_code",
                                approx: bool = False) -> DataFrame:
    """mean, median, sample std, min, max, q25, q75, non-null count per industry x ratio."""
    return describe(df, ratio_cols, ("mean", "median", "std", "min", "max", "q25", "q75", "count"),
                    group_cols=[by], approx=approx)


def normal_fit(df: DataFrame, ratio_cols: Sequence[str], by: str = "industry_code") -> DataFrame:
    """normal fit per industry x ratio: mu = mean, sigma = population std."""
    d = describe(df, ratio_cols, ("mean", "std_pop"), group_cols=[by])
    return d.select(by, "feature", F.lit("normal").alias("distribution"),
                    F.col("mean").alias("mu"), F.col("std_pop").alias("sigma"))


def feature_order(df: DataFrame) -> list[str]:
    """Numeric features in contract order (then any other numeric columns), B6."""
    nums = set(numeric_columns(df, exclude=(ID_COL, LABEL_COL)))
    ordered = [c for c in ALL_FEATURES if c in nums]
    return ordered + [c for c in numeric_columns(df, exclude=(ID_COL, LABEL_COL)) if c not in ordered]


def describe_table(df: DataFrame, first_n: int = 30, approx: bool = False) -> DataFrame:
    """count/mean/std/min/25%/50%/75%/max for the first ``first_n`` numeric features."""
    cols = feature_order(df)[:first_n]
    return describe(df, cols, ("count", "mean", "std", "min", "q25", "median", "q75", "max"),
                    approx=approx)


def table_stats(df: DataFrame, label: str = LABEL_COL) -> DataFrame:
    """samples, numeric feature count, missing cells, default rate (one pass)."""
    n_num = len(feature_order(df))
    missing = sum([F.sum(F.when(F.col(_q(c)).isNull(), 1).otherwise(0)) for c in df.columns],
                  F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("samples"),
        F.lit(n_num).alias("numeric_features"),
        missing.cast("long").alias("missing_cells"),
        F.avg(F.col(label).cast("double")).alias("default_rate"),
    )


def industry_distribution(df: DataFrame, names: dict | None = None, by: str = "industry_code",
                          label: str = LABEL_COL) -> DataFrame:
    """F8: count, share of total, default rate and name per industry."""
    from ..functions.columns import map_values
    from ..sources.contract import INDUSTRY_NAMES
    names = names or INDUSTRY_NAMES
    agg = df.groupBy(by).agg(F.count(F.lit(1)).alias("count"),
                             F.avg(F.col(label).cast("double")).alias("default_rate"))
    share = F.col("count") / F.sum("count").over(Window.partitionBy())
    name = F.coalesce(map_values(by, names), F.concat(F.lit("Industry "), F.col(by).cast("string")))
    return agg.select(by, name.alias("name"), "count", share.alias("share"), "default_rate")


def module_stats(df: DataFrame, first_n: int = 10) -> DataFrame:
    """Mean, std, min, max of the first ``first_n`` existing numeric features per module."""
    nums = set(numeric_columns(df))
    frames = []
    pairs = []
    for m, feats in MODULES.items():
        present = [f for f in feats if f in nums][:first_n]
        pairs += [(m, f, i + 1) for i, f in enumerate(present)]
    cols = sorted({f for _, f, _ in pairs}, key=lambda c: ALL_FEATURES.index(c))
    d = describe(df, cols, ("mean", "std", "min", "max"))
    spark = df.sparkSession
    mp = spark.createDataFrame(pairs, "module string, feature string, ord int")
    frames.append(mp.join(d, "feature"))
    return frames[0].select("module", "ord", "feature", "mean", "std", "min", "max")


def missing_profile(df: DataFrame) -> DataFrame:
    """per column null count and % (2 dp), only columns with nulls, sorted desc."""
    n = F.count(F.lit(1))
    aggs = [n.alias("_n")] + [F.sum(F.when(F.col(_q(c)).isNull(), 1).otherwise(0)).cast("long")
                              .alias(f"nulls__{c}") for c in df.columns]
    wide = df.agg(*aggs)
    parts = []
    for c in df.columns:
        parts += [f"'{c}'", _q(f"nulls__{c}")]
    long = wide.selectExpr("_n", f"stack({len(df.columns)}, {', '.join(parts)}) AS (feature, missing)")
    return (long.filter(F.col("missing") > 0)
            .select("feature", "missing",
                    round_half_up(F.col("missing") * 100.0 / F.col("_n"), 2).alias("missing_pct"))
            .orderBy(F.desc("missing"), "feature"))


def categorical_profile(df: DataFrame, cols: Sequence[str] | None = None, first_n: int = 10,
                        max_levels: int = 10) -> DataFrame:
    """per categorical column its distinct count, and value counts if <= max_levels.

    A column with more levels has one row, value and count NULL. One ``groupBy`` over the
    categorical columns (few, narrow); distinct counts come from the grouped frame.
    """
    from ..functions.columns import string_columns
    cols = list(cols or string_columns(df))[:first_n]
    stacked = df.selectExpr(
        f"stack({len(cols)}, " + ", ".join(f"'{c}', {_q(c)}" for c in cols) + ") AS (feature, value)")
    counts = stacked.filter(F.col("value").isNotNull()).groupBy("feature", "value").count()
    levels = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))
    listed = counts.join(levels.filter(F.col("n_distinct") <= max_levels), "feature")
    many = levels.filter(F.col("n_distinct") > max_levels).select(
        "feature", "n_distinct", F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("count"))
    return listed.select("feature", "n_distinct", "value", "count").unionByName(many)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows beyond the first occurrence (null-safe, all columns) and total missing."""
    dup = count_duplicates(df)
    missing = df.agg(sum([F.sum(F.when(F.col(_q(c)).isNull(), 1).otherwise(0)) for c in df.columns],
                         F.lit(0)).cast("long").alias("missing_cells"),
                     F.count(F.lit(1)).alias("rows"))
    return dup.crossJoin(missing)


def skewness_report(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 1.0) -> DataFrame:
    """bias-corrected sample skewness (= pandas), |skew| > threshold flagged left/right."""
    cols = list(cols or feature_order(df))
    n_aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        n_aggs += [F.skewness(x).alias(f"g1__{c}"), F.count(x).cast("double").alias(f"n__{c}")]
    wide = df.agg(*n_aggs)
    long = wide_to_long(wide, [], cols, ["g1", "n"])
    n = F.col("n")
    adj = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    out = long.select("feature", adj.alias("skewness"))
    return (out.filter(F.abs("skewness") > threshold)
            .withColumn("direction", F.when(F.col("skewness") > 0, "right").otherwise("left")))


def default_vs_nondefault(df: DataFrame, first_n: int = 30, top_k: int = 20,
                          label: str = LABEL_COL) -> DataFrame:
    """mean per class, abs % difference (skip zero base), first ``first_n`` features, top k."""
    cols = feature_order(df)[:first_n]
    y = F.col(label)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(F.when(y == 0, x)).alias(f"m0__{c}"), F.avg(F.when(y == 1, x)).alias(f"m1__{c}")]
    long = wide_to_long(df.agg(*aggs), [], cols, ["m0", "m1"])
    diff = F.when(F.col("m0") != 0, F.abs(F.col("m1") - F.col("m0")) / F.abs(F.col("m0")) * 100)
    ranked = long.select("feature", F.col("m0").alias("mean_non_default"),
                         F.col("m1").alias("mean_default"), diff.alias("diff_pct"))
    ranked = ranked.filter(F.col("diff_pct").isNotNull())
    return ranked.orderBy(F.desc("diff_pct"), "feature").limit(top_k)


def categorical_default_rates(df: DataFrame, cols: Sequence[str] = ("owner_education", "business_zone",
                                                                    "collateral_type"),
                              label: str = LABEL_COL) -> DataFrame:
    """per categorical value: count, share, default rate (NULL values excluded)."""
    stacked = df.selectExpr(
        f"`{label}` AS y",
        f"stack({len(cols)}, " + ", ".join(f"'{c}', {_q(c)}" for c in cols) + ") AS (feature, value)")
    agg = stacked.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.col("y").cast("double")).alias("default_rate"))
    share = F.col("count") / F.sum("count").over(Window.partitionBy("feature"))
    return agg.select("feature", "value", "count", share.alias("share"), "default_rate")


#: Count vectors of so many groups are held in a task; beyond it they are handed on and added later.
HELD_GROUPS = 2000


def _count_task(keys: Sequence[str], features: int, bins: int):
    """Counts of bin numbers (-1: none) by group, as one vector a feature."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out():
            rows = list(held.items())
            arrays = [pa.array([g[k] for g, _ in rows for _ in range(features)], types[k]) for k in range(len(keys))]
            arrays += [pa.array([f for _ in rows for f in range(features)], pa.int32()), pa.array([v.tolist() for _, c in rows for v in c], pa.list_(pa.int64()))]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, [*keys, "f", "counts"])

        types = None
        for part in parts:
            types = [part.column(k).type for k in keys]
            codes = np.zeros(part.num_rows, np.int64)
            groups = [()]
            if keys:
                known: dict[tuple, int] = {}
                codes = np.array([known.setdefault(g, len(known)) for g in zip(*(part.column(k).to_pylist() for k in keys))], np.int64)
                groups = list(known)
            b = part.column("b").flatten().to_numpy().reshape(part.num_rows, features).astype(np.int64)
            cell = (codes[:, None] * features + np.arange(features)) * bins + b
            counts = np.bincount(cell[b >= 0], minlength=len(groups) * features * bins).reshape(len(groups), features, bins)
            for g, c in zip(groups, counts):
                held[g] = held[g] + c if g in held else c
            if len(held) > HELD_GROUPS:
                yield out()
        if held:
            yield out()

    return run


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 20, group_cols: Sequence[str] = (),
              density: bool = False, bounds_by: Sequence[str] | None = None) -> DataFrame:
    """equal-width bin table per (group, feature): numpy ``histogram`` semantics
    (last bin closed), bins with rows only.

    Two scans: one aggregate gives all features' bounds (of the groups of ``bounds_by``, some of
    ``group_cols``, by default all), then each task counts all features' bins of its rows into vectors, which are added by
    position; rows are never unpivoted. With ``density`` count / (n * bin width).
    """
    g, bg = list(group_cols), list(group_cols if bounds_by is None else bounds_by)
    x = [F.col(_q(c)).cast("double") for c in cols]
    ends = [F.array(*map(f, x)).alias(k) for k, f in (("_lo", F.min), ("_hi", F.max))]
    bounds = staged(df.groupBy(*bg).agg(*ends) if bg else df.agg(*ends), "bounds").select(*(F.col(_q(c)).alias(f"_b{k}") for k, c in enumerate(bg)), "_lo", "_hi")
    same = F.lit(True)
    for k, c in enumerate(bg):
        same &= F.col(_q(c)).eqNullSafe(F.col(f"_b{k}"))

    def bin_of(v, i):
        lo, hi = F.get("_lo", i), F.get("_hi", i)
        return F.coalesce(F.when(v.isNull(), F.lit(-1)).when(hi == lo, F.lit(bins // 2)).otherwise(F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1))).cast("int"), F.lit(-1))

    joined = df.select(*map(_q, g), *(F.col(_q(c)) for c in bg if c not in g), F.array(*x).alias("_x"))
    joined = joined.join(bounds, same) if bg else joined.crossJoin(F.broadcast(bounds))  # without groups one row
    rows = joined.select(*map(_q, g), F.transform("_x", bin_of).alias("b"))
    schema = T.StructType([*(df.schema[c] for c in g), *T.StructType.fromDDL("f int, counts array<long>").fields])
    vectors = rows.mapInArrow(_count_task(g, len(cols), bins), schema)
    counts = (vectors.select(*map(_q, g), "f", F.posexplode("counts").alias("bin", "count")).groupBy(*map(_q, g), "f", "bin").agg(F.sum("count").alias("count")).filter("count > 0"))
    lo, hi = F.get("_lo", F.col("f")), F.get("_hi", F.col("f"))
    width = (hi - lo) / bins
    placed = counts.join(bounds, same) if bg else counts.crossJoin(F.broadcast(bounds))
    out = placed.select(*map(_q, g), F.element_at(F.array(*map(F.lit, cols)), F.col("f") + 1).alias("feature"), "bin",
                        (lo + F.col("bin") * width).alias("bin_start"), (lo + (F.col("bin") + 1) * width).alias("bin_end"), "count")
    if density:
        n = F.sum("count").over(Window.partitionBy(*map(_q, g), "feature"))  # over at most ``bins`` rows
        out = out.withColumn("density", safe_div(F.col("count").cast("double"), n * (F.col("bin_end") - F.col("bin_start"))))
    return out


def boxplot_table(df: DataFrame, col: str, by: str = "industry_code") -> DataFrame:
    """F24 for one column."""
    return boxplot_tables(df, [col], by).drop("feature")


def boxplot_tables(df: DataFrame, cols: Sequence[str], by: str = "industry_code") -> DataFrame:
    """q1, median, q3, whiskers at the last datum within 1.5 IQR, outlier count of several columns.

    All quartiles are counted together, then all whiskers and outliers in one wide aggregate; only the
    aggregated rows are stacked.
    """
    found = exact_quantiles(df, {c: F.col(_q(c)) for c in cols}, [0.25, 0.5, 0.75], by=[by])
    quartiles = found.groupBy(F.col(_q(by)).alias("_by")).agg(*(F.max(F.when(F.col("feature") == c, F.col("q"))).alias(f"_q{k}") for k, c in enumerate(cols)))
    aggs = []
    for k, c in enumerate(cols):
        x, q1, q3 = F.col(_q(c)).cast("double"), F.col(f"_q{k}")[0], F.col(f"_q{k}")[2]
        inside = (x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))
        aggs += [F.first(f"_q{k}").alias(f"_q{k}"), F.min(F.when(inside, x)).alias(f"_l{k}"), F.max(F.when(inside, x)).alias(f"_h{k}"),
                 F.count(F.when(x.isNotNull() & ~inside, 1)).alias(f"_o{k}")]
    wide = df.select(by, *cols).join(quartiles, F.col(_q(by)).eqNullSafe(F.col("_by"))).groupBy(by).agg(*aggs)
    args = ", ".join(f"'{c}', _q{k}[0], _q{k}[1], _q{k}[2], _l{k}, _h{k}, _o{k}" for k, c in enumerate(cols))
    long = wide.selectExpr(by, f"stack({len(cols)}, {args}) AS (feature, q1, median, q3, whisker_low, whisker_high, outliers)")
    return long.filter("median is not null")


def qq_table(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """F25 for one column, per group of ``by`` or pooled."""
    return qq_tables(df, [col], by).drop("feature")


def qq_tables(df: DataFrame, cols: Sequence[str], by: str | None = None) -> DataFrame:
    """ordered values vs theoretical normal quantiles (scipy probplot positions: Filliben's
    medians) + the fitted least-squares line, per column (and group).

    Every value is a row of the result, so the values are unpivoted; they are sorted once by ranges that split
    hot values and hot groups.
    """
    from .rank import position_by_value
    parts = ["feature"] + ([by] if by else [])
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(_q(c)).cast("double").alias("value")) for c in cols)))
    base = df.select(*([by] if by else []), values.alias("_v")).select(*([by] if by else []), "_v.feature", "_v.value").filter(F.col("value").isNotNull())
    ranked = position_by_value(base, "value", partition_cols=parts, out="_i")
    sizes = ranked.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))
    i, nn = F.col("_i") + 1, F.col("n").cast("double")
    last = F.pow(F.lit(0.5), 1.0 / nn)
    m = F.when(i == 1, 1 - last).when(i == F.col("n"), last).otherwise((i - 0.3175) / (nn + 0.365))
    pts = staged(ranked.join(sizes, parts).select(*parts, F.col("_i").alias("i"), "value", inverse_normal_cdf(m).alias("theoretical")), "qq_points")
    fit = pts.groupBy(*parts).agg(F.regr_slope("value", "theoretical").alias("slope"),
                                  F.regr_intercept("value", "theoretical").alias("intercept"))
    return pts.join(fit, parts)


def industry_params(features: DataFrame, ratio_cols: Sequence[str], by: str = "industry_code",
                    names: dict | None = None, approx: bool = False) -> DataFrame:
    """One nested parameter document per industry: n_samples, statistics map
    (mean/median/std/min/max/q25/q75/count per ratio), normal fits and the correlation
    matrix as map<ratio, map<ratio, r>> -- built from long-form aggregates, never on
    the driver."""
    from ..functions.columns import map_values
    from ..sources.contract import INDUSTRY_NAMES
    from .correlation import correlation_pairs
    names = names or INDUSTRY_NAMES
    st = industry_distribution_stats(features, ratio_cols, by, approx)
    fit = normal_fit(features, ratio_cols, by)
    stats = st.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct("mean", "median", "std", "min", "max", "q25", "q75", "count")))).alias("statistics"))
    dists = fit.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct("distribution", "mu", "sigma")))).alias("distributions"))
    pairs = correlation_pairs(features, ratio_cols, [by])
    sym = pairs.select(by, "feature_1", "feature_2", "corr").unionByName(
        pairs.select(by, F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"), "corr"))
    rows = sym.groupBy(by, "feature_1").agg(F.map_from_entries(F.collect_list(F.struct("feature_2", "corr"))).alias("m"))
    corr = rows.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("feature_1", "m"))).alias("correlation_matrix"))
    n = features.groupBy(by).agg(F.count(F.lit(1)).alias("n_samples"))
    name = F.coalesce(map_values(by, names), F.concat(F.lit("Industry "), F.col(by).cast("string")))
    return (n.join(stats, by).join(dists, by).join(corr, by)
            .select(F.col(by).cast("int").alias(by), name.alias("industry_name"), "n_samples", "statistics",
                    "distributions", "correlation_matrix"))
