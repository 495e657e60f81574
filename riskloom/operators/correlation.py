"""Correlation operators.

Pearson with pairwise-complete observations (a row counts for a pair when both sides are present,
like pandas). Pair matrices of any width are one pass of per-task moments; a few columns against
one target are one aggregate of ``safe_corr``. A side that is constant over its rows gives NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_corr
from ..sources.contract import LABEL_COL

def pairs_of(cols: Sequence[str]) -> list[tuple[int, int, str, str]]:
    return [(i, j, cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1, len(cols))]


def high_correlations(corr_long: DataFrame, threshold: float = 0.90, top_k: int | None = 10,
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """Pairs with |r| > threshold, by |r| desc (ties in feature order); top k
    overall, or per group with ``group_cols``. Operates on the small pair frame."""
    hits = corr_long.filter(F.abs("corr") > threshold).withColumn("abs_corr", F.abs("corr"))
    order = [F.desc("abs_corr"), F.col("i"), F.col("j")]
    if group_cols:
        w = Window.partitionBy(*group_cols).orderBy(*order)
        ranked = hits.withColumn("rank", F.row_number().over(w))
        return ranked.filter(F.col("rank") <= top_k) if top_k else ranked
    ranked = hits.orderBy(*order)
    return ranked.limit(top_k) if top_k else ranked


def target_correlations(df: DataFrame, cols: Sequence[str], label: str = LABEL_COL,
                        top_k: int = 20) -> DataFrame:
    """F16: corr(feature, default), top k by |r|, Strong (>0.5) / Moderate (>0.3) / Weak."""
    aggs = [safe_corr(c, label).alias(f"t{k}")
            for k, c in enumerate(cols)]
    args = ", ".join(f"{k}, '{c}', `t{k}`" for k, c in enumerate(cols))
    long = df.agg(*aggs).selectExpr(f"stack({len(cols)}, {args}) AS (ord, feature, corr)")
    long = long.filter(F.col("corr").isNotNull())
    a = F.abs("corr")
    strength = F.when(a > 0.5, "Strong").when(a > 0.3, "Moderate").otherwise("Weak")
    return (long.withColumn("abs_corr", a).withColumn("strength", strength)
            .orderBy(F.desc("abs_corr"), "ord").limit(top_k))


def correlation_difference(corr_a: DataFrame, corr_b: DataFrame) -> DataFrame:
    """b - a per feature pair (both small long frames)."""
    a = corr_a.select("i", "j", "feature_1", "feature_2", F.col("corr").alias("corr_a"))
    b = corr_b.select("i", "j", F.col("corr").alias("corr_b"))
    return a.join(b, ["i", "j"]).withColumn("diff", F.col("corr_b") - F.col("corr_a"))


def _moment_rows(cols: list[str], gcols: list[str]):
    """Per-partition pairwise-complete moments (numpy on Arrow batches)."""
    import numpy as np
    import pandas as pd

    d = len(cols)
    iu, ju = np.triu_indices(d, k=1)

    def run(batches):
        acc: dict = {}
        for pdf in batches:
            groups = pdf.groupby(gcols, dropna=False, sort=False) if gcols else [((), pdf)]
            for key, sub in groups:
                x = sub[cols].to_numpy(dtype="float64", na_value=np.nan)
                m = ~np.isnan(x)
                x0 = np.where(m, x, 0.0)
                mf = m.astype("float64")
                k = key if isinstance(key, tuple) else (key,)
                a = acc.get(k)
                part = (mf.T @ mf, x0.T @ mf, (x0 * x0).T @ mf, x0.T @ x0)
                low = np.stack([np.where(m[:, [c]] & m, x, np.inf).min(axis=0, initial=np.inf) for c in range(d)], axis=1)
                high = np.stack([np.where(m[:, [c]] & m, x, -np.inf).max(axis=0, initial=-np.inf) for c in range(d)], axis=1)
                acc[k] = (part, low, high) if a is None else (
                    tuple(p + q for p, q in zip(a[0], part)), np.minimum(a[1], low), np.maximum(a[2], high))
        for k, ((n, sx, sxx, sxy), low, high) in acc.items():
            out = pd.DataFrame({"i": iu.astype("int32"), "j": ju.astype("int32"),
                                "n": n[iu, ju], "sx": sx[iu, ju], "sy": sx[ju, iu],
                                "sxx": sxx[iu, ju], "syy": sxx[ju, iu], "sxy": sxy[iu, ju],
                                "lx": low[iu, ju], "hx": high[iu, ju], "ly": low[ju, iu], "hy": high[ju, iu]})
            for g, v in zip(gcols, k):
                out.insert(0, g, v)
            yield out
    return run


def correlation_pairs(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """long-form upper triangle (group..., i, j, feature_1, feature_2, corr).

    One pass for any number of columns: centre every column by its (group) mean, then each task sums
    n, sum x, sum y, sum x^2, sum y^2, sum xy over rows where both sides are present,
    for all pairs at once (BLAS on Arrow batches), and their extremes; a groupBy adds the task
    partials. NULL where a side is constant over the pair's rows (pandas: NaN)."""
    cols, g = list(cols), list(group_cols)
    xs = [f"_x{k}" for k in range(len(cols))]
    means = (df.groupBy(*g) if g else df.groupBy()).agg(
        *[F.avg(F.col(c).cast("double")).alias(f"_mu{k}") for k, c in enumerate(cols)])
    base = df.select(*g, *[F.col(c).cast("double").alias(x) for c, x in zip(cols, xs)])
    # grouped means: one row per group, broadcast after a size check (a shuffle by group
    # would put a hot group into one task); global means: a single row
    j = base.join(means, g) if g else base.crossJoin(F.broadcast(means))
    centred = j.select(*g, *[(F.col(x) - F.col(f"_mu{k}")).alias(x) for k, x in enumerate(xs)])
    gtypes = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name in g}
    schema = ", ".join([f"{c} {gtypes[c]}" for c in g] + ["i int", "j int", "n double", "sx double", "sy double",
                                                          "sxx double", "syy double", "sxy double", "lx double", "hx double", "ly double", "hy double"])
    parts = centred.mapInPandas(_moment_rows(xs, g), schema)
    tot = parts.groupBy(*g, "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")],
                                          F.min("lx").alias("lx"), F.max("hx").alias("hx"), F.min("ly").alias("ly"), F.max("hy").alias("hy"))
    n = F.col("n")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = n * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = n * F.col("syy") - F.col("sy") * F.col("sy")
    varied = (F.col("lx") < F.col("hx")) & (F.col("ly") < F.col("hy"))
    r = F.when(varied & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    names = F.create_map(*[v for k, c in enumerate(cols) for v in (F.lit(k), F.lit(c))])
    return tot.select(*g, "i", "j", names[F.col("i")].alias("feature_1"), names[F.col("j")].alias("feature_2"),
                      F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))).alias("corr"))
