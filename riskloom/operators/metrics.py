"""Regression and binary-classification metrics.

Classification metrics first collapse rows to one row per distinct score with
(positives, negatives) -- a partial aggregate, so a score value shared by a third of
all rows becomes a single row -- then take running totals in descending score order
with the bucketed prefix-sum primitive (never a global window):

* tp(t), fp(t) = positives / negatives with score >= t
* F1(t) = 2 tp / (tp + fp + P); best = max F1, ties -> smallest t (sklearn PR curve)
* KS = max(tp/P - fp/N), floored at 0 (the ROC curve starts at (0, 0))
* AUC = sum_t pos_t * (2 * (N - fp(t)) + neg_t) / (2 P N)  -- ties get half credit;
  the numerator is an integer sum, so it is exact and engine-independent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_corr
from .rank import quantile_bucket, running_totals


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg) per distinct score value."""
    y = F.col(label).cast("long")
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def binary_curve(df: DataFrame, score: str, label: str, n_buckets: int | None = None) -> DataFrame:
    """One row per distinct score with running tp / fp (score >= t) and totals P, N."""
    sc = score_counts(df, score, label).withColumn("_desc", -F.col("score"))
    sc = quantile_bucket(sc, "_desc", n_buckets)
    cum = running_totals(sc, [F.col("_desc")], {"tp": F.col("pos"), "fp": F.col("neg")})
    totals = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return cum.drop("_desc").crossJoin(F.broadcast(totals))


def curve_metrics(curve: DataFrame) -> DataFrame:
    """AUC, KS, best-F1 threshold and its F1 from a ``binary_curve`` frame (one row)."""
    P, N = F.col("P"), F.col("N")
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + P)).otherwise(F.lit(0.0))
    auc_num = F.col("pos") * (2 * (N - F.col("fp")) + F.col("neg"))
    ks = F.try_divide(F.col("tp"), P) - F.try_divide(F.col("fp"), N)
    agg = curve.agg(
        F.sum(auc_num).alias("_auc_num"), F.first("P").alias("P"), F.first("N").alias("N"),
        F.max(ks).alias("_ks"),
        F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("neg_t"))).alias("_best"),
    )
    valid = (F.col("P") > 0) & (F.col("N") > 0)
    return agg.select(
        F.when(valid, F.try_divide(F.col("_auc_num"), 2.0 * F.col("P") * F.col("N"))).alias("auc"),
        F.when(valid, F.greatest(F.col("_ks"), F.lit(0.0))).alias("ks"),
        (-F.col("_best.neg_t")).alias("best_threshold"),
        F.col("_best.f1").alias("best_f1"),
        F.col("P").alias("positives"), F.col("N").alias("negatives"),
    )


def best_f1_threshold(df: DataFrame, score: str, label: str) -> float:
    """The tuned threshold as a driver scalar (one aggregate row)."""
    return curve_metrics(binary_curve(df, score, label)).first()["best_threshold"]


def threshold_metrics(df: DataFrame, score: str, label: str, threshold: float | str) -> DataFrame:
    """Brier score and F1 at a fixed threshold (0 if undefined), one pass."""
    thr = F.lit(threshold) if not isinstance(threshold, str) else F.col(threshold)
    y = F.col(label).cast("double")
    p = F.col(score).cast("double")
    pred = (p >= thr).cast("double")
    agg = df.agg(
        F.avg((y - p) * (y - p)).alias("brier"),
        F.sum(pred * y).alias("_tp"), F.sum(pred * (1 - y)).alias("_fp"), F.sum((1 - pred) * y).alias("_fn"))
    denom = 2 * F.col("_tp") + F.col("_fp") + F.col("_fn")
    return agg.select("brier", F.when(denom > 0, 2 * F.col("_tp") / denom).otherwise(F.lit(0.0)).alias("f1"))


def validate_scores(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """Auc, f1 (at threshold), ks, brier, threshold -- one row."""
    cm = curve_metrics(binary_curve(df, score, label))
    tm = threshold_metrics(df, score, label, threshold)
    return cm.crossJoin(tm).select("auc", "f1", "ks", "brier", F.lit(float(threshold)).alias("threshold"))


def regression_metrics(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """R^2 = 1 - SS_res / SS_tot and MAE (two aggregate passes, 1 row each)."""
    mean = df.agg(F.avg(target).alias("_m"))
    j = df.crossJoin(F.broadcast(mean))
    t, p = F.col(target), F.col(prediction)
    agg = j.agg(F.sum((t - p) * (t - p)).alias("ss_res"), F.sum((t - F.col("_m")) * (t - F.col("_m"))).alias("ss_tot"),
                F.avg(F.abs(t - p)).alias("mae"))
    return agg.select(F.when(F.col("ss_tot") > 0, 1 - F.col("ss_res") / F.col("ss_tot")).alias("r2"), "mae")


def sanity_check(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mean score per class, gap = mean(0) - mean(1), r; PASS > 0.01, OK > 0, else WEAK."""
    y = F.col(label)
    agg = df.agg(F.avg(F.when(y == 0, F.col(score))).alias("mean_0"),
                 F.avg(F.when(y == 1, F.col(score))).alias("mean_1"),
                 safe_corr(score, y).alias("corr"))
    gap = F.col("mean_0") - F.col("mean_1")
    return agg.withColumn("gap", gap).withColumn(
        "status", F.when(gap > 0.01, "PASS").when(gap > 0, "OK").otherwise("WEAK"))
