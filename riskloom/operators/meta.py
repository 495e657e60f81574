"""Tier-2 meta features, scaling, grades and explanations
plus the learner-free proxy scores used to exercise them (FIXTURES §4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, round_half_up, row_sample_std
from .targets import MODULE_SPECS, apply_post_rule, fused_targets

SCORE_COLS = ["S1", "S2", "S3", "S4"]
FEATURE_COLS = ["S1", "S2", "S3", "S4", "min_score", "S1_x_S2", "score_std", "weighted_avg"]
# Composite weights, grade cut-offs and module labels.
WEIGHTED_AVG = {"S1": 0.15, "S2": 0.45, "S3": 0.15, "S4": 0.25}
GRADE_LOW, GRADE_MEDIUM = 0.05, 0.15
MODULE_LABELS = {"S1": "Financial Health", "S2": "Credit Behavior", "S3": "Business Quality",
                 "S4": "Stability & Risk"}
REASONS = {
    "S1": "weak financial ratios (low ROA/DSCR/current ratio)",
    "S2": "risky credit history (overdue debt or past default)",
    "S3": "low business quality (experience/product/productivity)",
    "S4": "low stability, high risk (industry/district risk or little collateral)",
}


def engineer_features(df: DataFrame, keep: tuple = ()) -> DataFrame:
    """The 8 meta features in fixed order (+ ``keep`` passthrough columns)."""
    s = [F.col(c) for c in SCORE_COLS]
    wavg = (F.lit(WEIGHTED_AVG["S1"]) * s[0] + F.lit(WEIGHTED_AVG["S2"]) * s[1]
            + F.lit(WEIGHTED_AVG["S3"]) * s[2] + F.lit(WEIGHTED_AVG["S4"]) * s[3])
    return df.select(
        *keep, *SCORE_COLS,
        F.least(*s).alias("min_score"),
        (s[0] * s[1]).alias("S1_x_S2"),
        row_sample_std(SCORE_COLS).alias("score_std"),
        wavg.alias("weighted_avg"),
    )


def fit_standard_scaler(df: DataFrame, cols=tuple(FEATURE_COLS)) -> dict:
    """C11: train mean and *population* std per feature (sklearn StandardScaler)."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def standardize(df: DataFrame, stats: dict, keep: tuple = ()) -> DataFrame:
    """C11: (x - mean) / std; a zero std scales by 1 (sklearn)."""
    out = [F.col(k) for k in keep]
    for c, (m, s) in stats.items():
        out.append(((F.col(c) - F.lit(m)) / F.lit(s if s else 1.0)).alias(c))
    return df.select(*out)


def risk_grade(pd_col: str | Column = "pd_score") -> Column:
    """PD < 0.05 Low, < 0.15 Medium, else High."""
    p = F.col(pd_col) if isinstance(pd_col, str) else pd_col
    return F.when(p < GRADE_LOW, "Low").when(p < GRADE_MEDIUM, "Medium").otherwise("High")


def predict_class(pd_col: str, threshold: float) -> Column:
    """PD >= tuned threshold."""
    return (F.col(pd_col) >= F.lit(float(threshold))).cast("int")


def explain(df: DataFrame, pd_col: str = "pd_score", keep: tuple = ()) -> DataFrame:
    """L19 vectorised over all rows: PD (4 dp), grade, scores (3 dp), weakest module
    (minimum of the rounded scores, first on ties) and a templated sentence.

    Rounding is half-up in plain IEEE arithmetic (``round_half_up``) so text and numbers
    are engine-independent; the numbers are rounded before they are formatted.
    """
    r = {c: round_half_up(F.col(c), 3) for c in SCORE_COLS}
    base = df.select(*keep, F.col(pd_col).alias("_pd"), *[r[c].alias(c) for c in SCORE_COLS])
    m = F.least(*[F.col(c) for c in SCORE_COLS])
    weakest = (F.when(F.col("S1") == m, "S1").when(F.col("S2") == m, "S2")
               .when(F.col("S3") == m, "S3").otherwise("S4"))
    label = F.create_map(*[x for k, v in MODULE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    reason = F.create_map(*[x for k, v in REASONS.items() for x in (F.lit(k), F.lit(v))])
    base = base.withColumn("_wk", weakest).withColumn("_min", m)
    grade = risk_grade("_pd")
    text = F.format_string("PD = %.1f%% -> grade %s. Weakest module: %s (%.3f) - %s.",
                           round_half_up(F.col("_pd") * 100, 1), grade, label[F.col("_wk")],
                           F.col("_min"), reason[F.col("_wk")])
    return base.select(
        *keep, round_half_up(F.col("_pd"), 4).alias("pd_score"), grade.alias("risk_grade"),
        F.struct(*SCORE_COLS).alias("scores"),
        F.concat(F.col("_wk"), F.lit(" - "), label[F.col("_wk")]).alias("weakest_module"),
        text.alias("explanation"),
    )


def with_module_targets(frame: DataFrame, label: str | None = "default") -> DataFrame:
    """All four raw targets on one frame (``S1_raw`` ... ``S4_raw``) -- no joins needed."""
    return fused_targets(frame, {f"{m}_raw": spec for m, spec in MODULE_SPECS.items()}, label)


def proxy_scores(frame: DataFrame, ranges: dict, keep: tuple = ("sample_id", "default")) -> DataFrame:
    """Learner-free S1..S4: raw targets scaled with train ranges, clipped to [0, 1]
    (K8) and the bankruptcy cap (K9) applied."""
    return scale_targets(with_module_targets(frame), ranges, keep)


def scale_targets(t: DataFrame, ranges: dict, keep: tuple = ("sample_id", "default")) -> DataFrame:
    """Scale ``{m}_raw`` columns with train ranges, clip to [0, 1], apply the post rule."""
    cols = []
    for m, spec in MODULE_SPECS.items():
        lo, hi = ranges[m]
        scaled = (F.col(f"{m}_raw") - F.lit(lo)) / F.lit((hi - lo) if hi != lo else 1.0)
        cols.append(apply_post_rule(clip(scaled, 0.0, 1.0), t.columns, spec).alias(m))
    return t.select(*keep, *cols)


def pd_standin(df: DataFrame, out: str = "pd_score") -> DataFrame:
    """PD stand-in without a learner: 1 - weighted_avg, clipped to [0, 1]."""
    return df.withColumn(out, clip(F.lit(1.0) - F.col("weighted_avg"), 0.0, 1.0))
