"""Tier-1 module specs, feature selection and target proxies.

A target is computed with two one-row aggregates over the frame it is given (feature
medians/minima/maxima, then the score's range) attached by broadcast -- exactly the
"statistics of whatever frame is passed" semantics of the reference (T8).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.contract import (ID_COL, LABEL_COL, MODULE1_FEATURES, MODULE2_FEATURES,
                                MODULE3_FEATURES, MODULE4_FEATURES)
from ..functions.columns import safe_corr
from .features import past_due_severity
from .quantiles import medians

BLEND_PROXY = 0.70
BLEND_LABEL = 0.30
NO_LABEL_SIGNAL = 0.5


@dataclass(frozen=True)
class ModuleSpec:
    """A tier-1 module: features, signed target weights and target options."""
    name: str
    features: tuple
    weights: tuple            # ((column, signed weight), ...) in the reference's order
    fill_median: bool = True
    renorm_and_blend: bool = True
    raw_binary: tuple = ()    # columns added as w * fillna(0), not normalised
    expand_one_hot: bool = False
    post_cap: tuple | None = None   # (flag column, cap): flag == 1 -> min(score, cap)
    derived: tuple = field(default=())


# Target weights of the four modules (live code values, SURVEY §2 J).
MODULE_SPECS = {
    "S1": ModuleSpec("S1", tuple(MODULE1_FEATURES), (
        ("roa", 0.25), ("dscr", 0.20), ("current_ratio", 0.20), ("profit_margin", 0.15),
        ("revenue_growth", 0.10), ("debt_to_asset", -0.10)), fill_median=False),
    "S2": ModuleSpec("S2", tuple(MODULE2_FEATURES), (
        ("max_past_due_days", -0.35), ("num_past_due_90d", -0.25), ("past_due_severity", -0.15),
        ("cic_score", 0.15), ("previous_default_history", -0.05), ("credit_history_length", 0.05)),
        renorm_and_blend=False, raw_binary=("previous_default_history",), derived=("past_due_severity",)),
    "S3": ModuleSpec("S3", tuple(MODULE3_FEATURES), (
        ("owner_experience", 0.20), ("business_age", 0.15), ("product_differentiation_score", 0.15),
        ("digital_footprint", 0.10), ("employee_productivity_score", 0.10), ("supplier_relationships", 0.10),
        ("owner_education", 0.05), ("business_certification_count", 0.05),
        ("customer_concentration", -0.10), ("industry_competition_intensity", -0.10))),
    "S4": ModuleSpec("S4", tuple(MODULE4_FEATURES), (
        ("years_at_current_location", 0.20), ("ownership_stability", 0.15), ("has_collateral", 0.10),
        ("collateral_value", 0.07), ("collateral_liquidity_score", 0.05),
        ("industry_risk_score", -0.15), ("district_risk_score", -0.10), ("past_bankruptcy", -0.10),
        ("industry_changes_count", -0.05), ("loan_to_value", -0.03)),
        expand_one_hot=True, post_cap=("past_bankruptcy", 0.30)),
}


def select_columns(spec: ModuleSpec, columns: list[str]) -> list[str]:
    """The module's model inputs given a frame's columns (fixed order)."""
    if not spec.expand_one_hot:
        return list(spec.features)
    out = []
    for f in spec.features:
        if f in columns:
            out.append(f)
        else:
            out += [c for c in columns if c.startswith(f + "_")]
    return out


def select_features(df: DataFrame, spec: ModuleSpec, keep: tuple = (ID_COL, LABEL_COL)) -> DataFrame:
    """B2/B3 as a projection: absent inputs become literal 0.0."""
    cols = select_columns(spec, df.columns)
    exprs = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in cols]
    return df.select(*[k for k in keep if k in df.columns], *exprs)


def minmax_norm(x: Column, lo: Column, hi: Column) -> Column:
    """(x - lo) / (hi - lo); a constant column gives 0 for every row."""
    return F.when(hi == lo, F.lit(0.0)).otherwise((x - lo) / (hi - lo))


def with_norms(df: DataFrame, cols: list[str], fill_median: bool, prefix: str = "_n_") -> DataFrame:
    """Add ``{prefix}{c}`` = norm(c filled with this frame's median) for each column."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"_lo_{c}"), F.max(x).alias(f"_hi_{c}")]
    middle = medians(df, {c: F.col(c) for c in cols}) if fill_median else {}
    out = df.crossJoin(F.broadcast(df.agg(*aggs)))
    for c in cols:
        x = F.col(c).cast("double")
        if fill_median:
            x = F.coalesce(x, F.lit(middle[c]).cast("double"))
        out = out.withColumn(f"{prefix}{c}", minmax_norm(x, F.col(f"_lo_{c}"), F.col(f"_hi_{c}")))
    return out.drop(*[f"_{k}_{c}" for c in cols for k in ("lo", "hi")])


def target_raw(df: DataFrame, spec: ModuleSpec, label: str | None = LABEL_COL,
               out: str = "target_raw") -> DataFrame:
    """The module's unscaled target proxy on the frame it is given."""
    return fused_targets(df, {out: spec}, label)


def fused_targets(df: DataFrame, specs: dict, label: str | None = LABEL_COL) -> DataFrame:
    """Several modules' target proxies in a few passes over ``df`` in total: one fused
    aggregate of every weight column's minimum and maximum, the exact medians of all columns that need one, one projection of all scores,
    one fused aggregate of the score ranges (for re-normalised modules). ``specs`` maps
    output column -> ModuleSpec. Chaining modules one by one would nest each module's
    aggregates inside the next one's plan."""
    x = df
    derived = any("past_due_severity" in s.derived for s in specs.values())
    add_sev = derived and "past_due_severity" not in x.columns and \
        {"max_past_due_days", "num_past_due_90d"} <= set(x.columns)
    if add_sev:
        x = x.withColumn("past_due_severity", past_due_severity())
    aggs, plans, filled = [], {}, set()
    for k, (out, spec) in enumerate(specs.items()):
        used = [(c, w) for c, w in spec.weights if c in x.columns]
        normed = [c for c, _ in used if c not in spec.raw_binary]
        plans[out] = (k, spec, used, normed)
        for c in normed:
            v = F.col(c).cast("double")
            aggs += [F.min(v).alias(f"_lo{k}_{c}"), F.max(v).alias(f"_hi{k}_{c}")]
            if spec.fill_median:
                filled.add(c)
    middle = medians(x, {c: F.col(c) for c in sorted(filled)}) if filled else {}
    stats = x.agg(*aggs)
    x = x.crossJoin(F.broadcast(stats))
    for out, (k, spec, used, normed) in plans.items():
        score = F.lit(0.0)
        for c, w in used:
            if c in spec.raw_binary:
                term = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            else:
                v = F.col(c).cast("double")
                if spec.fill_median:
                    v = F.coalesce(v, F.lit(middle[c]).cast("double"))
                term = minmax_norm(v, F.col(f"_lo{k}_{c}"), F.col(f"_hi{k}_{c}"))
            score = score + F.lit(w) * term
        x = x.withColumn(f"_score{k}", score)
    x = x.drop(*stats.columns)
    blend = {out: p for out, p in plans.items() if p[1].renorm_and_blend}
    if blend:
        rng = x.agg(*[F.min(f"_score{p[0]}").alias(f"_slo{p[0]}") for p in blend.values()],
                    *[F.max(f"_score{p[0]}").alias(f"_shi{p[0]}") for p in blend.values()])
        x = x.crossJoin(F.broadcast(rng))
    signal = (F.lit(1.0) - F.col(label).cast("double")) if label and label in x.columns else F.lit(NO_LABEL_SIGNAL)
    for out, (k, spec, used, normed) in plans.items():
        if spec.renorm_and_blend:
            stab = minmax_norm(F.col(f"_score{k}"), F.col(f"_slo{k}"), F.col(f"_shi{k}"))
            x = x.withColumn(out, F.lit(BLEND_PROXY) * stab + F.lit(BLEND_LABEL) * signal)
        else:
            x = x.withColumn(out, F.col(f"_score{k}"))
    temps = [f"_score{p[0]}" for p in plans.values()]
    if blend:
        temps += rng.columns
    if add_sev:
        temps.append("past_due_severity")
    return x.drop(*temps)


def fit_target_scaler(train_raw: DataFrame, col: str = "target_raw") -> tuple[float, float]:
    """Train min and max of the raw target (one aggregate row)."""
    r = train_raw.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return r["lo"], r["hi"]


def scale_target(df: DataFrame, lo: float, hi: float, col: str = "target_raw", out: str = "target") -> DataFrame:
    """MinMaxScaler.transform with train's range; not clipped; zero range -> scale 1."""
    rng = (hi - lo) if hi != lo else 1.0
    return df.withColumn(out, (F.col(col) - F.lit(lo)) / F.lit(rng))


def target_diagnostics(df: DataFrame, col: str = "target", label: str = LABEL_COL) -> DataFrame:
    """Mean, population std and Pearson r with the label."""
    return df.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"),
                  safe_corr(col, label).alias("corr_default"))


def apply_post_rule(score: Column, df_cols: list[str], spec: ModuleSpec) -> Column:
    """K9: bankrupt companies are capped (S4: min(score, 0.30))."""
    if spec.post_cap and spec.post_cap[0] in df_cols:
        flag, cap = spec.post_cap
        return F.when(F.col(flag) == 1, F.least(score, F.lit(cap))).otherwise(score)
    return score
