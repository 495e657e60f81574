"""Tier-1 target proxies on the preprocessed splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import targets as TG
from ..sources import fixtures as FX
from . import datasets as DS
from .catalog_clean import PREP
from .oracle_views import rnd, with_views
from .registry import register
from .sqlgen import q

D67 = ("dataset67",)


def preprocessed(spark, sf_dir):
    """(train, val, test) after the fitted preprocessor (checkpointed, memoised)."""
    return DS.preprocessed(spark, sf_dir)


def module_target(frame, name: str):
    spec = TG.MODULE_SPECS[name]
    return TG.target_raw(TG.select_features(frame, spec), spec)


# ------------------------------------------------------------------ SQL generators
def _norm_sql(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {hi} = {lo} THEN 0.0 ELSE ({x} - {lo}) / ({hi} - {lo}) END"


def target_ctes(name: str, table: str, p: str) -> list[str]:
    """CTE ``{p}`` = (sample_id, "default", target_raw) for module ``name`` over ``table``."""
    spec = TG.MODULE_SPECS[name]
    src = table
    ctes = []
    if "past_due_severity" in spec.derived:
        ctes.append(f"{p}_in AS (SELECT *, coalesce(CAST(max_past_due_days AS DOUBLE), 0.0) * "
                    f"(coalesce(CAST(num_past_due_90d AS DOUBLE), 0.0) + 1) AS past_due_severity FROM {table})")
        src = f"{p}_in"
    normed = [c for c, _ in spec.weights if c not in spec.raw_binary]
    stats = []
    for c in normed:
        x = f"CAST({q(c)} AS DOUBLE)"
        stats += [f"min({x}) AS lo_{c}", f"max({x}) AS hi_{c}"]
        if spec.fill_median:
            stats.append(f"quantile_cont({x}, 0.5) AS md_{c}")
    ctes.append(f"{p}_st AS (SELECT {', '.join(stats)} FROM {src})")
    terms = []
    for c, w in spec.weights:
        if c in spec.raw_binary:
            t = f"coalesce(CAST({q(c)} AS DOUBLE), 0.0)"
        else:
            x = f"CAST({q(c)} AS DOUBLE)"
            if spec.fill_median:
                x = f"coalesce({x}, md_{c})"
            t = _norm_sql(x, f"lo_{c}", f"hi_{c}")
        terms.append(f"CAST({w!r} AS DOUBLE) * ({t})")
    score = "0.0 + " + " + ".join(terms)
    ctes.append(f"{p}_sc AS (SELECT sample_id, \"default\", {score} AS score FROM {src}, {p}_st)")
    if spec.renorm_and_blend:
        ctes.append(f"{p}_ss AS (SELECT min(score) AS slo, max(score) AS shi FROM {p}_sc)")
        ctes.append(f"{p} AS (SELECT sample_id, \"default\", CAST(0.7 AS DOUBLE) * ({_norm_sql('score', 'slo', 'shi')}) "
                    f"+ CAST(0.3 AS DOUBLE) * (1.0 - CAST(\"default\" AS DOUBLE)) AS target_raw FROM {p}_sc, {p}_ss)")
    else:
        ctes.append(f"{p} AS (SELECT sample_id, \"default\", score AS target_raw FROM {p}_sc)")
    return ctes


def all_target_ctes() -> list[str]:
    ctes = list(PREP)
    for m in TG.MODULE_SPECS:
        for split, table in (("tr", "pp_train"), ("va", "pp_val"), ("te", "pp_test")):
            ctes += target_ctes(m, table, f"t_{m}_{split}")
        ctes.append(f"sc_{m} AS (SELECT min(target_raw) AS lo, max(target_raw) AS hi FROM t_{m}_tr)")
    return ctes


TARGETS = all_target_ctes()


def scaled_sql(m: str, split: str) -> str:
    return (f"(SELECT sample_id, \"default\", (target_raw - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END AS "
            f"target FROM t_{m}_{split}, sc_{m})")


# ------------------------------------------------------------------ queries
@register("J1_minmax_norm", with_views(
    "SELECT sample_id, " + rnd(_norm_sql("roa", "lo_r", "hi_r")) + " AS roa_norm, "
    + rnd(_norm_sql("CAST(has_collateral AS DOUBLE)", "lo_h", "hi_h")) + " AS has_collateral_norm, "
    + rnd(_norm_sql("CAST(industry_lifecycle_stage = 'Growth' AND industry_code = 0 AS INT)", "0", "0"))
    + " AS constant_norm FROM dataset67, (SELECT min(roa) AS lo_r, max(roa) AS hi_r, "
    "CAST(min(has_collateral) AS DOUBLE) AS lo_h, CAST(max(has_collateral) AS DOUBLE) AS hi_h FROM dataset67) s", *D67))
def q_j1(spark, sf_dir):
    """Min-max normalisation over the frame (a constant column -> 0)."""
    d = DS.dataset67(spark, sf_dir).withColumn(
        "_const", ((F.col("industry_lifecycle_stage") == "Growth") & (F.col("industry_code") == 0)).cast("int"))
    n = TG.with_norms(d, ["roa", "has_collateral", "_const"], fill_median=False)
    return n.select("sample_id", F.col("_n_roa").alias("roa_norm"),
                    F.col("_n_has_collateral").alias("has_collateral_norm"), F.col("_n__const").alias("constant_norm"))


def _target_query(m: str):
    def fn(spark, sf_dir):
        tr, _, _ = preprocessed(spark, sf_dir)
        return module_target(tr, m).select("sample_id", "default", "target_raw")
    return fn


for _m, _key, _doc in (("S1", "J2_S1_financial_target", "J2: S1 financial-health target (70/30 blend)"),
                       ("S2", "J3_S2_credit_target", "J3: S2 credit-behaviour target (no blend)"),
                       ("S3", "J4_S3_business_target", "J4: S3 business-quality target (70/30 blend)"),
                       ("S4", "J5_S4_stability_target", "J5: S4 stability target (70/30 blend)")):
    _f = _target_query(_m)
    _f.__doc__ = _doc + " on the preprocessed train split."
    register(_key, with_views(f"SELECT sample_id, \"default\", {rnd('target_raw')} AS target_raw FROM t_{_m}_tr",
                              *D67, extra=TARGETS))(_f)


def scaled_targets(spark, sf_dir, split: int):
    """Targets of a split (its own frame statistics, T8) scaled with train's range."""
    frames = preprocessed(spark, sf_dir)
    outs = []
    for m in TG.MODULE_SPECS:
        lo, hi = TG.fit_target_scaler(module_target(frames[0], m))
        raw = module_target(frames[split], m)
        outs.append(TG.scale_target(raw, lo, hi, out=m).select("sample_id", "default", m))
    return reduce(lambda a, b: a.join(b, ["sample_id", "default"]), outs)


def _j6_sql():
    ms = list(TG.MODULE_SPECS)
    alias = {m: f"x{i}" for i, m in enumerate(ms)}
    sel = ", ".join(f"{rnd(alias[m] + '.target')} AS {m}" for m in ms)
    frm = f"{scaled_sql(ms[0], 'va')} {alias[ms[0]]}" + "".join(
        f" JOIN {scaled_sql(m, 'va')} {alias[m]} USING (sample_id, \"default\")" for m in ms[1:])
    return f"SELECT sample_id, \"default\", {sel} FROM {frm}"


@register("J6_scaled_targets_val", with_views(_j6_sql(), *D67, extra=TARGETS))
def q_j6(spark, sf_dir):
    """Val targets scaled with train's min/max (not clipped)."""
    return scaled_targets(spark, sf_dir, 1)


@register("J7_target_diagnostics", with_views(
    "\nUNION ALL\n".join(
        f"SELECT '{m}' AS module, {rnd('avg(target)')} AS mean, {rnd('stddev_pop(target)')} AS std, "
        f"{rnd('corr(target, CAST(\"default\" AS DOUBLE))')} AS corr_default FROM {scaled_sql(m, 'tr')} t"
        for m in TG.MODULE_SPECS), *D67, extra=TARGETS))
def q_j7(spark, sf_dir):
    """Scaled train target mean, population std, correlation with default."""
    tr, _, _ = preprocessed(spark, sf_dir)
    outs = []
    for m in TG.MODULE_SPECS:
        raw = module_target(tr, m)
        lo, hi = TG.fit_target_scaler(raw)
        d = TG.target_diagnostics(TG.scale_target(raw, lo, hi))
        outs.append(d.select(F.lit(m).alias("module"), "*"))
    return reduce(lambda a, b: a.unionByName(b), outs)
