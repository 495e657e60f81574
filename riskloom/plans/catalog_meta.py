"""Proxy scores, meta features, metrics, grades and explanations
(C11, F26, K9, K11, K12, L1-L5, L11-L19) -- all learner-free, so all SQL-checkable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import meta as MT
from ..operators import metrics as MX
from ..operators import targets as TG
from . import datasets as DS
from .catalog_clean import PREP
from .catalog_targets import _norm_sql
from .oracle_views import rnd, with_views
from .registry import register
from .sqlgen import q

D67 = ("dataset67",)
SPLITS = {"tr": "train", "va": "val", "te": "test"}


# ------------------------------------------------------------------ Spark side
class _BySplit(dict):
    """'tr', 'va', 'te' -> a split's frame, made when it is first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, split: str):
        self[split] = self.make(split)
        return self[split]


def split_targets(spark, sf_dir):
    """{'tr'|'va'|'te': preprocessed split + S1_raw..S4_raw}, each written once, when it is asked for."""
    return DS._memo(spark, sf_dir, "split_targets", lambda: _BySplit(
        lambda k: DS.materialize(MT.with_module_targets(DS.preprocessed_split(spark, sf_dir, SPLITS[k])))))


def train_ranges(spark, sf_dir):
    def build():
        t = split_targets(spark, sf_dir)["tr"]
        row = t.agg(*[F.min(f"{m}_raw").alias(f"lo_{m}") for m in TG.MODULE_SPECS],
                    *[F.max(f"{m}_raw").alias(f"hi_{m}") for m in TG.MODULE_SPECS]).first()
        return {m: (row[f"lo_{m}"], row[f"hi_{m}"]) for m in TG.MODULE_SPECS}
    return DS._memo(spark, sf_dir, "train_ranges", build)


def split_scores(spark, sf_dir):
    """{'tr'|'va'|'te': (sample_id, default, S1..S4)} learner-free scores, memoised."""
    def build():
        ranges = train_ranges(spark, sf_dir)
        tg = split_targets(spark, sf_dir)
        # a projection over the checkpointed targets: nothing to re-materialise
        return _BySplit(lambda k: MT.scale_targets(tg[k], ranges, keep=("sample_id", "default", "past_bankruptcy")))
    return DS._memo(spark, sf_dir, "proxy_scores", build)


def meta_frame(spark, sf_dir, split: str):
    s = split_scores(spark, sf_dir)[split]
    return MT.pd_standin(MT.engineer_features(s, keep=("sample_id", "default")))


def tuned_threshold(spark, sf_dir) -> float:
    return DS._memo(spark, sf_dir, "threshold", lambda: MX.best_f1_threshold(
        meta_frame(spark, sf_dir, "va"), "pd_score", "default"))


# ------------------------------------------------------------------ SQL side
def _chain_ctes(table: str, p: str) -> list[str]:
    """``{p}_all`` = table + S1_raw..S4_raw (targets chained on one frame, no joins)."""
    ctes, src = [], table
    for m, spec in TG.MODULE_SPECS.items():
        k = f"{p}_{m}"
        cur = src
        if "past_due_severity" in spec.derived:
            ctes.append(f"{k}_in AS (SELECT *, coalesce(CAST(max_past_due_days AS DOUBLE), 0.0) * "
                        f"(coalesce(CAST(num_past_due_90d AS DOUBLE), 0.0) + 1) AS past_due_severity FROM {src})")
            cur = f"{k}_in"
        normed = [c for c, _ in spec.weights if c not in spec.raw_binary]
        stats = []
        for c in normed:
            x = f"CAST({q(c)} AS DOUBLE)"
            stats += [f"min({x}) AS lo_{c}", f"max({x}) AS hi_{c}"]
            if spec.fill_median:
                stats.append(f"quantile_cont({x}, 0.5) AS md_{c}")
        ctes.append(f"{k}_st AS (SELECT {', '.join(stats)} FROM {cur})")
        terms = []
        for c, w in spec.weights:
            if c in spec.raw_binary:
                t = f"coalesce(CAST(x.{q(c)} AS DOUBLE), 0.0)"
            else:
                x = f"CAST(x.{q(c)} AS DOUBLE)"
                if spec.fill_median:
                    x = f"coalesce({x}, st.md_{c})"
                t = _norm_sql(x, f"st.lo_{c}", f"st.hi_{c}")
            terms.append(f"CAST({w!r} AS DOUBLE) * ({t})")
        drop = " EXCLUDE (past_due_severity)" if "past_due_severity" in spec.derived else ""
        ctes.append(f"{k}_sc AS (SELECT x.*{drop}, 0.0 + {' + '.join(terms)} AS _score FROM {cur} x, {k}_st st)")
        if spec.renorm_and_blend:
            ctes.append(f"{k}_ss AS (SELECT min(_score) AS slo, max(_score) AS shi FROM {k}_sc)")
            ctes.append(f"{k} AS (SELECT x.* EXCLUDE (_score), CAST(0.7 AS DOUBLE) * ({_norm_sql('x._score', 's.slo', 's.shi')}) "
                        f"+ CAST(0.3 AS DOUBLE) * (1.0 - CAST(x.\"default\" AS DOUBLE)) AS {m}_raw FROM {k}_sc x, {k}_ss s)")
        else:
            ctes.append(f"{k} AS (SELECT * EXCLUDE (_score), _score AS {m}_raw FROM {k}_sc)")
        src = k
    ctes.append(f"{p}_all AS (SELECT * FROM {src})")
    return ctes


def _clip01(e: str) -> str:
    return f"CASE WHEN ({e}) IS NULL THEN NULL ELSE greatest(least({e}, 1.0), 0.0) END"


def _score_ctes() -> list[str]:
    ctes = list(PREP)
    for p, table in (("tr", "pp_train"), ("va", "pp_val"), ("te", "pp_test")):
        ctes += _chain_ctes(table, f"ch_{p}")
    ctes.append("rng AS (SELECT " + ", ".join(f"min({m}_raw) AS lo_{m}, max({m}_raw) AS hi_{m}" for m in TG.MODULE_SPECS)
                + " FROM ch_tr_all)")
    for p in ("tr", "va", "te"):
        cols = []
        for m, spec in TG.MODULE_SPECS.items():
            s = _clip01(f"({m}_raw - lo_{m}) / CASE WHEN hi_{m} = lo_{m} THEN 1.0 ELSE hi_{m} - lo_{m} END")
            if spec.post_cap:
                s = f"CASE WHEN {spec.post_cap[0]} = 1 THEN least({s}, {spec.post_cap[1]}) ELSE {s} END"
            cols.append(f"{s} AS {m}")
        ctes.append(f"sc_{p} AS (SELECT sample_id, \"default\", past_bankruptcy, {', '.join(cols)} FROM ch_{p}_all, rng)")
        std = ("sqrt(((S1 - (S1 + S2 + S3 + S4) / 4.0) * (S1 - (S1 + S2 + S3 + S4) / 4.0) + "
               "(S2 - (S1 + S2 + S3 + S4) / 4.0) * (S2 - (S1 + S2 + S3 + S4) / 4.0) + "
               "(S3 - (S1 + S2 + S3 + S4) / 4.0) * (S3 - (S1 + S2 + S3 + S4) / 4.0) + "
               "(S4 - (S1 + S2 + S3 + S4) / 4.0) * (S4 - (S1 + S2 + S3 + S4) / 4.0)) / 3.0)")
        wavg = ("CAST(0.15 AS DOUBLE) * S1 + CAST(0.45 AS DOUBLE) * S2 + CAST(0.15 AS DOUBLE) * S3 "
                "+ CAST(0.25 AS DOUBLE) * S4")
        ctes.append(f"mf_{p} AS (SELECT sample_id, \"default\", S1, S2, S3, S4, least(S1, S2, S3, S4) AS min_score, "
                    f"S1 * S2 AS S1_x_S2, {std} AS score_std, {wavg} AS weighted_avg FROM sc_{p})")
        ctes.append(f"pd_{p} AS (SELECT *, {_clip01('1.0 - weighted_avg')} AS pd_score FROM mf_{p})")
    return ctes


SCORES = _score_ctes()


def _curve_ctes(src: str, p: str) -> list[str]:
    return [
        f"{p}_cnt AS (SELECT pd_score AS score, CAST(sum(\"default\") AS BIGINT) AS pos, "
        f"CAST(sum(1 - \"default\") AS BIGINT) AS neg FROM {src} GROUP BY pd_score)",
        f"{p}_cv AS (SELECT score, pos, neg, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, "
        f"CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp, CAST(sum(pos) OVER () AS BIGINT) AS P, "
        f"CAST(sum(neg) OVER () AS BIGINT) AS N FROM {p}_cnt)",
        f"{p}_best AS (SELECT score AS best_threshold, f1 AS best_f1 FROM (SELECT score, CASE WHEN tp > 0 THEN "
        f"CAST(2 AS DOUBLE) * tp / (tp + fp + P) ELSE 0.0 END AS f1 FROM {p}_cv) t ORDER BY f1 DESC, score ASC LIMIT 1)",
        f"{p}_m AS (SELECT CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (2 * (N - fp) + neg)) / "
        f"(CAST(2 AS DOUBLE) * max(P) * max(N)) END AS auc, CASE WHEN max(P) > 0 AND max(N) > 0 THEN "
        f"greatest(max(CAST(tp AS DOUBLE) / P - CAST(fp AS DOUBLE) / N), 0.0) END AS ks, max(P) AS positives, "
        f"max(N) AS negatives FROM {p}_cv)",
    ]


METRICS = SCORES + _curve_ctes("pd_va", "cva") + _curve_ctes("pd_te", "cte")


# ------------------------------------------------------------------ queries
MF_SQL = ", ".join(rnd(c) + f" AS {c}" for c in MT.FEATURE_COLS)


@register("L5_meta_features_val", with_views(f"SELECT sample_id, \"default\", {MF_SQL} FROM mf_va", *D67, extra=SCORES))
def q_l5(spark, sf_dir):
    """min_score, S1_x_S2, score_std (sample), weighted_avg next to S1..S4 (val)."""
    return MT.engineer_features(split_scores(spark, sf_dir)["va"], keep=("sample_id", "default"))


@register("K9_bankruptcy_cap", with_views(
    "SELECT sample_id, " + rnd("S4") + " AS S4 FROM sc_va", *D67, extra=SCORES))
def q_k9(spark, sf_dir):
    """K9: S4 after the min(S4, 0.30) rule for bankrupt companies; the others' stays (val)."""
    return split_scores(spark, sf_dir)["va"].select("sample_id", "S4")


@register("C11_standardized_meta_val", with_views(
    "SELECT sample_id, " + ", ".join(
        rnd(f"(v.{c} - s.m_{c}) / CASE WHEN s.s_{c} = 0 THEN 1.0 ELSE s.s_{c} END") + f" AS {c}" for c in MT.FEATURE_COLS)
    + " FROM mf_va v, (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in MT.FEATURE_COLS)
    + " FROM mf_tr) s", *D67, extra=SCORES))
def q_c11(spark, sf_dir):
    """C11: val meta features z-scored with train mean / population std."""
    tr = MT.engineer_features(split_scores(spark, sf_dir)["tr"])
    stats = MT.fit_standard_scaler(tr)
    va = MT.engineer_features(split_scores(spark, sf_dir)["va"], keep=("sample_id",))
    return MT.standardize(va, stats, keep=("sample_id",))


@register("L12_risk_grade_val", with_views(
    "SELECT sample_id, " + rnd("pd_score") + " AS pd_score, CASE WHEN pd_score < 0.05 THEN 'Low' WHEN pd_score < 0.15 "
    "THEN 'Medium' ELSE 'High' END AS risk_grade FROM pd_va", *D67, extra=SCORES))
def q_l12(spark, sf_dir):
    """Risk grade of the PD stand-in (val)."""
    m = meta_frame(spark, sf_dir, "va")
    return m.select("sample_id", "pd_score", MT.risk_grade("pd_score").alias("risk_grade"))


@register("L13_threshold_auc_ks_val", with_views(
    "SELECT " + rnd("auc") + " AS auc, " + rnd("ks") + " AS ks, " + rnd("best_threshold") + " AS best_threshold, "
    + rnd("best_f1") + " AS best_f1, positives, negatives FROM cva_m, cva_best", *D67, extra=METRICS))
def q_l13(spark, sf_dir):
    """Best-F1 threshold, AUC (ties half credit) and KS on val."""
    return MX.curve_metrics(MX.binary_curve(meta_frame(spark, sf_dir, "va"), "pd_score", "default"))


@register("L14_auc_ks_test", with_views(
    "SELECT " + rnd("auc") + " AS auc, " + rnd("ks") + " AS ks, positives, negatives FROM cte_m", *D67, extra=METRICS))
def q_l14(spark, sf_dir):
    """AUC and KS on test."""
    cm = MX.curve_metrics(MX.binary_curve(meta_frame(spark, sf_dir, "te"), "pd_score", "default"))
    return cm.select("auc", "ks", "positives", "negatives")


@register("L11_predict_class_test", with_views(
    "SELECT sample_id, " + rnd("pd_score") + " AS pd_score, CAST(pd_score >= (SELECT best_threshold FROM cva_best) AS INT) "
    "AS predicted FROM pd_te", *D67, extra=METRICS))
def q_l11(spark, sf_dir):
    """class = PD >= the threshold tuned on val (test)."""
    thr = tuned_threshold(spark, sf_dir)
    m = meta_frame(spark, sf_dir, "te")
    return m.select("sample_id", "pd_score", MT.predict_class("pd_score", thr).alias("predicted"))


@register("L18_validate_test", with_views(
    "SELECT " + rnd("m.auc", 4) + " AS auc, " + rnd("CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 AS DOUBLE) * tp / (2 * tp + fp + fn) ELSE 0.0 END", 4)
    + " AS f1, " + rnd("m.ks", 4) + " AS ks, " + rnd("brier", 4) + " AS brier, " + rnd("b.best_threshold", 4)
    + " AS threshold FROM cte_m m, cva_best b, (SELECT avg((CAST(\"default\" AS DOUBLE) - pd_score) * "
    "(CAST(\"default\" AS DOUBLE) - pd_score)) AS brier, sum(CASE WHEN pd_score >= (SELECT best_threshold FROM cva_best) "
    "AND \"default\" = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN pd_score >= (SELECT best_threshold FROM cva_best) AND "
    "\"default\" = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN pd_score < (SELECT best_threshold FROM cva_best) AND "
    "\"default\" = 1 THEN 1 ELSE 0 END) AS fn FROM pd_te) s", *D67, extra=METRICS), digits=4)
def q_l18(spark, sf_dir):
    """Validate row on test (auc, f1 at the val threshold, ks, brier, threshold; 4 dp)."""
    thr = tuned_threshold(spark, sf_dir)
    return MX.validate_scores(meta_frame(spark, sf_dir, "te"), "pd_score", "default", thr)


@register("L19_explain_val", with_views(
    "SELECT sample_id, pd4 AS pd_score, grade AS risk_grade, S1, S2, S3, S4, wk || ' - ' || CASE wk WHEN 'S1' THEN "
    "'Financial Health' WHEN 'S2' THEN 'Credit Behavior' WHEN 'S3' THEN 'Business Quality' ELSE 'Stability & Risk' END "
    "AS weakest_module, printf('PD = %.1f%% -> grade %s. Weakest module: %s (%.3f) - %s.', pd1, grade, CASE wk "
    "WHEN 'S1' THEN 'Financial Health' WHEN 'S2' THEN 'Credit Behavior' WHEN 'S3' THEN 'Business Quality' ELSE "
    "'Stability & Risk' END, least(S1, S2, S3, S4), CASE wk WHEN 'S1' THEN 'weak financial ratios (low ROA/DSCR/current "
    "ratio)' WHEN 'S2' THEN 'risky credit history (overdue debt or past default)' WHEN 'S3' THEN 'low business quality "
    "(experience/product/productivity)' ELSE 'low stability, high risk (industry/district risk or little collateral)' END) "
    "AS explanation FROM (SELECT *, CASE WHEN S1 = least(S1, S2, S3, S4) THEN 'S1' WHEN S2 = least(S1, S2, S3, S4) THEN "
    "'S2' WHEN S3 = least(S1, S2, S3, S4) THEN 'S3' ELSE 'S4' END AS wk FROM (SELECT sample_id, "
    + rnd("pd_score", 4) + " AS pd4, " + rnd("pd_score * 100", 1) + " AS pd1, CASE WHEN pd_score < 0.05 THEN 'Low' "
    "WHEN pd_score < 0.15 THEN 'Medium' ELSE 'High' END AS grade, " + ", ".join(rnd(c, 3) + f" AS {c}" for c in MT.SCORE_COLS)
    + " FROM pd_va) a) b", *D67, extra=SCORES))
def q_l19(spark, sf_dir):
    """Per-row explanation (PD, grade, rounded scores, weakest module, text) on val."""
    e = MT.explain(meta_frame(spark, sf_dir, "va"), keep=("sample_id",))
    return e.select("sample_id", "pd_score", "risk_grade", "scores.*", "weakest_module", "explanation")


def k11_frame(spark, sf_dir):
    ranges = train_ranges(spark, sf_dir)
    t = split_targets(spark, sf_dir)["va"]
    outs = []
    for m, spec in TG.MODULE_SPECS.items():
        lo, hi = ranges[m]
        tgt = (F.col(f"{m}_raw") - F.lit(lo)) / F.lit((hi - lo) if hi != lo else 1.0)
        pred = TG.apply_post_rule(F.greatest(F.lit(0.0), F.least(tgt, F.lit(1.0))), t.columns, spec)
        pair = t.select(tgt.alias("t"), pred.alias("p"))
        outs.append(MX.regression_metrics(pair, "t", "p").select(F.lit(m).alias("module"), "r2", "mae"))
    return reduce(lambda a, b: a.unionByName(b), outs)


def _k11_sql_full():
    parts = []
    for m, spec in TG.MODULE_SPECS.items():
        tgt = f"({m}_raw - lo_{m}) / CASE WHEN hi_{m} = lo_{m} THEN 1.0 ELSE hi_{m} - lo_{m} END"
        pred = _clip01(tgt)
        if spec.post_cap:
            pred = f"CASE WHEN {spec.post_cap[0]} = 1 THEN least({pred}, {spec.post_cap[1]}) ELSE {pred} END"
        parts.append(
            f"SELECT '{m}' AS module, {rnd('CASE WHEN sum((t - mt) * (t - mt)) > 0 THEN 1 - sum((t - p) * (t - p)) / sum((t - mt) * (t - mt)) END', 4)} "
            f"AS r2, {rnd('avg(abs(t - p))', 4)} AS mae FROM (SELECT t, p, avg(t) OVER () AS mt FROM "
            f"(SELECT {tgt} AS t, {pred} AS p FROM ch_va_all, rng) z) y")
    return "\nUNION ALL\n".join(parts)


@register("K11_r2_mae_val", with_views(_k11_sql_full(), *D67, extra=SCORES), digits=4)
def q_k11(spark, sf_dir):
    """R^2 and MAE of the clipped scores against the unclipped scaled targets (val)."""
    return k11_frame(spark, sf_dir)


@register("K12_sanity_check_val", with_views("\nUNION ALL\n".join(
    f"SELECT '{m}' AS module, {rnd(f'avg(CASE WHEN \"default\" = 0 THEN {m} END)')} AS mean_0, "
    f"{rnd(f'avg(CASE WHEN \"default\" = 1 THEN {m} END)')} AS mean_1, {rnd(f'corr({m}, CAST(\"default\" AS DOUBLE))')} AS corr, "
    f"{rnd(f'avg(CASE WHEN \"default\" = 0 THEN {m} END) - avg(CASE WHEN \"default\" = 1 THEN {m} END)')} AS gap, "
    f"CASE WHEN avg(CASE WHEN \"default\" = 0 THEN {m} END) - avg(CASE WHEN \"default\" = 1 THEN {m} END) > 0.01 THEN 'PASS' "
    f"WHEN avg(CASE WHEN \"default\" = 0 THEN {m} END) - avg(CASE WHEN \"default\" = 1 THEN {m} END) > 0 THEN 'OK' "
    f"ELSE 'WEAK' END AS status FROM sc_va" for m in TG.MODULE_SPECS), *D67, extra=SCORES))
def q_k12(spark, sf_dir):
    """Score sanity check per module on val (mean by label, gap, r, PASS/OK/WEAK)."""
    s = split_scores(spark, sf_dir)["va"]
    return reduce(lambda a, b: a.unionByName(b), [
        MX.sanity_check(s, m, "default").select(F.lit(m).alias("module"), "mean_0", "mean_1", "corr", "gap", "status")
        for m in TG.MODULE_SPECS])


@register("F26_score_summary", with_views("\nUNION ALL\n".join(
    f"SELECT '{name}' AS split, count(*) AS rows, {rnd('avg(CAST(\"default\" AS DOUBLE))')} AS default_rate, "
    + ", ".join(f"{rnd(f'avg({m})')} AS mean_{m}, {rnd(f'stddev_samp({m})')} AS std_{m}" for m in TG.MODULE_SPECS)
    + ", CAST(" + " + ".join(f"sum(CASE WHEN {m} IS NULL THEN 1 ELSE 0 END)" for m in TG.MODULE_SPECS)
    + f" AS BIGINT) AS null_scores FROM sc_{p}" for p, name in (("tr", "train"), ("va", "val"), ("te", "test"))),
    *D67, extra=SCORES))
def q_f26(spark, sf_dir):
    """per split rows, default rate, mean/std of S1..S4 and the null gate."""
    from ..operators.scoring import score_summary
    sc = split_scores(spark, sf_dir)
    return reduce(lambda a, b: a.unionByName(b), [
        score_summary(sc[p], name) for p, name in (("tr", "train"), ("va", "val"), ("te", "test"))])
