"""Profiles, correlations and two-population drift (F1-F25 except F26/F27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation as C
from ..operators import drift as D
from ..operators import profile as P
from ..operators import sampling as S
from ..operators.ratios import RATIO_COLS
from ..sources import fixtures as FX
from ..sources.contract import ALL_FEATURES, CATEGORICAL_FEATURES
from .oracle_views import rnd, with_views
from .registry import register
from .sqlgen import describe_sql, pairs_long_ctes, q

NUMERIC_67 = [c for c in ALL_FEATURES if c not in CATEGORICAL_FEATURES] + ["days_inventory_outstanding"]
D67 = ("dataset67",)
FF = ("financial_features",)


def _d67(spark, sf_dir):
    from . import datasets as DS
    return DS.dataset67(spark, sf_dir)


def _ff(spark, sf_dir):
    from . import datasets as DS
    return DS.financial_features(spark, sf_dir)


# ----------------------------------------------------------------------------- F1 F2
@register("F1_class_balance", with_views(
    'SELECT count(*) AS total, CAST(sum("default") AS BIGINT) AS defaults, '
    'CAST(sum(1 - "default") AS BIGINT) AS non_defaults, ' + rnd('avg(CAST("default" AS DOUBLE))')
    + " AS default_rate FROM dataset67", *D67))
def q_f1(spark, sf_dir):
    """class counts and default rate."""
    return S.class_balance(_d67(spark, sf_dir))


@register("F2_class_balance_by_industry", with_views(
    'SELECT industry_code, count(*) AS total, CAST(sum("default") AS BIGINT) AS defaults, '
    + rnd('avg(CAST("default" AS DOUBLE))') + ' AS default_rate, CAST(sum(1 - "default") AS BIGINT) AS non_defaults '
    "FROM dataset67 GROUP BY industry_code", *D67))
def q_f2(spark, sf_dir):
    """class balance per industry."""
    return S.class_balance_by(_d67(spark, sf_dir))


# ----------------------------------------------------------------------------- F4 F5
F4_STATS = ("mean", "median", "std", "min", "max", "q25", "q75", "count")


@register("F4_industry_ratio_stats", with_views(
    describe_sql("financial_features", RATIO_COLS, F4_STATS, ["industry_code"]), *FF))
def q_f4(spark, sf_dir):
    """per industry x ratio: mean, median, sample std, min, max, q25, q75, count."""
    return P.industry_distribution_stats(_ff(spark, sf_dir), RATIO_COLS)


@register("F5_normal_fit", with_views(
    "SELECT industry_code, feature, 'normal' AS distribution, mean AS mu, std_pop AS sigma FROM ("
    + describe_sql("financial_features", RATIO_COLS, ("mean", "std_pop"), ["industry_code"]) + ") t", *FF))
def q_f5(spark, sf_dir):
    """normal fit per industry x ratio (mu = mean, sigma = population std)."""
    return P.normal_fit(_ff(spark, sf_dir), RATIO_COLS)


# ----------------------------------------------------------------------------- F6-F13
F6_STATS = ("count", "mean", "std", "min", "q25", "median", "q75", "max")


@register("F6_describe_table", with_views(describe_sql("dataset67", NUMERIC_67[:30], F6_STATS), *D67))
def q_f6(spark, sf_dir):
    """describe() of the first 30 numeric features."""
    return P.describe_table(_d67(spark, sf_dir), 30)


def _missing_sum_sql(cols):
    return " + ".join(f"sum(CASE WHEN {q(c)} IS NULL THEN 1 ELSE 0 END)" for c in cols)


_D67_COLS = ["sample_id", "default"] + [c for c in ALL_FEATURES if c not in
                                        ("cash_conversion_cycle", "transaction_regularity_score",
                                         "industry_risk_score")]


def _d67_columns():
    # dataset67 column order: credit_sample's, then the three derived features.
    cs = ["sample_id", "default", "revenue_growth", "profit_margin", "roa", "roe", "current_ratio",
          "quick_ratio", "debt_to_equity", "debt_to_asset", "dscr", "inventory_turnover",
          "receivable_turnover", "asset_turnover", "free_cash_flow", "operating_cash_flow_ratio",
          "days_sales_outstanding", "days_payables_outstanding", "days_inventory_outstanding"]
    rest = [c for c in ALL_FEATURES if c not in cs and c not in
            ("cash_conversion_cycle", "transaction_regularity_score", "industry_risk_score")]
    return cs + rest + ["cash_conversion_cycle", "transaction_regularity_score", "industry_risk_score"]


D67_COLUMNS = _d67_columns()


@register("F7_table_stats", with_views(
    f"SELECT count(*) AS samples, {len(NUMERIC_67)} AS numeric_features, "
    f"CAST({_missing_sum_sql(D67_COLUMNS)} AS BIGINT) AS missing_cells, "
    + rnd('avg(CAST("default" AS DOUBLE))') + " AS default_rate FROM dataset67", *D67))
def q_f7(spark, sf_dir):
    """samples, numeric feature count, missing cells, default rate."""
    return P.table_stats(_d67(spark, sf_dir))


@register("F8_industry_distribution", with_views(
    "SELECT industry_code, CASE industry_code WHEN 10 THEN 'Food Manufacturing' WHEN 46 THEN 'Wholesale' "
    "WHEN 56 THEN 'F&B' ELSE 'Industry ' || CAST(industry_code AS VARCHAR) END AS name, count(*) AS count, "
    + rnd("count(*) / sum(count(*)) OVER ()") + " AS share, "
    + rnd('avg(CAST("default" AS DOUBLE))') + " AS default_rate FROM dataset67 GROUP BY industry_code", *D67))
def q_f8(spark, sf_dir):
    """F8: industry distribution: count, share, default rate, name."""
    return P.industry_distribution(_d67(spark, sf_dir))


def _module_stats_sql():
    from ..sources.contract import MODULES
    parts = []
    for m, feats in MODULES.items():
        present = [f for f in feats if f in NUMERIC_67][:10]
        for k, f in enumerate(present, start=1):
            x = f"CAST({q(f)} AS DOUBLE)"
            parts.append(f"SELECT '{m}' AS module, {k} AS ord, '{f}' AS feature, {rnd(f'avg({x})')} AS mean, "
                         f"{rnd(f'stddev_samp({x})')} AS std, {rnd(f'min({x})')} AS min, "
                         f"{rnd(f'max({x})')} AS max FROM dataset67")
    return "\nUNION ALL\n".join(parts)


@register("F9_module_stats", with_views(_module_stats_sql(), *D67))
def q_f9(spark, sf_dir):
    """Per-module mean/std/min/max of the first 10 numeric features."""
    return P.module_stats(_d67(spark, sf_dir), 10)


def _missing_profile_sql():
    parts = [f"SELECT '{c}' AS feature, CAST(sum(CASE WHEN {q(c)} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, "
             f"count(*) AS n FROM dataset67" for c in D67_COLUMNS]
    return ("SELECT feature, missing, " + rnd("missing * 100.0 / n", 2) + " AS missing_pct FROM ("
            + "\nUNION ALL\n".join(parts) + ") t WHERE missing > 0")


@register("F10_missing_profile", with_views(_missing_profile_sql(), *D67))
def q_f10(spark, sf_dir):
    """missing-value profile (count, %, only > 0, sorted desc)."""
    return P.missing_profile(_d67(spark, sf_dir))


def _categorical_profile_sql():
    cats = CATEGORICAL_FEATURES_ORDERED
    parts = [f"SELECT '{c}' AS feature, {q(c)} AS value, count(*) AS count FROM dataset67 "
             f"WHERE {q(c)} IS NOT NULL GROUP BY {q(c)}" for c in cats]
    return ("SELECT feature, n_distinct, value, count FROM (SELECT *, count(*) OVER (PARTITION BY feature) "
            "AS n_distinct FROM (" + "\nUNION ALL\n".join(parts) + ") t) u WHERE n_distinct <= 10 UNION ALL "
            "SELECT feature, count(*), NULL, NULL FROM (" + "\nUNION ALL\n".join(parts) + ") v GROUP BY feature HAVING count(*) > 10")


# string columns of dataset67 in column order
CATEGORICAL_FEATURES_ORDERED = [c for c in D67_COLUMNS if c in CATEGORICAL_FEATURES]


@register("F11_categorical_profile", with_views(_categorical_profile_sql(), *D67))
def q_f11(spark, sf_dir):
    """distinct count of every categorical column, value counts of those with <= 10 levels."""
    return P.categorical_profile(_d67(spark, sf_dir))


def _skew_sql():
    parts = []
    for c in NUMERIC_67:
        x = f"CAST({q(c)} AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS feature, skewness({x}) AS skewness FROM dataset67")
    return ("SELECT feature, " + rnd("skewness") + " AS skewness, CASE WHEN skewness > 0 THEN 'right' "
            "ELSE 'left' END AS direction FROM (" + "\nUNION ALL\n".join(parts)
            + ") t WHERE abs(skewness) > 1")


@register("F13_skewness_report", with_views(_skew_sql(), *D67))
def q_f13(spark, sf_dir):
    """bias-corrected skewness, |skew| > 1 with left/right label."""
    return P.skewness_report(_d67(spark, sf_dir), NUMERIC_67)


# ----------------------------------------------------------------------------- F14-F16
def _corr_input(spark, sf_dir):
    # Many pair chunks re-read the input: materialise it once (reliable checkpoint).
    return _d67(spark, sf_dir).select("sample_id", "industry_code", *NUMERIC_67)


@register("F14_correlation_matrix", with_views(
    "SELECT i, j, feature_1, feature_2, " + rnd("corr") + " AS corr FROM pl_pairs", *D67,
    extra=pairs_long_ctes("dataset67", NUMERIC_67, "sample_id")))
def q_f14(spark, sf_dir):
    """pairwise-complete Pearson matrix (upper triangle, long form)."""
    return C.correlation_pairs(_corr_input(spark, sf_dir), NUMERIC_67)


_FF_RID = "(SELECT *, ticker || '|' || CAST(year AS VARCHAR) AS rid FROM financial_features)"


@register("F14b_industry_ratio_correlations", with_views(
    "SELECT industry_code, i, j, feature_1, feature_2, " + rnd("corr") + " AS corr FROM pl_pairs", *FF,
    extra=pairs_long_ctes(_FF_RID, RATIO_COLS, "rid", ["industry_code"])))
def q_f14b(spark, sf_dir):
    """per-industry correlation matrix of the 12 ratios."""
    return C.correlation_pairs(_ff(spark, sf_dir), RATIO_COLS, ["industry_code"])


def _top_pairs_sql(threshold, k):
    return ("SELECT i, j, feature_1, feature_2, " + rnd("corr") + " AS corr, " + rnd("abs(corr)")
            + f" AS abs_corr FROM pl_pairs WHERE abs(corr) > {threshold} ORDER BY abs(corr) DESC, i, j LIMIT {k}")


@register("F15_high_correlations", with_views(
    _top_pairs_sql(0.9, 10), *D67, extra=pairs_long_ctes("dataset67", NUMERIC_67, "sample_id")))
def q_f15(spark, sf_dir):
    """|r| > 0.90 pairs, top 10 by |r|."""
    return C.high_correlations(C.correlation_pairs(_corr_input(spark, sf_dir), NUMERIC_67), 0.90, 10)


@register("F15b_correlated_pairs_070", with_views(
    _top_pairs_sql(0.7, 30), *D67, extra=pairs_long_ctes("dataset67", NUMERIC_67, "sample_id")))
def q_f15b(spark, sf_dir):
    """|r| > 0.70 pairs, top 30."""
    return C.high_correlations(C.correlation_pairs(_corr_input(spark, sf_dir), NUMERIC_67), 0.70, 30)


@register("F15c_industry_top_pairs", with_views(
    "SELECT industry_code, i, j, feature_1, feature_2, " + rnd("corr") + " AS corr, " + rnd("abs(corr)")
    + " AS abs_corr, rank FROM (SELECT *, row_number() OVER (PARTITION BY industry_code ORDER BY abs(corr) DESC, i, j)"
    " AS rank FROM pl_pairs WHERE abs(corr) > 0.5) t WHERE rank <= 5", *FF,
    extra=pairs_long_ctes(_FF_RID, RATIO_COLS, "rid", ["industry_code"])))
def q_f15c(spark, sf_dir):
    """top-5 correlated ratio pairs per industry (|r| > 0.5)."""
    pairs = C.correlation_pairs(_ff(spark, sf_dir), RATIO_COLS, ["industry_code"])
    return C.high_correlations(pairs, 0.5, 5, group_cols=["industry_code"])


def _target_corr_sql():
    parts = [f"SELECT {k} AS ord, '{c}' AS feature, corr(CAST({q(c)} AS DOUBLE), CAST(\"default\" AS DOUBLE)) AS c "
             f"FROM dataset67" for k, c in enumerate(NUMERIC_67)]
    return ("SELECT ord, feature, " + rnd("c") + " AS corr, " + rnd("abs(c)") + " AS abs_corr, "
            "CASE WHEN abs(c) > 0.5 THEN 'Strong' WHEN abs(c) > 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength "
            "FROM (" + "\nUNION ALL\n".join(parts) + ") t WHERE c IS NOT NULL AND NOT isnan(c) "
            "ORDER BY abs(c) DESC, ord LIMIT 20")


@register("F16_target_correlations", with_views(_target_corr_sql(), *D67))
def q_f16(spark, sf_dir):
    """F16: correlation with the default flag, top 20, strength label."""
    return C.target_correlations(_d67(spark, sf_dir), NUMERIC_67)


def _default_cmp_sql():
    parts = []
    for c in NUMERIC_67[:30]:
        x = f"CAST({q(c)} AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS feature, avg(CASE WHEN \"default\" = 0 THEN {x} END) AS m0, "
                     f"avg(CASE WHEN \"default\" = 1 THEN {x} END) AS m1 FROM dataset67")
    return ("SELECT feature, " + rnd("m0") + " AS mean_non_default, " + rnd("m1") + " AS mean_default, "
            + rnd("abs(m1 - m0) / abs(m0) * 100") + " AS diff_pct FROM (" + "\nUNION ALL\n".join(parts)
            + ") t WHERE m0 <> 0 AND m1 IS NOT NULL ORDER BY abs(m1 - m0) / abs(m0) * 100 DESC, feature LIMIT 20")


@register("F17_default_vs_nondefault", with_views(_default_cmp_sql(), *D67))
def q_f17(spark, sf_dir):
    """default vs non-default means, % difference, top 20 of the first 30 features."""
    return P.default_vs_nondefault(_d67(spark, sf_dir))


def _cat_rates_sql():
    cols = ("owner_education", "business_zone", "collateral_type")
    parts = [f"SELECT '{c}' AS feature, {q(c)} AS value, count(*) AS count, avg(CAST(\"default\" AS DOUBLE)) AS dr "
             f"FROM dataset67 WHERE {q(c)} IS NOT NULL GROUP BY {q(c)}" for c in cols]
    return ("SELECT feature, value, count, " + rnd("count / sum(count) OVER (PARTITION BY feature)")
            + " AS share, " + rnd("dr") + " AS default_rate FROM (" + "\nUNION ALL\n".join(parts) + ") t")


@register("F18_categorical_default_rates", with_views(_cat_rates_sql(), *D67))
def q_f18(spark, sf_dir):
    """default-rate tables for education, zone and collateral type."""
    return P.categorical_default_rates(_d67(spark, sf_dir))


# ----------------------------------------------------------------------------- F19-F25
def _pops(spark, sf_dir):
    ff = _ff(spark, sf_dir)
    return ff.filter(F.col("year") < 1999), ff.filter(F.col("year") >= 1999)


POP_CTES = ["pop_a AS (SELECT * FROM financial_features WHERE year < 1999)",
            "pop_b AS (SELECT * FROM financial_features WHERE year >= 1999)"]


def _means_by_industry(table, cols, tag):
    return "\nUNION ALL\n".join(
        f"SELECT industry_code, '{c}' AS feature, avg(CAST({q(c)} AS DOUBLE)) AS mean_{tag}, "
        f"count({q(c)}) AS count_{tag} FROM {table} GROUP BY industry_code" for c in cols)


def _drift_sql():
    cols = D.DRIFT_RATIOS
    base = (f"SELECT a.industry_code, a.feature, a.mean_a, b.mean_b, "
            f"abs(b.mean_b - a.mean_a) / nullif(abs(a.mean_a), 0) * 100 AS d "
            f"FROM ({_means_by_industry('pop_a', cols, 'a')}) a JOIN ({_means_by_industry('pop_b', cols, 'b')}) b "
            f"USING (industry_code, feature)")
    return ("SELECT industry_code, feature, " + rnd("mean_a") + " AS mean_a, " + rnd("mean_b") + " AS mean_b, "
            + rnd("d") + " AS diff_pct, " + rnd("max(d) OVER (PARTITION BY industry_code)") + " AS max_diff_pct, "
            "CASE WHEN max(d) OVER (PARTITION BY industry_code) < 15 THEN 'PASS' ELSE 'FAIL' END AS status "
            f"FROM ({base}) t")


@register("F19_drift_check", with_views(_drift_sql(), *FF, extra=POP_CTES))
def q_f19(spark, sf_dir):
    """Mean drift % per industry x {roa, current_ratio, D/E}; PASS if max < 15."""
    a, b = _pops(spark, sf_dir)
    return D.drift_check(a, b)


def _summary_sql():
    def side(t, tag):
        return "\nUNION ALL\n".join(
            f"SELECT '{c}' AS feature, avg(CAST({q(c)} AS DOUBLE)) AS mean_{tag}, stddev_samp(CAST({q(c)} AS DOUBLE)) "
            f"AS std_{tag}, min(CAST({q(c)} AS DOUBLE)) AS min_{tag}, max(CAST({q(c)} AS DOUBLE)) AS max_{tag} FROM {t}"
            for c in RATIO_COLS)
    base = (f"SELECT *, abs(mean_b - mean_a) / nullif(abs(mean_a), 0) * 100 AS d FROM ({side('pop_a', 'a')}) a "
            f"JOIN ({side('pop_b', 'b')}) b USING (feature)")
    cols = [f"{s}_{t}" for t in "ab" for s in ("mean", "std", "min", "max")]
    return ("SELECT feature, " + ", ".join(rnd(c) + f" AS {c}" for c in cols) + ", " + rnd("d") + " AS diff_pct, "
            + rnd("avg(d) OVER ()") + " AS avg_error_pct, " + rnd("max(d) OVER ()") + f" AS max_error_pct FROM ({base}) t")


@register("F20_population_summary", with_views(_summary_sql(), *FF, extra=POP_CTES))
def q_f20(spark, sf_dir):
    """two-population summary over the 12 ratios with avg/max error."""
    a, b = _pops(spark, sf_dir)
    return D.summary_table(a, b, RATIO_COLS)


def _key_ratio_sql():
    cols = D.KEY_RATIOS
    base = (f"SELECT a.industry_code, a.feature, a.mean_a, b.mean_b, "
            f"abs(b.mean_b - a.mean_a) / nullif(abs(a.mean_a), 0) * 100 AS d "
            f"FROM ({_means_by_industry('pop_a', cols, 'a')}) a JOIN ({_means_by_industry('pop_b', cols, 'b')}) b "
            f"USING (industry_code, feature)")
    return ("SELECT t.industry_code, feature, " + rnd("mean_a") + " AS mean_a, " + rnd("mean_b") + " AS mean_b, "
            + rnd("d") + " AS diff_pct, na.n_a, nb.n_b FROM (" + base + ") t "
            "JOIN (SELECT industry_code, count(*) AS n_a FROM pop_a GROUP BY industry_code) na USING (industry_code) "
            "JOIN (SELECT industry_code, count(*) AS n_b FROM pop_b GROUP BY industry_code) nb USING (industry_code)")


@register("F21_industry_key_ratios", with_views(_key_ratio_sql(), *FF, extra=POP_CTES))
def q_f21(spark, sf_dir):
    """per-industry key-ratio comparison and group sizes."""
    a, b = _pops(spark, sf_dir)
    return D.industry_key_ratios(a, b)


_POP_RID = "(SELECT *, ticker || '|' || CAST(year AS VARCHAR) AS rid FROM {t})"


@register("F22_correlation_difference", with_views(
    "SELECT a.i, a.j, a.feature_1, a.feature_2, " + rnd("a.corr") + " AS corr_a, " + rnd("b.corr")
    + " AS corr_b, " + rnd("b.corr - a.corr") + " AS diff FROM pa_pairs a JOIN pb_pairs b USING (i, j)", *FF,
    extra=POP_CTES + pairs_long_ctes(_POP_RID.format(t="pop_a"), RATIO_COLS, "rid", prefix="pa")
    + pairs_long_ctes(_POP_RID.format(t="pop_b"), RATIO_COLS, "rid", prefix="pb")))
def q_f22(spark, sf_dir):
    """correlation difference matrix (b - a) over the 12 ratios."""
    a, b = _pops(spark, sf_dir)
    return C.correlation_difference(C.correlation_pairs(a, RATIO_COLS), C.correlation_pairs(b, RATIO_COLS))


def _hist_sql(cols, bins):
    stacked = "\nUNION ALL\n".join(
        f"SELECT industry_code, '{c}' AS feature, CAST({q(c)} AS DOUBLE) AS value FROM financial_features "
        f"WHERE {q(c)} IS NOT NULL" for c in cols)
    return (f"SELECT industry_code, feature, bin, {rnd(f'lo + bin * ((hi - lo) / {bins})')} AS bin_start, "
            f"{rnd(f'lo + (bin + 1) * ((hi - lo) / {bins})')} AS bin_end, count(*) AS count FROM ("
            f"SELECT s.*, b.lo, b.hi, CAST(CASE WHEN b.hi = b.lo THEN {bins // 2} ELSE "
            f"least(floor((s.value - b.lo) / ((b.hi - b.lo) / {bins})), {bins - 1}) END AS INT) AS bin "
            f"FROM ({stacked}) s JOIN (SELECT industry_code, feature, min(value) AS lo, max(value) AS hi "
            f"FROM ({stacked}) x GROUP BY industry_code, feature) b USING (industry_code, feature)) t "
            f"GROUP BY industry_code, feature, bin, lo, hi")


@register("F23_histogram_bins", with_views(_hist_sql(RATIO_COLS, 20), *FF))
def q_f23(spark, sf_dir):
    """20-bin histogram table per ratio x industry."""
    return P.histogram(_ff(spark, sf_dir), RATIO_COLS, 20, ["industry_code"])


def _box_sql(col):
    x = f"CAST({q(col)} AS DOUBLE)"
    qs = (f"SELECT industry_code, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median, "
          f"quantile_cont({x}, 0.75) AS q3 FROM financial_features GROUP BY industry_code")
    inside = "(f.x >= q.q1 - 1.5 * (q.q3 - q.q1) AND f.x <= q.q3 + 1.5 * (q.q3 - q.q1))"
    return (f"SELECT q.industry_code, {rnd('q.q1')} AS q1, {rnd('q.median')} AS median, {rnd('q.q3')} AS q3, "
            f"{rnd(f'min(CASE WHEN {inside} THEN f.x END)')} AS whisker_low, "
            f"{rnd(f'max(CASE WHEN {inside} THEN f.x END)')} AS whisker_high, "
            f"CAST(sum(CASE WHEN {inside} THEN 0 ELSE 1 END) AS BIGINT) AS outliers "
            f"FROM (SELECT industry_code, {x} AS x FROM financial_features WHERE {q(col)} IS NOT NULL) f "
            f"JOIN ({qs}) q USING (industry_code) GROUP BY q.industry_code, q.q1, q.median, q.q3")


@register("F24_boxplot_roa", with_views(_box_sql("roa"), *FF))
def q_f24(spark, sf_dir):
    """box-plot five-number table of roa per industry."""
    return P.boxplot_table(_ff(spark, sf_dir), "roa")


# The ratios of the reference's box plots, in its order.
BOX_RATIOS = ["roa", "roe", "profit_margin", "current_ratio", "debt_to_equity", "asset_turnover"]


@register("F24b_boxplot_key_ratios", with_views(
    "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, * FROM ({_box_sql(c)}) b_{c}" for c in BOX_RATIOS), *FF))
def q_f24b(spark, sf_dir):
    """box-plot tables of the six key ratios per industry."""
    return P.boxplot_tables(_ff(spark, sf_dir), BOX_RATIOS)


def _acklam_sql(p: str) -> str:
    """The inverse-normal approximation of ``columns.inverse_normal_cdf`` in SQL
    (same Horner order, so the doubles agree)."""
    from ..functions.columns import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D

    def poly(coefs, x):
        acc = repr(coefs[0])
        for k in coefs[1:]:
            acc = f"(({acc}) * {x} + {k!r})"
        return acc
    qlo = f"sqrt(-2 * ln({p}))"
    qhi = f"sqrt(-2 * ln(1 - {p}))"
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    lower = f"({poly(ACKLAM_C, qlo)}) / (({poly(ACKLAM_D, qlo)}) * {qlo} + 1)"
    central = f"({poly(ACKLAM_A, r)}) * ({p} - 0.5) / (({poly(ACKLAM_B, r)}) * {r} + 1)"
    upper = f"-({poly(ACKLAM_C, qhi)}) / (({poly(ACKLAM_D, qhi)}) * {qhi} + 1)"
    return f"CASE WHEN {p} < 0.02425 THEN {lower} WHEN {p} <= 1 - 0.02425 THEN {central} ELSE {upper} END"


def _qq_sql(col: str) -> str:
    m = ("CASE WHEN i + 1 = 1 THEN 1 - pow(0.5, 1.0 / n) WHEN i + 1 = n THEN pow(0.5, 1.0 / n) "
         "ELSE (i + 1 - 0.3175) / (n + 0.365) END")
    pts = (f"SELECT industry_code, i, value, {_acklam_sql('m')} AS theoretical FROM (SELECT *, {m} AS m FROM ("
           f"SELECT industry_code, CAST({q(col)} AS DOUBLE) AS value, row_number() OVER (PARTITION BY industry_code "
           f"ORDER BY {q(col)}) - 1 AS i, count(*) OVER (PARTITION BY industry_code) AS n FROM financial_features "
           f"WHERE {q(col)} IS NOT NULL) a) b")
    return (f"SELECT p.industry_code, p.i, {rnd('p.value')} AS value, {rnd('p.theoretical')} AS theoretical, "
            f"{rnd('f.slope')} AS slope, {rnd('f.intercept')} AS intercept FROM ({pts}) p JOIN (SELECT industry_code, "
            f"regr_slope(value, theoretical) AS slope, regr_intercept(value, theoretical) AS intercept FROM ({pts}) x "
            f"GROUP BY industry_code) f USING (industry_code)")


@register("F25_qq_table_roa", with_views(_qq_sql("roa"), *FF))
def q_f25(spark, sf_dir):
    """Q-Q table of roa per industry (ordered values vs normal quantiles + fit)."""
    return P.qq_table(_ff(spark, sf_dir), "roa", by="industry_code")
