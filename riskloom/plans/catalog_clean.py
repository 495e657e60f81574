"""Contract checks and preprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as CL
from ..sources import contract as CT
from ..sources import fixtures as FX
from . import datasets as DS
from .catalog_profile import D67_COLUMNS
from .oracle_views import oversample_ctes, rnd, split_ctes, with_views
from .registry import register
from .sqlgen import q

D67 = ("dataset67",)


def _ff_memo(spark, sf_dir):
    from . import datasets as DS_
    return DS_.financial_features(spark, sf_dir)
SP = oversample_ctes() + split_ctes()

# Documented fixture domains of the one-hot columns (FIXTURES.md §3); the Spark side
# discovers them from train at fit time.
ONE_HOT_DOMAIN = {
    "business_zone": ["CBD", "Industrial", "Suburban", "Urban"],
    "industry_lifecycle_stage": ["Growth", "Mature"],
    "collateral_type": ["Inventory", "Machinery", "None", "Real Estate"],
}
FEATURES_IN = [c for c in D67_COLUMNS if c not in ("sample_id", "default")]


def _fitted(spark, sf_dir):
    return DS.splits(spark, sf_dir), DS.fitted_preprocessor(spark, sf_dir)


def _prep_ctes() -> list[str]:
    """train (deduped) / val / test through C2..C7 as DuckDB CTEs ``pp_train`` etc."""
    ctes = list(SP)
    ctes.append("tr_raw AS (SELECT DISTINCT * EXCLUDE (clone_ord, split) FROM splits WHERE split = 'train')")
    ctes.append("va_raw AS (SELECT * EXCLUDE (clone_ord, split) FROM splits WHERE split = 'val')")
    ctes.append("te_raw AS (SELECT * EXCLUDE (clone_ord, split) FROM splits WHERE split = 'test')")
    recalc = ("CASE WHEN total_outstanding_debt / nullif(avg_monthly_deposits * 12, 0) IS NULL THEN NULL "
              "ELSE greatest(least(total_outstanding_debt / nullif(avg_monthly_deposits * 12, 0), 10.0), 0.0) END")
    money = CL.LOG_TRANSFORM_COLS
    for p in ("tr", "va", "te"):
        ctes.append(f"{p}_c2a AS (SELECT * REPLACE (CASE WHEN has_collateral = 0 AND collateral_type IS NULL "
                    f"THEN 'None' ELSE collateral_type END AS collateral_type) FROM {p}_raw)")
        ctes.append(f"{p}_mode AS (SELECT collateral_type AS m FROM {p}_c2a WHERE collateral_type IS NOT NULL "
                    f"GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
        ctes.append(f"{p}_c2 AS (SELECT * REPLACE (coalesce(collateral_type, (SELECT m FROM {p}_mode)) "
                    f"AS collateral_type) FROM {p}_c2a)")
    ctes.append(f"dbr_diag AS (SELECT avg(CASE WHEN debt_burden_ratio = 3.0 THEN 1.0 ELSE 0.0 END) AS pct_at_cap, "
                f"corr(debt_burden_ratio, {recalc}) AS corr FROM tr_c2)")
    ctes.append("shifts AS (SELECT " + ", ".join(
        f"CASE WHEN min({c}) < 0 THEN abs(min({c})) + 1 ELSE 0.0 END AS {c}" for c in money) + " FROM tr_c2)")
    edu = ("CASE owner_education WHEN 'THPT' THEN 1.0 WHEN 'CĐ' THEN 2.0 WHEN 'ĐH' THEN 3.0 "
           "WHEN 'Master' THEN 4.0 ELSE 2.0 END")
    dummies = []
    for col, vals in ONE_HOT_DOMAIN.items():
        for v in vals:
            dummies.append(f"CASE WHEN {col} = '{v}' THEN 1 ELSE 0 END AS {q(col + '_' + v)}")
    logs = ", ".join(f"CASE WHEN x.{c} + s.{c} > -1 THEN ln(1 + (x.{c} + s.{c})) END AS {c}" for c in money)
    for p in ("tr", "va", "te"):
        # C3 'drop' branch, guarded: the oracle returns no rows if train asks for 'recalc'.
        ctes.append(
            f"{p}_c6 AS (SELECT x.* EXCLUDE (debt_burden_ratio, owner_education, business_zone, "
            f"industry_lifecycle_stage, collateral_type, {', '.join(money)}), {edu} AS owner_education, "
            f"{', '.join(dummies)}, {logs} FROM {p}_c2 x, shifts s "
            f"WHERE (SELECT corr IS NULL OR isnan(corr) OR abs(corr) <= 0.3 FROM dbr_diag))")
    numeric = [c for c in FEATURES_IN if c not in CL.ONE_HOT_COLS and c != "debt_burden_ratio"]
    nulls = " + ".join(f"sum(CASE WHEN {q(c)} IS NULL THEN 1 ELSE 0 END)" for c in numeric)
    ctes.append(f"tr_nulls AS (SELECT {nulls} AS n FROM tr_c6)")
    ctes.append("meds AS (SELECT " + ", ".join(
        f"CASE WHEN (SELECT n FROM tr_nulls) > 0 THEN quantile_cont({q(c)}, 0.5) END AS {q(c)}" for c in numeric)
        + " FROM tr_c6)")
    # integer fixture columns are never NULL; keeping them unfilled keeps their type
    fills = ", ".join((f"x.{q(c)}" if c in CT.INT_FEATURES else f"coalesce(x.{q(c)}, m.{q(c)}) AS {q(c)}")
                      for c in numeric)
    for p, name in (("tr", "pp_train"), ("va", "pp_val"), ("te", "pp_test")):
        ctes.append(f"{name} AS (SELECT x.sample_id, x.\"default\", {fills}, "
                    + ", ".join(f"x.{q(col + '_' + v)}" for col, vals in ONE_HOT_DOMAIN.items() for v in vals)
                    + f" FROM {p}_c6 x, meds m)")
    return ctes


PREP = _prep_ctes()
PP_NUMERIC = [c for c in FEATURES_IN if c not in CL.ONE_HOT_COLS and c != "debt_burden_ratio"]
PP_DUMMIES = [f"{col}_{v}" for col, vals in ONE_HOT_DOMAIN.items() for v in vals]


def _pp_select(table: str) -> str:
    return ("SELECT sample_id, \"default\", " + ", ".join(
        (q(c) if c in CT.INT_FEATURES else rnd(q(c)) + f" AS {q(c)}") for c in PP_NUMERIC)
            + ", " + ", ".join(q(c) for c in PP_DUMMIES) + f" FROM {table}")


# ----------------------------------------------------------------------------- A / B
@register("A4_label_contract", with_views(
    'SELECT count(*) AS n_rows, CAST(sum(CASE WHEN "default" IS NULL OR "default" NOT IN (0, 1) THEN 1 ELSE 0 END) '
    'AS BIGINT) AS n_bad_label, ' + rnd('avg(CAST("default" AS DOUBLE))') + ' AS default_rate, '
    '(count(*) > 0 AND sum(CASE WHEN "default" IS NULL OR "default" NOT IN (0, 1) THEN 1 ELSE 0 END) = 0) AS ok '
    "FROM dataset67", *D67))
def q_a4(spark, sf_dir):
    """A4: label contract (non-empty, values in {0,1}) as one aggregate."""
    return CT.label_check(DS.dataset67(spark, sf_dir))


@register("A1_split_stats", with_views(
    'SELECT split, count(*) AS rows, 70 AS cols, ' + rnd('avg(CAST("default" AS DOUBLE))')
    + " AS default_rate FROM splits GROUP BY split", *D67, extra=SP))
def q_a1(spark, sf_dir):
    """A1/A3: per split rows, columns (69 + clone ordinal) and default rate."""
    sp = DS.splits(spark, sf_dir)
    ncols = len([c for c in sp.columns if c not in ("split", "clone_ord")])
    return sp.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.lit(ncols).alias("cols"),
                                   F.avg(F.col("default").cast("double")).alias("default_rate"))


@register("B5_contract_projection", with_views(
    "SELECT " + ", ".join(q(c) for c in ["sample_id", "default"]) + ", "
    + ", ".join((rnd(q(c)) + f" AS {q(c)}") if c not in CT.INT_FEATURES and c not in CT.CATEGORICAL_FEATURES
                else q(c) for c in CT.ALL_FEATURES) + " FROM dataset67", *D67))
def q_b5(spark, sf_dir):
    """sample_id, default + the 67 contract features (days_inventory_outstanding dropped)."""
    return CT.project_contract(DS.dataset67(spark, sf_dir))


def _coverage_sql(source_cols, ok_at, warn_at):
    rows = ", ".join(f"('{m}', '{f}')" for m, fs in CT.MODULES.items() for f in fs)
    present = ", ".join(f"('{c}')" for c in source_cols)
    return ("SELECT module, count(*) AS expected, CAST(sum(CASE WHEN p.feature IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) "
            "AS found, count(*) - sum(CASE WHEN p.feature IS NOT NULL THEN 1 ELSE 0 END) AS missing, "
            + rnd("sum(CASE WHEN p.feature IS NOT NULL THEN 1 ELSE 0 END) * 100.0 / count(*)", 2) + " AS coverage_pct, "
            f"CASE WHEN sum(CASE WHEN p.feature IS NOT NULL THEN 1 ELSE 0 END) * 100.0 / count(*) >= {ok_at} THEN 'OK' "
            f"WHEN sum(CASE WHEN p.feature IS NOT NULL THEN 1 ELSE 0 END) * 100.0 / count(*) >= {warn_at} THEN 'WARN' "
            f"ELSE 'FAIL' END AS status FROM (VALUES {rows}) AS e(module, feature) "
            f"LEFT JOIN (VALUES {present}) AS p(feature) USING (feature) GROUP BY module")


CS_COLUMNS = [c for c in D67_COLUMNS if c not in ("cash_conversion_cycle", "transaction_regularity_score",
                                                 "industry_risk_score")]


@register("B9_coverage_credit_sample", _coverage_sql(CS_COLUMNS, 100.0, 80.0), digits=2)
def q_b9(spark, sf_dir):
    """Contract coverage of credit_sample (3 derived features still missing)."""
    return CT.coverage_report(FX.credit_sample(spark, sf_dir, _ff_memo(spark, sf_dir)), 100.0, 80.0)


@register("B9b_coverage_dataset67", _coverage_sql(D67_COLUMNS, 80.0, 50.0), digits=2)
def q_b9b(spark, sf_dir):
    """Coverage of the completed table with the (80, 50) thresholds."""
    return CT.coverage_report(DS.dataset67(spark, sf_dir), 80.0, 50.0)


@register("I2_missing_features", "SELECT * FROM (VALUES " + ", ".join(
    f"('{f}', '{m}', {i + 1})" for m, fs in CT.MODULES.items() for i, f in enumerate(fs)
    if f not in CS_COLUMNS) + ") AS t(feature, module, ord)")
def q_i2(spark, sf_dir):
    """Contract features absent from credit_sample (left_anti on name frames)."""
    return CT.missing_features(FX.credit_sample(spark, sf_dir, _ff_memo(spark, sf_dir)))


# ----------------------------------------------------------------------------- C
@register("C1_dedup_train", with_views(
    "SELECT sample_id, \"default\" FROM tr_raw", *D67, extra=PREP))
def q_c1(spark, sf_dir):
    """Full-row de-duplication of the train split (clones whose twin is in train drop)."""
    sp = DS.splits(spark, sf_dir)
    tr = DS.distinct_train(spark, sf_dir)
    return tr.select("sample_id", "default")


@register("C2_collateral_fill_val", with_views(
    "SELECT sample_id, collateral_type FROM va_c2", *D67, extra=PREP))
def q_c2(spark, sf_dir):
    """collateral_type fill on the val split ('None' without collateral, else val's mode)."""
    sp = DS.splits(spark, sf_dir)
    va = sp.filter(F.col("split") == "val")
    return CL.fix_collateral_type(va).select("sample_id", "collateral_type")


@register("C3_debt_burden_diagnostics", with_views(
    "SELECT " + rnd("pct_at_cap") + " AS pct_at_cap, " + rnd("corr") + " AS corr, CASE WHEN corr IS NOT NULL "
    "AND NOT isnan(corr) AND abs(corr) > 0.3 THEN 'recalc' ELSE 'drop' END AS strategy FROM dbr_diag", *D67,
    extra=PREP))
def q_c3(spark, sf_dir):
    """Share at the 3.0 cap, r(original, recalculated) and the frozen strategy."""
    sp = DS.splits(spark, sf_dir)
    tr = CL.fix_collateral_type(DS.distinct_train(spark, sf_dir))
    d = CL.debt_burden_diagnostics(tr)
    ok = F.col("corr").isNotNull() & ~F.isnan("corr") & (F.abs("corr") > CL.DEBT_CORR_MIN)
    return d.withColumn("strategy", F.when(ok, "recalc").otherwise("drop"))


@register("C4_education_ordinal", with_views(
    "SELECT sample_id, owner_education, CASE owner_education WHEN 'THPT' THEN 1.0 WHEN 'CĐ' THEN 2.0 "
    "WHEN 'ĐH' THEN 3.0 WHEN 'Master' THEN 4.0 ELSE 2.0 END AS education_level FROM dataset67", *D67))
def q_c4(spark, sf_dir):
    """C4: ordinal education (unmapped -> 2)."""
    d = DS.dataset67(spark, sf_dir)
    return d.select("sample_id", "owner_education", CL.education_ordinal().alias("education_level"))


@register("C6_log_shifts", with_views(
    "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, " + rnd(f"min({c})") + " AS train_min, "
                         + rnd(f"CASE WHEN min({c}) < 0 THEN abs(min({c})) + 1 ELSE 0.0 END") + " AS shift FROM tr_c2"
                         for c in CL.LOG_TRANSFORM_COLS), *D67, extra=PREP))
def q_c6(spark, sf_dir):
    """Train minima and log shifts of the 8 money columns."""
    _, model = _fitted(spark, sf_dir)
    sp = DS.splits(spark, sf_dir)
    tr = DS.distinct_train(spark, sf_dir)
    mins = tr.agg(*[F.min(c).cast("double").alias(c) for c in CL.LOG_TRANSFORM_COLS])
    args = ", ".join(f"'{c}', `{c}`" for c in CL.LOG_TRANSFORM_COLS)
    long = mins.selectExpr(f"stack({len(CL.LOG_TRANSFORM_COLS)}, {args}) AS (feature, train_min)")
    shift = F.when(F.col("train_min") < 0, F.abs("train_min") + 1).otherwise(F.lit(0.0))
    return long.withColumn("shift", shift)


@register("C9_fit_transform_train", with_views(_pp_select("pp_train"), *D67, extra=PREP))
def q_c9(spark, sf_dir):
    """Fitted preprocessing applied to the (deduplicated) train split."""
    sp, model = _fitted(spark, sf_dir)
    tr = DS.distinct_train(spark, sf_dir)
    return model.transform(tr)


@register("C10_transform_val", with_views(_pp_select("pp_val"), *D67, extra=PREP))
def q_c10(spark, sf_dir):
    """Frozen preprocessing applied to val (own mode, train shifts/medians, aligned)."""
    sp, model = _fitted(spark, sf_dir)
    return model.transform(sp.filter(F.col("split") == "val"))


@register("C10b_transform_test", with_views(_pp_select("pp_test"), *D67, extra=PREP))
def q_c10b(spark, sf_dir):
    """Frozen preprocessing applied to test."""
    sp, model = _fitted(spark, sf_dir)
    return model.transform(sp.filter(F.col("split") == "test"))


@register("C13_residual_nulls", with_views(
    "SELECT 'train' AS split, count(*) AS rows, CAST(" + " + ".join(
        f"sum(CASE WHEN {q(c)} IS NULL THEN 1 ELSE 0 END)" for c in PP_NUMERIC + PP_DUMMIES)
    + " AS BIGINT) AS null_cells FROM pp_train", *D67, extra=PREP))
def q_c13(spark, sf_dir):
    """Residual-NULL assertion after preprocessing (train)."""
    sp, model = _fitted(spark, sf_dir)
    tr = DS.distinct_train(spark, sf_dir)
    out = model.transform(tr).drop("sample_id", "default")
    return CL.residual_nulls(out).select(F.lit("train").alias("split"), "rows",
                                         F.col("null_cells").cast("long").alias("null_cells"))
