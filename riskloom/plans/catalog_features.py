"""Deterministic feature derivations and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..sources import fixtures as FX
from .oracle_views import rnd, with_views
from .registry import register

D67 = ("dataset67",)


def _ff_memo(spark, sf_dir):
    from . import datasets as DS_
    return DS_.financial_features(spark, sf_dir)


def _clip_sql(e: str, lo, hi) -> str:
    inner = e
    if hi is not None:
        inner = f"least({inner}, {hi})"
    if lo is not None:
        inner = f"greatest({inner}, {lo})"
    return f"CASE WHEN ({e}) IS NULL THEN NULL ELSE {inner} END"


def _d67(spark, sf_dir):
    from . import datasets as DS
    return DS.dataset67(spark, sf_dir)


@register("D15_days_sales_outstanding", with_views(
    "SELECT sample_id, " + rnd(_clip_sql("365.0 / nullif(receivable_turnover, 0)", 10.0, 120.0))
    + " AS days_sales_outstanding FROM dataset67", *D67))
def q_d15(spark, sf_dir):
    """clip(365 / receivable_turnover, 10, 120)."""
    return _d67(spark, sf_dir).select("sample_id", FE.days_sales_outstanding().alias("days_sales_outstanding"))


@register("D16_days_inventory_outstanding", with_views(
    "SELECT sample_id, " + rnd(_clip_sql("365.0 / nullif(inventory_turnover, 0)", 10.0, 180.0))
    + " AS days_inventory_outstanding FROM dataset67", *D67))
def q_d16(spark, sf_dir):
    """clip(365 / inventory_turnover, 10, 180)."""
    return _d67(spark, sf_dir).select("sample_id", FE.days_inventory_outstanding().alias("days_inventory_outstanding"))


@register("D17_cash_conversion_cycle", with_views(
    "SELECT sample_id, " + rnd("cash_conversion_cycle") + " AS cash_conversion_cycle FROM dataset67", *D67))
def q_d17(spark, sf_dir):
    """clip(DSO + DIO - DPO, -30, 180)."""
    return FX.credit_sample(spark, sf_dir, _ff_memo(spark, sf_dir)).select("sample_id", FE.cash_conversion_cycle().alias("cash_conversion_cycle"))


@register("D18_transaction_regularity", with_views(
    "SELECT sample_id, " + rnd("transaction_regularity_score") + " AS transaction_regularity_score FROM dataset67",
    *D67))
def q_d18(spark, sf_dir):
    """clip(5 + 3 tx/max(tx) - 2 vol/max(vol), 1, 10)."""
    cs = FX.credit_sample(spark, sf_dir, _ff_memo(spark, sf_dir))
    return FE.transaction_regularity_score(cs).select("sample_id", "transaction_regularity_score")


# company profile: credit_sample joined to the latest statement year (revenue)
PROFILE_CTE = [
    "cp_last AS (SELECT ticker, revenue FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY year DESC) "
    "AS rn FROM financial_raw) t WHERE rn = 1)",
    "company_profile AS (SELECT d.sample_id, d.num_employees, d.business_age, d.profit_margin, cp.revenue "
    "FROM dataset67 d JOIN cp_last cp ON cp.ticker = 'C' || CAST(d.sample_id AS VARCHAR))",
]


def _company_profile(spark, sf_dir):
    from . import datasets as DS
    raw = DS.financial_raw(spark, sf_dir)
    last = raw.groupBy("ticker").agg(F.max_by("revenue", "year").alias("revenue"))
    d = _d67(spark, sf_dir).select("sample_id", "num_employees", "business_age", "profit_margin")
    return d.join(last, last.ticker == F.concat(F.lit("C"), d.sample_id.cast("string"))).drop("ticker")


@register("D19_employee_productivity", with_views(
    "SELECT sample_id, " + rnd(_clip_sql("(rpe - q[1]) / nullif(q[2] - q[1], 0) * 9 + 1", 1.0, 10.0))
    + " AS employee_productivity_score FROM (SELECT sample_id, revenue / nullif(num_employees, 0) AS rpe "
    "FROM company_profile) a, (SELECT quantile_cont(revenue / nullif(num_employees, 0), [0.05, 0.95]) AS q "
    "FROM company_profile) b", *D67, "financial_raw", extra=PROFILE_CTE))
def q_d19(spark, sf_dir):
    """Revenue per employee scaled by its 5 %/95 % quantiles onto 1..10."""
    cp = _company_profile(spark, sf_dir)
    return FE.employee_productivity_score(cp).select("sample_id", "employee_productivity_score")


@register("D20_founding_year", with_views(
    "SELECT sample_id, CASE WHEN business_age IS NULL THEN NULL ELSE greatest(least(2024 - business_age, 2024), 1980) "
    "END AS founding_year_derived FROM dataset67", *D67))
def q_d20(spark, sf_dir):
    """clip(2024 - business_age, 1980, 2024)."""
    return _d67(spark, sf_dir).select("sample_id", FE.founding_year().alias("founding_year_derived"))


@register("D21_lifecycle_stage", with_views(
    "SELECT sample_id, industry_code, CASE WHEN industry_code = 56 THEN 'Growth' ELSE 'Mature' END AS stage, "
    "CASE industry_code WHEN 10 THEN 'Mature' WHEN 46 THEN 'Mature' WHEN 56 THEN 'Growth' END AS stage_mapped "
    "FROM dataset67", *D67))
def q_d21(spark, sf_dir):
    """Lifecycle stage (56 -> Growth else Mature; mapped variant: unknown -> NULL)."""
    d = _d67(spark, sf_dir)
    return d.select("sample_id", "industry_code", FE.industry_lifecycle_stage().alias("stage"),
                    FE.industry_lifecycle_stage(strict_map=True).alias("stage_mapped"))


@register("D22_D23_district_zone_tier", with_views(
    "SELECT sample_id, district_code, CASE WHEN district_code IN (1,3,5) THEN 'CBD' WHEN district_code IN "
    "(2,4,6,7,8,10,11) THEN 'Urban' WHEN district_code IN (9,12) THEN 'Industrial' ELSE 'Suburban' END AS zone, "
    "CASE WHEN district_code IN (1,3,5,10) THEN 'central' WHEN district_code IN (2,4,6,7,8,11) THEN 'semi-central' "
    "ELSE 'suburban' END AS risk_tier FROM dataset67", *D67))
def q_d22(spark, sf_dir):
    """Business zone and district risk tier from the district code."""
    d = _d67(spark, sf_dir)
    return d.select("sample_id", "district_code", FE.business_zone().alias("zone"),
                    FE.district_risk_tier().alias("risk_tier"))


@register("D24_past_due_severity", with_views(
    "SELECT sample_id, " + rnd("coalesce(CAST(max_past_due_days AS DOUBLE), 0) * (coalesce(CAST(num_past_due_90d AS DOUBLE), 0) + 1)")
    + " AS past_due_severity FROM dataset67", *D67))
def q_d24(spark, sf_dir):
    """max_past_due_days * (num_past_due_90d + 1), NULLs -> 0."""
    return _d67(spark, sf_dir).select("sample_id", FE.past_due_severity().alias("past_due_severity"))


@register("D25_normalized_helpers", with_views(
    "SELECT sample_id, " + rnd("(profit_margin - pm_lo) / nullif(pm_hi - pm_lo, 0)") + " AS pm_normalized, "
    + rnd("(ln(1 + revenue) - lr_lo) / nullif(lr_hi - lr_lo, 0)") + " AS log_revenue_normalized, "
    + rnd("coalesce(CAST(business_age AS DOUBLE) / nullif(age_hi, 0), 0.5)") + " AS age_normalized "
    "FROM company_profile, (SELECT min(profit_margin) AS pm_lo, max(profit_margin) AS pm_hi, "
    "min(ln(1 + revenue)) AS lr_lo, max(ln(1 + revenue)) AS lr_hi, max(business_age) AS age_hi FROM company_profile) s",
    *D67, "financial_raw", extra=PROFILE_CTE))
def q_d25(spark, sf_dir):
    """Min-max profit margin, min-max log revenue, business-age share (NULL -> 0.5)."""
    cp = _company_profile(spark, sf_dir)
    return FE.normalized_helpers(cp).select("sample_id", "pm_normalized", "log_revenue_normalized", "age_normalized")


@register("D26_debt_service_adjusted", with_views(
    "SELECT sample_id, " + rnd(_clip_sql("operating_cash_flow_ratio + (dscr - 1) / 3 * 0.3", 0.1, 2.0))
    + " AS ocf_ratio_adjusted FROM dataset67", *D67))
def q_d26(spark, sf_dir):
    """clip(base + (dscr - 1)/3 * 0.3, 0.1, 2.0) with the OCF ratio as base."""
    return _d67(spark, sf_dir).select("sample_id",
                                      FE.debt_service_adjusted("operating_cash_flow_ratio").alias("ocf_ratio_adjusted"))


@register("D27_ownership_stability_adjusted", with_views(
    "SELECT sample_id, " + rnd(_clip_sql(
        "ownership_stability - (industry_changes_count * 0.5 + past_bankruptcy * 3) "
        "+ CAST(years_at_current_location AS DOUBLE) / nullif(m, 0) * 2", 1.0, 10.0))
    + " AS ownership_stability_adj FROM dataset67, (SELECT max(years_at_current_location) AS m FROM dataset67) s",
    *D67))
def q_d27(spark, sf_dir):
    """Ownership stability adjusted for changes, bankruptcy and tenure share."""
    d = _d67(spark, sf_dir)
    return FE.ownership_stability_adjusted(d).select("sample_id", "ownership_stability_adj")


@register("D28_supplier_industry_bonus", with_views(
    "SELECT sample_id, " + rnd(_clip_sql(
        "supplier_relationships + CASE industry_code WHEN 10 THEN 1.5 WHEN 46 THEN 1.0 WHEN 56 THEN 0.5 END",
        1.0, 10.0)) + " AS supplier_relationships_adj FROM dataset67", *D67))
def q_d28(spark, sf_dir):
    """Supplier score + industry bonus (10: 1.5, 46: 1.0, 56: 0.5), clipped 1..10."""
    return _d67(spark, sf_dir).select("sample_id", FE.supplier_with_bonus().alias("supplier_relationships_adj"))


@register("E1_industry_risk_lookup", with_views(
    "SELECT s.sample_id, s.industry_code, r.risk_score AS industry_risk_score FROM credit_sample s "
    "LEFT JOIN (SELECT * FROM industry_risk WHERE vsic_code <> 56) r ON r.vsic_code = s.industry_code",
    "credit_sample", "industry_risk"))
def q_e1(spark, sf_dir):
    """Left lookup industry -> risk score with the 56 row missing (unmatched -> NULL)."""
    cs = FX.credit_sample(spark, sf_dir, _ff_memo(spark, sf_dir)).select("sample_id", "industry_code")
    return FE.industry_risk_lookup(cs, FX.industry_risk(spark, include_56=False))


@register("E2_industry_risk_fallback", with_views(
    "SELECT sample_id, industry_code, CASE WHEN industry_code = 56 THEN 8 WHEN industry_code = 46 THEN 6 ELSE 4 END "
    "AS industry_risk_score FROM credit_sample", "credit_sample"))
def q_e2(spark, sf_dir):
    """Constant fallback 56 -> 8, 46 -> 6, else 4 when the lookup table is unavailable."""
    cs = FX.credit_sample(spark, sf_dir, _ff_memo(spark, sf_dir)).select("sample_id", "industry_code")
    return FE.industry_risk_lookup(cs, None)
