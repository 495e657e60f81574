"""Ratios, outliers and the financial panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ratios as R
from ..sources import fixtures as FX  # noqa: F401
from . import datasets as DS
from .oracle_views import rnd, with_views
from .registry import register

RATIOS = R.RATIO_COLS
RATIO_SQL = ", ".join(rnd(c) + f" AS {c}" for c in RATIOS)


@register("D13_calculate_ratios", with_views(
    f"SELECT ticker, company_name, year, industry_code, {RATIO_SQL} FROM financial_features",
    "financial_features"))
def q_d13(spark, sf_dir):
    """The 12 ratios per company-year (financial_features)."""
    return DS.financial_features(spark, sf_dir)


@register("D4_revenue_growth", with_views(
    "SELECT ticker, year, " + rnd("revenue_growth") + " AS revenue_growth FROM financial_features",
    "financial_features"))
def q_d4(spark, sf_dir):
    """Year-on-year revenue change per ticker, first year 0.10."""
    return DS.financial_features(spark, sf_dir).select("ticker", "year", "revenue_growth")


@register("F3_industry_ratio_profile", with_views(
    "SELECT industry_code, count(*) AS records, " + rnd("avg(roa)") + " AS avg_roa, "
    + rnd("avg(roe)") + " AS avg_roe, " + rnd("avg(profit_margin)") + " AS avg_profit_margin, "
    + rnd("avg(current_ratio)") + " AS avg_current_ratio, "
    + rnd("avg(debt_to_equity)") + " AS avg_debt_to_equity "
    "FROM financial_features GROUP BY industry_code", "financial_features"))
def q_f3(spark, sf_dir):
    """mean ratio profile per industry."""
    return R.industry_ratio_profile(DS.financial_features(spark, sf_dir))


@register("F3b_industry_raw_profile", with_views(
    "SELECT industry_code, count(*) AS records, " + rnd("avg(revenue)", 2) + " AS avg_revenue, "
    + rnd("avg(total_assets)", 2) + " AS avg_total_assets FROM financial_raw GROUP BY industry_code",
    "financial_raw"), overrides={"avg_revenue": 2, "avg_total_assets": 2})
def q_f3b(spark, sf_dir):
    """F3 raw variant: average revenue and total assets per industry."""
    return R.industry_raw_profile(DS.financial_raw(spark, sf_dir))


_MONEY = ["total_assets", "current_assets", "total_debt", "current_liabilities", "equity",
          "inventory", "receivables", "revenue", "cogs", "net_income"]


@register("A5_financial_raw_union", with_views(
    "SELECT ticker, company_name, year, industry_code, "
    + ", ".join(rnd(c, 2) + f" AS {c}" for c in _MONEY)
    + " FROM financial_raw WHERE industry_code = 46 UNION ALL "
    "SELECT ticker, company_name, year, industry_code, "
    + ", ".join(rnd(c, 2) + f" AS {c}" for c in _MONEY)
    + " FROM financial_raw WHERE industry_code = 10 UNION ALL "
    "SELECT ticker, company_name, year, industry_code, "
    + ", ".join(rnd(c, 2) + f" AS {c}" for c in _MONEY)
    + " FROM financial_raw WHERE industry_code = 56", "financial_raw"),
    digits=2)
def q_a5(spark, sf_dir):
    """Per-industry statement frames stacked with unionByName."""
    from ..sources.io import stack_frames
    raw = DS.financial_raw(spark, sf_dir)
    return stack_frames([raw.filter(F.col("industry_code") == c) for c in (46, 10, 56)])


def _d14_sql() -> str:
    ctes = ["o0 AS (SELECT * FROM financial_features)"]
    for i, c in enumerate(RATIOS, start=1):
        ctes.append(
            f"s{i} AS (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM o{i-1}), "
            f"o{i} AS (SELECT o{i-1}.* FROM o{i-1}, s{i} "
            f"WHERE {c} >= s{i}.m - 5 * s{i}.s AND {c} <= s{i}.m + 5 * s{i}.s)")
    body = (f"SELECT ticker, company_name, year, industry_code, {RATIO_SQL} FROM o{len(RATIOS)}")
    return with_views(body, "financial_features", extra=ctes)


@register("D14_remove_outliers", _d14_sql())
def q_d14(spark, sf_dir):
    """Sequential 5-sigma filter over the 12 ratios (stats of the survivors)."""
    return R.remove_outliers(DS.financial_features(spark, sf_dir))


@register("D14b_remove_outliers_single_pass", with_views(
    "SELECT ticker, company_name, year, industry_code, " + RATIO_SQL
    + " FROM financial_features, st WHERE "
    + " AND ".join(f"{c} >= st.m_{c} - 5 * st.s_{c} AND {c} <= st.m_{c} + 5 * st.s_{c}" for c in RATIOS),
    "financial_features",
    extra=["st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in RATIOS)
           + " FROM financial_features)"]))
def q_d14b(spark, sf_dir):
    """D14 variant: all bounds from the unfiltered input in one fused pass."""
    return R.remove_outliers_single_pass(DS.financial_features(spark, sf_dir))


@register("F28_panel_coverage", with_views(
    "SELECT count(DISTINCT ticker) AS n_tickers, count(DISTINCT year) AS n_years, "
    "min(year) AS first_year, max(year) AS last_year, count(*) AS n_rows FROM financial_raw",
    "financial_raw"))
def q_f28(spark, sf_dir):
    """distinct tickers and years in the statement panel."""
    return R.panel_coverage(DS.financial_raw(spark, sf_dir))


@register("H1_sorted_panel", with_views(
    "SELECT ticker, year, " + rnd("roa") + " AS roa FROM financial_features ORDER BY ticker, year",
    "financial_features"))
def q_h1(spark, sf_dir):
    """H1: multi-key sort (ticker, year) -- a range-partitioned global sort."""
    return DS.financial_features(spark, sf_dir).select("ticker", "year", "roa").orderBy("ticker", "year")
