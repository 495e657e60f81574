"""Deterministic feature derivations (D15-D28) and lookups.

Frame-level statistics (max, min, quantiles) are computed as one aggregate row and
attached with a broadcast cross join -- a one-row broadcast is size-bounded by
construction, and the main side is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import approx_quantiles, clip, map_values, safe_div
from .quantiles import quantile_row

CURRENT_YEAR = 2024
# District -> zone and district -> risk tier membership.
CBD_DISTRICTS = [1, 3, 5]
URBAN_DISTRICTS = [2, 4, 6, 7, 8, 10, 11]
INDUSTRIAL_DISTRICTS = [9, 12]
CENTRAL_TIER = [1, 3, 5, 10]
SEMI_CENTRAL_TIER = [2, 4, 6, 7, 8, 11]
# Supplier-score industry bonus, lifecycle map, lookup fallback.
SUPPLIER_BONUS = {10: 1.5, 46: 1.0, 56: 0.5}
LIFECYCLE_MAP = {10: "Mature", 46: "Mature", 56: "Growth"}
RISK_FALLBACK = {56: 8, 46: 6}
RISK_FALLBACK_DEFAULT = 4


def with_frame_stats(df: DataFrame, *aggs: Column) -> DataFrame:
    """Attach one row of frame-wide aggregates to every row: a scalar attach (the
    aggregate side is exactly one row, so the broadcast is bounded by construction)."""
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def days_sales_outstanding(turnover: str = "receivable_turnover") -> Column:
    """clip(365 / receivable_turnover, 10, 120)."""
    return clip(safe_div(F.lit(365.0), F.col(turnover)), 10.0, 120.0)


def days_inventory_outstanding(turnover: str = "inventory_turnover") -> Column:
    """clip(365 / inventory_turnover, 10, 180)."""
    return clip(safe_div(F.lit(365.0), F.col(turnover)), 10.0, 180.0)


def cash_conversion_cycle(dso: str = "days_sales_outstanding",
                          dio: str = "days_inventory_outstanding",
                          dpo: str = "days_payables_outstanding") -> Column:
    """clip(DSO + DIO - DPO, -30, 180)."""
    return clip(F.col(dso) + F.col(dio) - F.col(dpo), -30.0, 180.0)


def transaction_regularity_score(df: DataFrame, tx: str = "num_transactions_3m",
                                 vol: str = "cash_flow_volatility",
                                 out: str = "transaction_regularity_score") -> DataFrame:
    """clip(5 + 3 * tx/max(tx) - 2 * vol/max(vol), 1, 10); NULL tx share -> 0.5."""
    s = with_frame_stats(df, F.max(tx).alias("_tx_max"), F.max(vol).alias("_vol_max"))
    tx_share = F.coalesce(safe_div(F.col(tx).cast("double"), F.col("_tx_max")), F.lit(0.5))
    vol_share = safe_div(F.col(vol).cast("double"), F.col("_vol_max"))
    score = clip(F.lit(5.0) + tx_share * 3 - vol_share * 2, 1.0, 10.0)
    return s.withColumn(out, score).drop("_tx_max", "_vol_max")


def employee_productivity_score(df: DataFrame, revenue: str = "revenue",
                                employees: str = "num_employees",
                                out: str = "employee_productivity_score",
                                approx: bool = False) -> DataFrame:
    """Revenue per employee scaled by its 5%/95% quantiles onto 1..10, clipped.

    Exact quantiles with linear interpolation (= pandas); ``approx=True`` asks for ``percentile_approx``.
    """
    rpe = safe_div(F.col(revenue), F.col(employees))
    base = df.withColumn("_rpe", rpe)
    if approx:
        s = with_frame_stats(base, approx_quantiles("_rpe", [0.05, 0.95]).alias("_q"))
    else:
        s = base.crossJoin(F.broadcast(quantile_row(base, {"_q": F.col("_rpe")}, [0.05, 0.95])))  # one row
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    score = clip(safe_div(F.col("_rpe") - lo, hi - lo) * 9 + 1, 1.0, 10.0)
    return s.withColumn(out, score).drop("_rpe", "_q")


def founding_year(age: str = "business_age", current_year: int = CURRENT_YEAR) -> Column:
    """clip(current_year - business_age, 1980, current_year)."""
    return clip(F.lit(current_year) - F.col(age), 1980, current_year)


def industry_lifecycle_stage(code: str = "industry_code", strict_map: bool = False) -> Column:
    """56 -> Growth else Mature (all-in-one script); ``strict_map``: unknown -> NULL."""
    if strict_map:
        return map_values(code, LIFECYCLE_MAP)
    return F.when(F.col(code) == 56, "Growth").otherwise("Mature")


def business_zone(district: str = "district_code") -> Column:
    """District -> CBD / Urban / Industrial / Suburban."""
    d = F.col(district)
    return (F.when(d.isin(*CBD_DISTRICTS), "CBD")
            .when(d.isin(*URBAN_DISTRICTS), "Urban")
            .when(d.isin(*INDUSTRIAL_DISTRICTS), "Industrial")
            .otherwise("Suburban"))


def district_risk_tier(district: str = "district_code") -> Column:
    """Central / semi-central / suburban tier (the random score inside is not built)."""
    d = F.col(district)
    return (F.when(d.isin(*CENTRAL_TIER), "central")
            .when(d.isin(*SEMI_CENTRAL_TIER), "semi-central")
            .otherwise("suburban"))


def past_due_severity(days: str = "max_past_due_days", n90: str = "num_past_due_90d") -> Column:
    """max_past_due_days * (num_past_due_90d + 1), NULLs -> 0."""
    return (F.coalesce(F.col(days).cast("double"), F.lit(0.0))
            * (F.coalesce(F.col(n90).cast("double"), F.lit(0.0)) + 1))


def normalized_helpers(df: DataFrame, margin: str = "profit_margin", revenue: str = "revenue",
                       age: str = "business_age") -> DataFrame:
    """Min-max profit margin, min-max log1p(revenue), age share (NULL -> 0.5)."""
    logrev = F.log1p(F.col(revenue))
    base = df.withColumn("_logrev", logrev)
    s = with_frame_stats(
        base,
        F.min(margin).alias("_pm_lo"), F.max(margin).alias("_pm_hi"),
        F.min("_logrev").alias("_lr_lo"), F.max("_logrev").alias("_lr_hi"),
        F.max(age).alias("_age_hi"),
    )
    pm = safe_div(F.col(margin) - F.col("_pm_lo"), F.col("_pm_hi") - F.col("_pm_lo"))
    lr = safe_div(F.col("_logrev") - F.col("_lr_lo"), F.col("_lr_hi") - F.col("_lr_lo"))
    ag = F.coalesce(safe_div(F.col(age).cast("double"), F.col("_age_hi")), F.lit(0.5))
    return (s.withColumn("pm_normalized", pm).withColumn("log_revenue_normalized", lr)
            .withColumn("age_normalized", ag)
            .drop("_logrev", "_pm_lo", "_pm_hi", "_lr_lo", "_lr_hi", "_age_hi"))


def debt_service_adjusted(base: str, dscr: str = "dscr") -> Column:
    """clip(base + (dscr - 1) / 3 * 0.3, 0.1, 2.0)."""
    return clip(F.col(base) + (F.col(dscr) - 1) / 3 * 0.3, 0.1, 2.0)


def ownership_stability_adjusted(df: DataFrame, base: str = "ownership_stability",
                                 changes: str = "industry_changes_count",
                                 bankrupt: str = "past_bankruptcy",
                                 years: str = "years_at_current_location",
                                 out: str = "ownership_stability_adj") -> DataFrame:
    """clip(base - 0.5*changes - 3*bankruptcy + 2*years/max(years), 1, 10)."""
    s = with_frame_stats(df, F.max(years).alias("_yr_max"))
    bonus = safe_div(F.col(years).cast("double"), F.col("_yr_max")) * 2
    penalty = F.col(changes) * 0.5 + F.col(bankrupt) * 3
    return s.withColumn(out, clip(F.col(base) - penalty + bonus, 1.0, 10.0)).drop("_yr_max")


def supplier_with_bonus(base: str = "supplier_relationships", code: str = "industry_code") -> Column:
    """clip(base + {10: 1.5, 46: 1.0, 56: 0.5}[industry], 1, 10); unknown -> NULL."""
    return clip(F.col(base) + map_values(code, SUPPLIER_BONUS), 1.0, 10.0)


def dedupe_lookup_last(lookup: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """``dict(zip(keys, values))``: one value per key, the *last* row wins.

    Row order is only meaningful with an ordering column, which is required where a key
    repeats with different values.
    """
    if order is None:
        once = lookup.groupBy(key).agg(F.max(value).alias(value), F.min(value).alias("_least"))
        if not once.filter(~F.col(value).eqNullSafe(F.col("_least"))).isEmpty():
            raise ValueError(f"{key} repeats with different values: pass the column that orders the rows")
        return once.select(key, value)
    return lookup.groupBy(key).agg(F.max_by(value, order).alias(value))


def industry_risk_lookup(df: DataFrame, risk: DataFrame | None, code: str = "industry_code",
                         out: str = "industry_risk_score", fallback_when_missing: bool = False,
                         order: str | None = None) -> DataFrame:
    """Left lookup industry_code -> risk_score (unmatched -> NULL).

    E2: with ``risk=None`` (table unavailable) the constant fallback 56->8, 46->6,
    else 4 is used; ``fallback_when_missing`` also applies it to unmatched keys.
    The lookup is deduplicated per key (the last row by ``order`` wins); Spark broadcasts it
    if its size allows.
    """
    fallback = (F.when(F.col(code) == 56, F.lit(8)).when(F.col(code) == 46, F.lit(6))
                .otherwise(F.lit(RISK_FALLBACK_DEFAULT)))
    if risk is None:
        return df.withColumn(out, fallback)
    lk = dedupe_lookup_last(risk, "vsic_code", "risk_score", order) \
        .withColumnRenamed("vsic_code", "_lk_code").withColumnRenamed("risk_score", "_lk_risk")
    j = df.join(lk, F.col(code) == F.col("_lk_code"), "left")
    val = F.coalesce(F.col("_lk_risk"), fallback) if fallback_when_missing else F.col("_lk_risk")
    return j.withColumn(out, val).drop("_lk_code", "_lk_risk")
