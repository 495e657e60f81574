"""DuckDB text of the fixture views, inlined as CTEs by every oracle (FIXTURES.md §1-3).

The driver registers only the base tables, so each oracle carries the views it needs.
Ratios guard zero denominators with ``nullif`` (Spark side: ``try_divide``).
"""

from __future__ import annotations

FINANCIAL_RAW = """
fr_line AS (
  SELECT c.c_custkey, c.c_name, c.c_nationkey, year(o.o_orderdate) AS yr,
         CAST(l.l_extendedprice AS DECIMAL(12,2)) AS ext,
         CAST(l.l_discount AS DECIMAL(4,2)) AS disc, CAST(l.l_tax AS DECIMAL(4,2)) AS tax,
         CAST(CAST(l.l_quantity AS INT) AS BIGINT) AS qty, l.l_returnflag AS rf, l.l_linestatus AS ls
  FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
                  JOIN lineitem l ON l.l_orderkey = o.o_orderkey),
fr_agg AS (
  SELECT c_custkey, min(c_name) AS company_name, min(c_nationkey) AS nk, yr,
         CAST(count(*) AS DOUBLE) AS n,
         CAST(sum(ext) AS DOUBLE) AS gross,
         CAST(sum(ext * (1.00 - disc)) AS DOUBLE) AS revenue,
         CAST(sum(ext * (1.00 - disc) * (0.90 + tax)) AS DOUBLE) AS cogs,
         CAST(sum(ext * (1.00 - disc) * (0.10 - tax)) AS DOUBLE) AS margin,
         CAST(sum(disc) AS DOUBLE) AS sd, CAST(sum(qty) AS DOUBLE) AS sq,
         CAST(sum(CASE WHEN ls = 'O' THEN 1 ELSE 0 END) AS DOUBLE) AS no_,
         CAST(sum(CASE WHEN rf = 'A' THEN 1 ELSE 0 END) AS DOUBLE) AS na,
         CAST(sum(CASE WHEN rf = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS nr,
         CAST(sum(CASE WHEN rf = 'N' THEN 1 ELSE 0 END) AS DOUBLE) AS nn
  FROM fr_line GROUP BY c_custkey, yr),
fr_bal AS (
  SELECT *, gross * (0.8 + 7 * sd / n) AS total_assets,
         gross * (0.8 + 7 * sd / n) * (0.4 + 0.3 * no_ / n) AS current_assets,
         gross * (0.8 + 7 * sd / n) * (0.3 + 0.3 * nn / n) AS total_debt FROM fr_agg),
financial_raw AS (
  SELECT concat('C', CAST(c_custkey AS VARCHAR)) AS ticker, company_name, CAST(yr AS INT) AS year,
         CASE nk % 3 WHEN 0 THEN 46 WHEN 1 THEN 10 ELSE 56 END AS industry_code,
         total_assets, current_assets, total_debt,
         current_assets / (1.0 + sq / n / 50) AS current_liabilities,
         total_assets - total_debt AS equity,
         current_assets * (0.2 + 0.2 * na / n) AS inventory,
         current_assets * (0.25 + 0.2 * nr / n) AS receivables,
         revenue, cogs, 0.8 * margin AS net_income
  FROM fr_bal)"""

RATIO_EXPRS = """
  net_income / nullif(total_assets, 0) AS roa, net_income / nullif(equity, 0) AS roe,
  net_income / nullif(revenue, 0) AS profit_margin,
  CASE WHEN lag(revenue) OVER (PARTITION BY ticker ORDER BY year) IS NULL THEN 0.10
       ELSE revenue / nullif(lag(revenue) OVER (PARTITION BY ticker ORDER BY year), 0) - 1 END AS revenue_growth,
  current_assets / nullif(current_liabilities, 0) AS current_ratio,
  (current_assets - inventory) / nullif(current_liabilities, 0) AS quick_ratio,
  total_debt / nullif(equity, 0) AS debt_to_equity, total_debt / nullif(total_assets, 0) AS debt_to_asset,
  revenue / nullif(total_assets, 0) AS asset_turnover, cogs / nullif(inventory, 0) AS inventory_turnover,
  revenue / nullif(receivables, 0) AS receivable_turnover,
  (net_income * 1.5) / nullif(total_debt * 0.15 + 1, 0) AS dscr"""

FINANCIAL_FEATURES = f"""
financial_features AS (
  SELECT ticker, company_name, year, industry_code,{RATIO_EXPRS}
  FROM financial_raw)"""

RAW_RATIOS = f"""
raw_ratios AS (
  SELECT *,{RATIO_EXPRS}
  FROM financial_raw)"""

CREDIT_SAMPLE = """
cs_lastyr AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY year DESC) AS rn
                 FROM financial_features) t WHERE rn = 1),
cs_b AS (SELECT c.c_custkey AS k, c.c_nationkey AS nk, c.c_mktsegment AS seg, c.c_acctbal AS ab, f.*
         FROM customer c JOIN cs_lastyr f ON f.ticker = concat('C', CAST(c.c_custkey AS VARCHAR))),
cs_d AS (SELECT *, k % 5 >= 3 AS coll, (k * 37 + 11) % 50 + 1 AS age, nk + 1 AS dist FROM cs_b),
credit_sample AS (
SELECT k AS sample_id, CASE WHEN ab < -400 THEN 1 ELSE 0 END AS "default",
  revenue_growth, profit_margin, roa, roe, current_ratio, quick_ratio, debt_to_equity, debt_to_asset, dscr,
  inventory_turnover, receivable_turnover, asset_turnover,
  CAST((k * 7919 + 17) % 551 AS DOUBLE) * 1000 - 50000 AS free_cash_flow,
  0.3 + CAST((k * 31 + 7) % 120 AS DOUBLE) / 100 AS operating_cash_flow_ratio,
  least(greatest(365 / nullif(receivable_turnover, 0), 10.0), 120.0) AS days_sales_outstanding,
  30 + CAST((k * 53 + 3) % 31 AS DOUBLE) AS days_payables_outstanding,
  least(greatest(365 / nullif(inventory_turnover, 0), 10.0), 180.0) AS days_inventory_outstanding,
  CAST((k * 6151 + 29) % 9973 AS DOUBLE) * 100 AS avg_daily_balance, CAST((k * 3079 + 5) % 4999 AS DOUBLE) * 100 AS min_balance_3m,
  CAST((k * 97 + 1) % 89 AS DOUBLE) / 100 AS cash_flow_volatility, CAST((k * 7919 + 17) % 551 AS DOUBLE) * 1250 - 62500 AS net_cash_flow,
  k % 11 AS overdraft_count,
  300 + (k * 7919 + 23) % 551 AS cic_score, k % 6 AS num_active_loans,
  CAST((k * 4099 + 13) % 7919 AS DOUBLE) * 1000 AS total_outstanding_debt,
  CASE WHEN k % 4 = 0 THEN (k * 6151 + 3) % 181 ELSE 0 END AS max_past_due_days,
  CASE WHEN k % 4 = 0 THEN k % 7 ELSE 0 END AS num_past_due_30d,
  CASE WHEN k % 4 = 0 AND (k * 6151 + 3) % 181 > 90 THEN k % 5 ELSE 0 END AS num_past_due_90d,
  CASE WHEN k % 13 = 0 THEN CAST((k * 17 + 0) % 29 AS DOUBLE) / 10 ELSE 3.0 END AS debt_burden_ratio,
  CAST((k * 41 + 9) % 200 AS DOUBLE) / 10 AS credit_history_length,
  CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS previous_default_history,
  5 + (k * 101 + 7) % 496 AS num_transactions_3m,
  CASE WHEN k % 97 = 0 THEN 0.0 ELSE CAST((k * 2053 + 11) % 4001 AS DOUBLE) * 100 END AS avg_monthly_deposits,
  CAST((k * 1031 + 19) % 3989 AS DOUBLE) * 100 AS avg_monthly_withdrawals,
  25 + (k * 29) % 46 AS owner_age,
  CASE seg WHEN 'AUTOMOBILE' THEN 'THPT' WHEN 'BUILDING' THEN 'CĐ' WHEN 'FURNITURE' THEN 'ĐH'
           WHEN 'HOUSEHOLD' THEN 'Master' ELSE 'Bachelor' END AS owner_education,
  (k * 23) % 41 AS owner_experience,
  1 + CAST((k * 61 + 2) % 91 AS DOUBLE) / 10 AS product_differentiation_score, 1 + CAST((k * 67 + 4) % 91 AS DOUBLE) / 10 AS industry_competition_intensity,
  1 + CAST((k * 71 + 6) % 91 AS DOUBLE) / 10 AS supplier_relationships, CAST((k * 73 + 8) % 101 AS DOUBLE) / 100 AS customer_concentration,
  1 + CAST((k * 79 + 10) % 91 AS DOUBLE) / 10 AS digital_footprint, age AS business_age, 5 + (k * 83) % 196 AS num_employees,
  1 + CAST((k * 89 + 12) % 91 AS DOUBLE) / 10 AS employee_productivity_score, CAST((k * 97 + 14) % 101 AS DOUBLE) / 100 AS revenue_capacity_ratio,
  1 + CAST((k * 103 + 16) % 91 AS DOUBLE) / 10 AS financial_data_reliability_score, k % 6 AS business_certification_count,
  2024 - age AS founding_year, (k * 43) % (age + 1) AS years_at_current_location,
  CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END AS industry_changes_count,
  CASE WHEN k % 20 = 7 THEN 1 ELSE 0 END AS past_bankruptcy, 1 + CAST((k * 107 + 18) % 91 AS DOUBLE) / 10 AS ownership_stability,
  industry_code, CASE WHEN industry_code = 10 THEN 'Mature' WHEN industry_code = 46 THEN 'Mature' ELSE 'Growth' END AS industry_lifecycle_stage,
  dist AS district_code, 3 + CAST((k * 109 + 20) % 41 AS DOUBLE) / 10 AS district_risk_score,
  CASE WHEN dist IN (1,3,5) THEN 'CBD' WHEN dist IN (2,4,6,7,8,10,11) THEN 'Urban'
       WHEN dist IN (9,12) THEN 'Industrial' ELSE 'Suburban' END AS business_zone,
  100 + CAST((k * 113 + 22) % 1101 AS DOUBLE) AS district_business_density, 8 + CAST((k * 127 + 24) % 121 AS DOUBLE) / 10 AS avg_income_district,
  CASE WHEN coll THEN 1 ELSE 0 END AS has_collateral,
  CASE WHEN coll THEN CAST((k * 5003 + 26) % 9001 AS DOUBLE) * 1000 ELSE 0.0 END AS collateral_value,
  CASE WHEN coll THEN CAST((k * 131 + 28) % 101 AS DOUBLE) / 100 ELSE 0.0 END AS loan_to_value,
  1 + CAST((k * 137 + 30) % 91 AS DOUBLE) / 10 AS collateral_liquidity_score,
  CASE WHEN NOT coll OR k % 50 = 3 THEN NULL WHEN k % 3 = 0 THEN 'Real Estate' WHEN k % 3 = 1 THEN 'Machinery' ELSE 'Inventory' END AS collateral_type
FROM cs_d)"""

INDUSTRY_RISK = """
industry_risk AS (SELECT * FROM (VALUES (10, 4), (46, 6), (56, 8)) AS t(vsic_code, risk_score))"""

# dataset67: credit_sample + D17 (cash_conversion_cycle), D18 (transaction_regularity_score),
# E1 (industry_risk_score) -- the full 67-feature table.
DATASET67 = """
ds_stats AS (SELECT max(num_transactions_3m) AS tx_max, max(cash_flow_volatility) AS vol_max FROM credit_sample),
dataset67 AS (
  SELECT s.*,
    CASE WHEN days_sales_outstanding + days_inventory_outstanding - days_payables_outstanding IS NULL THEN NULL
         ELSE greatest(least(days_sales_outstanding + days_inventory_outstanding - days_payables_outstanding, 180.0), -30.0) END
      AS cash_conversion_cycle,
    CASE WHEN 5.0 + coalesce(CAST(num_transactions_3m AS DOUBLE) / nullif(st.tx_max, 0), 0.5) * 3
              - CAST(cash_flow_volatility AS DOUBLE) / nullif(st.vol_max, 0) * 2 IS NULL THEN NULL
         ELSE greatest(least(5.0 + coalesce(CAST(num_transactions_3m AS DOUBLE) / nullif(st.tx_max, 0), 0.5) * 3
              - CAST(cash_flow_volatility AS DOUBLE) / nullif(st.vol_max, 0) * 2, 10.0), 1.0) END
      AS transaction_regularity_score,
    r.risk_score AS industry_risk_score
  FROM credit_sample s CROSS JOIN ds_stats st
  LEFT JOIN industry_risk r ON r.vsic_code = s.industry_code)"""

_VIEWS = {
    "financial_raw": ([], FINANCIAL_RAW),
    "financial_features": (["financial_raw"], FINANCIAL_FEATURES),
    "raw_ratios": (["financial_raw"], RAW_RATIOS),
    "credit_sample": (["financial_features"], CREDIT_SAMPLE),
    "industry_risk": ([], INDUSTRY_RISK),
    "dataset67": (["credit_sample", "industry_risk"], DATASET67),
}


def with_views(body: str, *views: str, extra: list[str] | None = None) -> str:
    """``WITH <needed views in dependency order>, <extra CTEs> <body>``."""
    order: list[str] = []

    def visit(v: str):
        if v in order:
            return
        for dep in _VIEWS[v][0]:
            visit(dep)
        order.append(v)

    for v in views:
        visit(v)
    ctes = [_VIEWS[v][1].strip() for v in order] + [e.strip() for e in (extra or [])]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body


def rnd(expr: str, digits: int = 6) -> str:
    """Round a DOUBLE expression; NaN/inf -> NULL (mirrors ``round_doubles``)."""
    scale = f"CAST({10 ** digits} AS DOUBLE)"
    return (f"(floor(CASE WHEN isnan(CAST({expr} AS DOUBLE)) OR isinf(CAST({expr} AS DOUBLE)) "
            f"THEN NULL ELSE CAST({expr} AS DOUBLE) END * {scale} + 0.5) / {scale})")


def oversample_ctes(source: str = "dataset67", target_rate: float = 0.085, seed: int = 42) -> list[str]:
    """G5 in SQL: ``oversampled`` = source + clone_ord, same md5 draws as the Spark side."""
    t = f"CAST({target_rate!r} AS DOUBLE)"
    return [
        f"os_stats AS (SELECT count(*) AS n, sum(\"default\") AS d FROM {source})",
        f"os_x AS (SELECT CAST(trunc(({t} * n - d) / (1 - {t})) AS BIGINT) AS x, d FROM os_stats)",
        f"os_min AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(sample_id AS VARCHAR), "
        f"'{seed}'))) - 1 AS _pos FROM {source} WHERE \"default\" = 1)",
        f"os_draws AS (SELECT i + 1 AS clone_ord, ('0x' || substr(md5(concat_ws('|', 'draw', CAST(i AS VARCHAR), "
        f"'{seed}')), 1, 15))::BIGINT % d AS _pos FROM (SELECT unnest(range(x)) AS i, d FROM os_x WHERE x > 0 AND d > 0))",
        "os_clones AS (SELECT m.* EXCLUDE (_pos), dr.clone_ord FROM os_draws dr JOIN os_min m USING (_pos))",
        f"oversampled AS (SELECT *, CAST(0 AS BIGINT) AS clone_ord FROM {source} UNION ALL SELECT * FROM os_clones)",
    ]


def split_ctes(source: str = "oversampled", seed: int = 42, train: float = 0.70, val: float = 0.15) -> list[str]:
    """G6 in SQL: ``splits`` = source + split (train/val/test per (industry, default) stratum)."""
    key = f"md5(concat_ws('|', CAST(sample_id AS VARCHAR), CAST(clone_ord AS VARCHAR), '{seed}'))"
    ntr = f"floor(_n * CAST({train!r} AS DOUBLE))"
    nva = f"floor(_n * CAST({val!r} AS DOUBLE))"
    return [
        f"sp_ranked AS (SELECT *, row_number() OVER (PARTITION BY industry_code, \"default\" ORDER BY {key}) - 1 AS _pos, "
        f"count(*) OVER (PARTITION BY industry_code, \"default\") AS _n FROM {source})",
        f"splits AS (SELECT * EXCLUDE (_pos, _n), CASE WHEN _pos < {ntr} THEN 'train' WHEN _pos < {ntr} + {nva} "
        f"THEN 'val' ELSE 'test' END AS split FROM sp_ranked)",
    ]
