"""Fixture views derived from the driver's TPC-H-ish tables (FIXTURES.md §1-4).

``financial_raw`` -> ``financial_features`` -> ``credit_sample`` plus the tiny
``industry_risk`` lookup. They are deterministic functions of customer / orders /
lineitem, so every query built on them grows with the base tables.

Plan notes (scale): lineitem's few columns are dealt by order key in pieces of bounded size (a hot
key is split), so that the lines of an order meet in small tasks whatever the order of the
file: without that a scan task holds an entry for nearly each of its lines, and spills. Then
lineitem is aggregated per order (partial aggregation before
the shuffle -- 4x fewer rows, and a hot order key collapses map-side), joined to
orders on the order key, dealt by customer in as many pieces as the orders need (a
customer has about one order a year and task, so that an aggregate before the shuffle would hold
nearly all rows beside the join's sort buffers, and spill), rolled up to one row per (customer, year),
and only then joined to customer -- so the customer join sees company-years, not lines. Money is
summed exactly, in whole units of 10^-2, 10^-4 and 10^-6 (integers per order, DECIMAL above),
so the two-level rollup is engine-independent.
"""

from __future__ import annotations

from decimal import Decimal
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ratios import financial_features as _ratios16
from .tables import read_table

DEC_MONEY = "decimal(12,2)"
DEC_RATE = "decimal(4,2)"
#: Numbers that order keys are dealt by.
DEALS = 65_536
#: Orders that a piece of customers should hold; the number of pieces follows from the orders.
PIECE_ORDERS = 100_000


def hundredths(x: Column, decimal: str) -> Column:
    """``x`` cast to a DECIMAL with two places, in hundredths (long).

    A double that is the nearest one to a whole number of hundredths needs no conversion through its digits.
    """
    whole = F.rint(x * 100)
    return F.when((F.abs(x) < 10) & (whole / 100 == x) if decimal == DEC_RATE else (F.abs(x) < 1e9) & (whole / 100 == x), whole.cast("long")).otherwise((x.cast(decimal) * 100).cast("long"))


def financial_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company-year statements: 14 columns (ticker ... net_income)."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_discount",
                    "l_tax", "l_quantity", "l_returnflag", "l_linestatus")
    od = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    cu = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")

    li = li.filter("l_orderkey is not null").select(
        "l_orderkey", hundredths(F.col("l_extendedprice"), DEC_MONEY).alias("ext"), hundredths(F.col("l_discount"), DEC_RATE).alias("disc"),
        hundredths(F.col("l_tax"), DEC_RATE).alias("tax"), F.col("l_quantity").cast("int").cast("bigint").alias("sq"), "l_returnflag", "l_linestatus",
        # by a hash and not by the key itself: then a piece may be split, and equal keys are added again after it
        F.pmod(F.xxhash64("l_orderkey"), F.lit(DEALS)).cast("int").alias("_deal"),
    ).hint("rebalance", "_deal")
    net = F.col("ext") * (100 - F.col("disc"))

    def flag(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    # 1) pre-aggregate lines per order (map-side partial aggregation: a hot order key
    #    collapses before any shuffle, and the join below sees one row per order)
    per_order = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("ext").alias("gross"),
        F.sum(net).alias("revenue"),
        F.sum(net * (90 + F.col("tax"))).alias("cogs"),
        F.sum(net * (10 - F.col("tax"))).alias("margin"),
        F.sum("disc").alias("sd"),
        F.sum("sq").alias("sq"),
        flag(F.col("l_linestatus") == "O").alias("no_"),
        flag(F.col("l_returnflag") == "A").alias("na"),
        flag(F.col("l_returnflag") == "R").alias("nr"),
        flag(F.col("l_returnflag") == "N").alias("nn"),
    )
    # 2) attach customer and year, 3) roll orders up to (customer, year); the sums are
    #    exact, so the two-level rollup equals the line-level one bit for bit
    known = od.filter("o_custkey is not null")  # the others have no customer to join
    pieces = max(1, ceil(od.count() / PIECE_ORDERS))  # read from the files' footers
    lines = per_order.join(known, per_order.l_orderkey == known.o_orderkey).drop("l_orderkey", "o_orderkey").repartition(pieces, "o_custkey")
    units = {"gross": "0.01", "revenue": "0.0001", "cogs": "0.000001", "margin": "0.000001", "sd": "0.01"}
    agg = lines.groupBy(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("yr")).agg(
        F.sum("n").cast("double").alias("n"), *[(F.sum(F.col(c).cast("decimal(19,0)")) * F.lit(Decimal(u))).cast("double").alias(c) for c, u in units.items()],
        *[F.sum(c).cast("double").alias(c) for c in ("sq", "no_", "na", "nr", "nn")])
    agg = agg.join(cu, agg.custkey == cu.c_custkey)

    c = F.col
    ta = c("gross") * (F.lit(0.8) + F.lit(7) * c("sd") / c("n"))
    ca = ta * (F.lit(0.4) + F.lit(0.3) * c("no_") / c("n"))
    td = ta * (F.lit(0.3) + F.lit(0.3) * c("nn") / c("n"))
    bal = agg.select("*", ta.alias("total_assets"), ca.alias("current_assets"),
                     td.alias("total_debt"))
    nk3 = c("c_nationkey") % 3
    return bal.select(
        F.concat(F.lit("C"), c("custkey").cast("string")).alias("ticker"),
        c("c_name").alias("company_name"),
        c("yr").cast("int").alias("year"),
        F.when(nk3 == 0, 46).when(nk3 == 1, 10).otherwise(56).alias("industry_code"),
        "total_assets", "current_assets", "total_debt",
        (c("current_assets") / (F.lit(1.0) + c("sq") / c("n") / F.lit(50))).alias("current_liabilities"),
        (c("total_assets") - c("total_debt")).alias("equity"),
        (c("current_assets") * (F.lit(0.2) + F.lit(0.2) * c("na") / c("n"))).alias("inventory"),
        (c("current_assets") * (F.lit(0.25) + F.lit(0.2) * c("nr") / c("n"))).alias("receivables"),
        "revenue", "cogs",
        (F.lit(0.8) * c("margin")).alias("net_income"),
    )


def financial_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys + 12 ratios (before outlier removal), 16 columns."""
    return _ratios16(financial_raw(spark, sf_dir))


def latest_year(features: DataFrame) -> DataFrame:
    """One row per ticker: its latest year's ratios.

    ``max_by`` over a struct is a partial (map-side) aggregate, so a company with many
    years never forms a big sort group, unlike a row_number window.
    """
    cols = [c for c in features.columns if c != "ticker"]
    picked = features.groupBy("ticker").agg(
        F.max_by(F.struct(*cols), F.col("year")).alias("r"))
    return picked.select("ticker", "r.*")


# Fixture definition of the labelled company table (FIXTURES.md §3): deterministic
# arithmetic over the customer key; written once as SQL expressions.
_CREDIT_SAMPLE_EXPRS = [
    "k AS sample_id", "CASE WHEN ab < -400 THEN 1 ELSE 0 END AS `default`",
    "revenue_growth", "profit_margin", "roa", "roe", "current_ratio", "quick_ratio",
    "debt_to_equity", "debt_to_asset", "dscr", "inventory_turnover", "receivable_turnover",
    "asset_turnover",
    "CAST((k * 7919 + 17) % 551 AS DOUBLE) * 1000 - 50000 AS free_cash_flow",
    "0.3D + CAST((k * 31 + 7) % 120 AS DOUBLE) / 100 AS operating_cash_flow_ratio",
    "least(greatest(try_divide(365, receivable_turnover), 10.0D), 120.0D) AS days_sales_outstanding",
    "30 + CAST((k * 53 + 3) % 31 AS DOUBLE) AS days_payables_outstanding",
    "least(greatest(try_divide(365, inventory_turnover), 10.0D), 180.0D) AS days_inventory_outstanding",
    "CAST((k * 6151 + 29) % 9973 AS DOUBLE) * 100 AS avg_daily_balance",
    "CAST((k * 3079 + 5) % 4999 AS DOUBLE) * 100 AS min_balance_3m",
    "CAST((k * 97 + 1) % 89 AS DOUBLE) / 100 AS cash_flow_volatility",
    "CAST((k * 7919 + 17) % 551 AS DOUBLE) * 1250 - 62500 AS net_cash_flow",
    "k % 11 AS overdraft_count",
    "300 + (k * 7919 + 23) % 551 AS cic_score", "k % 6 AS num_active_loans",
    "CAST((k * 4099 + 13) % 7919 AS DOUBLE) * 1000 AS total_outstanding_debt",
    "CASE WHEN k % 4 = 0 THEN (k * 6151 + 3) % 181 ELSE 0 END AS max_past_due_days",
    "CASE WHEN k % 4 = 0 THEN k % 7 ELSE 0 END AS num_past_due_30d",
    "CASE WHEN k % 4 = 0 AND (k * 6151 + 3) % 181 > 90 THEN k % 5 ELSE 0 END AS num_past_due_90d",
    "CASE WHEN k % 13 = 0 THEN CAST((k * 17 + 0) % 29 AS DOUBLE) / 10 ELSE 3.0D END AS debt_burden_ratio",
    "CAST((k * 41 + 9) % 200 AS DOUBLE) / 10 AS credit_history_length",
    "CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS previous_default_history",
    "5 + (k * 101 + 7) % 496 AS num_transactions_3m",
    "CASE WHEN k % 97 = 0 THEN 0.0D ELSE CAST((k * 2053 + 11) % 4001 AS DOUBLE) * 100 END AS avg_monthly_deposits",
    "CAST((k * 1031 + 19) % 3989 AS DOUBLE) * 100 AS avg_monthly_withdrawals",
    "25 + (k * 29) % 46 AS owner_age",
    "CASE seg WHEN 'AUTOMOBILE' THEN 'THPT' WHEN 'BUILDING' THEN 'CĐ' WHEN 'FURNITURE' THEN 'ĐH' "
    "WHEN 'HOUSEHOLD' THEN 'Master' ELSE 'Bachelor' END AS owner_education",
    "(k * 23) % 41 AS owner_experience",
    "1 + CAST((k * 61 + 2) % 91 AS DOUBLE) / 10 AS product_differentiation_score",
    "1 + CAST((k * 67 + 4) % 91 AS DOUBLE) / 10 AS industry_competition_intensity",
    "1 + CAST((k * 71 + 6) % 91 AS DOUBLE) / 10 AS supplier_relationships",
    "CAST((k * 73 + 8) % 101 AS DOUBLE) / 100 AS customer_concentration",
    "1 + CAST((k * 79 + 10) % 91 AS DOUBLE) / 10 AS digital_footprint",
    "age AS business_age", "5 + (k * 83) % 196 AS num_employees",
    "1 + CAST((k * 89 + 12) % 91 AS DOUBLE) / 10 AS employee_productivity_score",
    "CAST((k * 97 + 14) % 101 AS DOUBLE) / 100 AS revenue_capacity_ratio",
    "1 + CAST((k * 103 + 16) % 91 AS DOUBLE) / 10 AS financial_data_reliability_score",
    "k % 6 AS business_certification_count",
    "2024 - age AS founding_year", "(k * 43) % (age + 1) AS years_at_current_location",
    "CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END AS industry_changes_count",
    "CASE WHEN k % 20 = 7 THEN 1 ELSE 0 END AS past_bankruptcy",
    "1 + CAST((k * 107 + 18) % 91 AS DOUBLE) / 10 AS ownership_stability",
    "industry_code",
    "CASE WHEN industry_code = 10 THEN 'Mature' WHEN industry_code = 46 THEN 'Mature' "
    "ELSE 'Growth' END AS industry_lifecycle_stage",
    "dist AS district_code", "3 + CAST((k * 109 + 20) % 41 AS DOUBLE) / 10 AS district_risk_score",
    "CASE WHEN dist IN (1,3,5) THEN 'CBD' WHEN dist IN (2,4,6,7,8,10,11) THEN 'Urban' "
    "WHEN dist IN (9,12) THEN 'Industrial' ELSE 'Suburban' END AS business_zone",
    "100 + CAST((k * 113 + 22) % 1101 AS DOUBLE) AS district_business_density",
    "8 + CAST((k * 127 + 24) % 121 AS DOUBLE) / 10 AS avg_income_district",
    "CASE WHEN coll THEN 1 ELSE 0 END AS has_collateral",
    "CASE WHEN coll THEN CAST((k * 5003 + 26) % 9001 AS DOUBLE) * 1000 ELSE 0.0D END AS collateral_value",
    "CASE WHEN coll THEN CAST((k * 131 + 28) % 101 AS DOUBLE) / 100 ELSE 0.0D END AS loan_to_value",
    "1 + CAST((k * 137 + 30) % 91 AS DOUBLE) / 10 AS collateral_liquidity_score",
    "CASE WHEN NOT coll OR k % 50 = 3 THEN NULL WHEN k % 3 = 0 THEN 'Real Estate' "
    "WHEN k % 3 = 1 THEN 'Machinery' ELSE 'Inventory' END AS collateral_type",
]


def credit_sample(spark: SparkSession, sf_dir: str, features: DataFrame | None = None) -> DataFrame:
    """Labelled company table: sample_id, default, 64 features + days_inventory_outstanding."""
    ff = features if features is not None else financial_features(spark, sf_dir)
    last = latest_year(ff)
    cu = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment",
                    "c_acctbal")
    b = cu.join(last, last.ticker == F.concat(F.lit("C"), cu.c_custkey.cast("string")))
    d = b.select(
        F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk"),
        F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("ab"), *last.columns,
    ).withColumn("coll", F.col("k") % 5 >= 3) \
     .withColumn("age", (F.col("k") * 37 + 11) % 50 + 1) \
     .withColumn("dist", F.col("nk") + 1)
    return d.selectExpr(*_CREDIT_SAMPLE_EXPRS)


def industry_risk(spark: SparkSession, include_56: bool = True) -> DataFrame:
    """(vsic_code, risk_score) lookup; drop 56 for the unmatched-key case."""
    # The industry risk lookup rows.
    rows = [(10, 4), (46, 6), (56, 8)]
    if not include_56:
        rows = [r for r in rows if r[0] != 56]
    return spark.createDataFrame(rows, "vsic_code int, risk_score int")


def with_lookup_features(sample: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """Complete the 67-feature table: add D17, D18 and E1 outputs to ``credit_sample``."""
    from ..operators.features import (cash_conversion_cycle, industry_risk_lookup,
                                      transaction_regularity_score)
    spark = sample.sparkSession
    risk = risk if risk is not None else industry_risk(spark)
    out = sample.withColumn("cash_conversion_cycle", cash_conversion_cycle())
    out = transaction_regularity_score(out)
    out = industry_risk_lookup(out, risk)
    return out


def dataset67(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full labelled 67-feature table (credit_sample + D17, D18, E1)."""
    return with_lookup_features(credit_sample(spark, sf_dir))
