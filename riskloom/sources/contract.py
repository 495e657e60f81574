"""The fixed 67-feature contract and contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import round_half_up

# ---------------------------------------------------------------------------
# Feature names per module, in contract order (must equal the
# reference's lists for module selection and coverage reports to agree).
# ---------------------------------------------------------------------------
MODULE1_FEATURES = [
    "revenue_growth", "profit_margin", "roa", "roe",
    "current_ratio", "quick_ratio", "debt_to_equity", "debt_to_asset", "dscr",
    "inventory_turnover", "receivable_turnover", "asset_turnover",
    "free_cash_flow", "operating_cash_flow_ratio", "cash_conversion_cycle",
    "days_sales_outstanding", "days_payables_outstanding",
    "avg_daily_balance", "min_balance_3m", "cash_flow_volatility",
    "net_cash_flow", "overdraft_count",
]
MODULE2_FEATURES = [
    "cic_score", "num_active_loans", "total_outstanding_debt",
    "max_past_due_days", "num_past_due_30d", "num_past_due_90d",
    "debt_burden_ratio", "credit_history_length", "previous_default_history",
    "num_transactions_3m", "avg_monthly_deposits", "avg_monthly_withdrawals",
    "transaction_regularity_score",
]
MODULE3_FEATURES = [
    "owner_age", "owner_education", "owner_experience",
    "product_differentiation_score", "industry_competition_intensity",
    "supplier_relationships", "customer_concentration", "digital_footprint",
    "business_age", "num_employees", "employee_productivity_score",
    "revenue_capacity_ratio", "financial_data_reliability_score",
    "business_certification_count",
]
MODULE4_FEATURES = [
    "founding_year", "years_at_current_location", "industry_changes_count",
    "past_bankruptcy", "ownership_stability",
    "industry_code", "industry_risk_score", "industry_lifecycle_stage",
    "district_code", "district_risk_score", "business_zone",
    "district_business_density", "avg_income_district",
    "has_collateral", "collateral_value", "loan_to_value",
    "collateral_liquidity_score", "collateral_type",
]
MODULES = {
    "module1": MODULE1_FEATURES,
    "module2": MODULE2_FEATURES,
    "module3": MODULE3_FEATURES,
    "module4": MODULE4_FEATURES,
}
ALL_FEATURES = MODULE1_FEATURES + MODULE2_FEATURES + MODULE3_FEATURES + MODULE4_FEATURES
ID_COL = "sample_id"
LABEL_COL = "default"
CATEGORICAL_FEATURES = ["owner_education", "industry_lifecycle_stage", "business_zone",
                        "collateral_type"]
INT_FEATURES = {
    "overdraft_count", "cic_score", "num_active_loans", "max_past_due_days",
    "num_past_due_30d", "num_past_due_90d", "previous_default_history",
    "num_transactions_3m", "owner_age", "owner_experience", "business_age",
    "num_employees", "business_certification_count", "founding_year",
    "years_at_current_location", "industry_changes_count", "past_bankruptcy",
    "industry_code", "industry_risk_score", "district_code", "has_collateral",
}
# VSIC industry code -> name (B8); unknown codes render as "Industry <code>".
INDUSTRY_NAMES = {10: "Food Manufacturing", 46: "Wholesale", 56: "F&B"}


def dataset_schema() -> T.StructType:
    """The declared 69-column schema (sample_id, default, 67 features)."""
    fields = [T.StructField(ID_COL, T.LongType()), T.StructField(LABEL_COL, T.IntegerType())]
    for name in ALL_FEATURES:
        if name in CATEGORICAL_FEATURES:
            dt = T.StringType()
        elif name in INT_FEATURES:
            dt = T.LongType()
        else:
            dt = T.DoubleType()
        fields.append(T.StructField(name, dt))
    return T.StructType(fields)


def contract_frame(spark: SparkSession) -> DataFrame:
    """(module, feature, ord) for the 67 contract features -- a 67-row literal frame."""
    rows = [(m, f, i + 1) for m, feats in MODULES.items() for i, f in enumerate(feats)]
    return spark.createDataFrame(rows, "module string, feature string, ord int")


def validate_labels(df: DataFrame, name: str = "df", label: str = LABEL_COL) -> dict:
    """A4: label present, non-empty, values in {0,1}; one pass, raises on the driver."""
    if label not in df.columns:
        raise ValueError(f"{name}: missing '{label}' column")
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col(label).isNull() | ~F.col(label).isin(0, 1), 1).otherwise(0)).alias("bad"),
        F.avg(F.col(label).cast("double")).alias("rate"),
    ).first()
    if row["n"] == 0:
        raise ValueError(f"{name}: empty")
    if row["bad"]:
        raise ValueError(f"{name}: {row['bad']} label values outside {{0,1}}")
    return {"rows": row["n"], "cols": len(df.columns), "default_rate": row["rate"]}


def label_check(df: DataFrame, label: str = LABEL_COL) -> DataFrame:
    """A4 as a frame: n, bad-label count, rate, ok flag."""
    lab = F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(lab.isNull() | ~lab.isin(0, 1), 1).otherwise(0)).cast("bigint").alias("n_bad_label"),
        F.avg(lab.cast("double")).alias("default_rate"),
    ).withColumn("ok", (F.col("n_rows") > 0) & (F.col("n_bad_label") == 0))


def project_contract(df: DataFrame) -> DataFrame:
    """``sample_id, default`` + the 67 features, keeping only columns that exist."""
    keep = [c for c in [ID_COL, LABEL_COL] + ALL_FEATURES if c in df.columns]
    return df.select(*keep)


def coverage_report(df: DataFrame, ok_at: float = 100.0, warn_at: float = 80.0) -> DataFrame:
    """Per module found / missing / coverage % / status.

    Expected names left-joined to the frame's column names (both tiny, schema-sized).
    Thresholds: (100, 80) is the validation script, (80, 50) the first mapping script.
    """
    spark = df.sparkSession
    expected = contract_frame(spark)
    present = spark.createDataFrame([(c,) for c in df.columns], "feature string") \
        .withColumn("present", F.lit(True))
    joined = expected.join(F.broadcast(present), "feature", "left")
    rep = joined.groupBy("module").agg(
        F.count(F.lit(1)).alias("expected"),
        F.sum(F.when(F.col("present"), 1).otherwise(0)).cast("bigint").alias("found"),
    )
    rep = rep.withColumn("missing", F.col("expected") - F.col("found")) \
        .withColumn("coverage_pct", round_half_up(F.col("found") * 100.0 / F.col("expected"), 2))
    return rep.withColumn(
        "status",
        F.when(F.col("coverage_pct") >= ok_at, "OK")
        .when(F.col("coverage_pct") >= warn_at, "WARN").otherwise("FAIL"),
    )


def missing_features(df: DataFrame) -> DataFrame:
    """Contract features absent from the frame (left_anti on name frames)."""
    spark = df.sparkSession
    present = spark.createDataFrame([(c,) for c in df.columns], "feature string")
    return contract_frame(spark).join(F.broadcast(present), "feature", "left_anti")


def drop_unnamed(df: DataFrame) -> DataFrame:
    """B1: drop index-spill columns whose name contains ``Unnamed``."""
    return df.select(*[c for c in df.columns if "Unnamed" not in c])


def unnamed_report(df: DataFrame) -> DataFrame:
    """B1: the columns that ``drop_unnamed`` drops, with their share of NULLs in percent (one aggregate)."""
    gone = [c for c in df.columns if "Unnamed" in c]
    if not gone:
        return df.sparkSession.createDataFrame([], "feature string, null_pct double")
    wide = df.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"n{k}") for k, c in enumerate(gone)))
    args = ", ".join(f"'{c}', n{k} * 100" for k, c in enumerate(gone))
    return wide.selectExpr(f"stack({len(gone)}, {args}) AS (feature, null_pct)").withColumn("null_pct", round_half_up("null_pct", 2))


def filled_counts(df: DataFrame) -> DataFrame:
    """Module, feature, ord, present, filled (non-null values) and n (rows) of the 67 contract features, from one aggregate."""
    there = [f for f in ALL_FEATURES if f in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(f"`{f}`").alias(f) for f in there))
    args = ", ".join(f"'{f}', `{f}`" for f in there)
    long = wide.selectExpr("n", f"stack({len(there)}, {args}) AS (feature, filled)") if there else wide.selectExpr("n", "CAST(NULL AS STRING) AS feature", "CAST(0 AS BIGINT) AS filled")
    names = contract_frame(df.sparkSession).withColumn("present", F.col("feature").isin(there))
    counted = names.join(long.drop("n"), "feature", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    return counted.crossJoin(F.broadcast(wide.select("n")))  # one row


def coverage_by_value(df: DataFrame) -> DataFrame:
    """B9 by values: per module expected, found and filled features and the share of cells with a value in percent."""
    out = filled_counts(df).groupBy("module").agg(
        F.count(F.lit(1)).alias("expected"), F.sum(F.col("present").cast("long")).alias("found"), F.sum((F.col("filled") > 0).cast("long")).alias("filled"),
        F.try_divide(F.sum("filled") * 100.0, F.sum("n")).alias("filled_pct"))
    return out.withColumn("filled_pct", round_half_up("filled_pct", 2))
