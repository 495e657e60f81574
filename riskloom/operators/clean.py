"""Fit-on-train / apply-everywhere preprocessing (C1-C13) as a Spark ML Estimator/Model.

Fit runs a handful of small aggregate jobs (mode, correlation, minima, category
counts, medians) over the de-duplicated train frame -- each returns O(columns) values
to the driver -- and freezes them in a JSON-serialisable state. What the reference
recomputes per split (T5 mode, C3 median, C8 modes) is a ``SplitStatistics``: computed once a split
by grouped counts and exact quantiles, then an explicit input of ``apply``, which is a
projection without aggregates or joins. No step shuffles whole rows except the
train-only de-duplication, and that one only rows whose digest occurs again.

Reference quirks reproduced by default (SURVEY §0.1): T3 dedup after split, T5 mode
per split, T6 medians kept only when train had NULLs, T7 log of a value below the
train shift -> NULL. ``fit_mode=True`` / ``always_medians=True`` give leak-free variants.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clip, map_values, safe_corr, safe_div
from ..session import staged
from ..sources.contract import ID_COL, LABEL_COL
from .duplicates import distinct_rows
from .quantiles import grouped_modes, medians

# Ordinal education map (T2: unmapped or NULL -> 2), money columns that
# are log-transformed, and the one-hot columns, in the reference's order.
EDUCATION_MAP = {"THPT": 1, "CĐ": 2, "ĐH": 3, "Master": 4}
EDUCATION_DEFAULT = 2
LOG_TRANSFORM_COLS = [
    "free_cash_flow", "net_cash_flow",
    "total_outstanding_debt", "avg_daily_balance",
    "min_balance_3m", "collateral_value",
    "avg_monthly_deposits", "avg_monthly_withdrawals",
]
ONE_HOT_COLS = ["business_zone", "industry_lifecycle_stage", "collateral_type"]
DEBT_COL = "debt_burden_ratio"
DEBT_CAP = 3.0
DEBT_CORR_MIN = 0.3
#: A one-hot column with more values than this is refused: each value becomes a column.
MAX_CATEGORIES = 1000
PASSTHROUGH = (ID_COL, LABEL_COL)
NON_FEATURE = ("clone_ord", "split")


# --------------------------------------------------------------------------- steps
def fix_collateral_type(df: DataFrame, mode_value: str | None = None) -> DataFrame:
    """has_collateral = 0 and NULL type -> 'None'; remaining NULLs -> the mode of this
    frame (ties -> smallest), or ``mode_value`` when given."""
    if "collateral_type" not in df.columns:
        return df
    out = _without_collateral(df)
    if mode_value is None:
        mode_value = grouped_modes(out, ["collateral_type"])["collateral_type"]
    return out.withColumn("collateral_type", F.coalesce(F.col("collateral_type"), F.lit(mode_value)))


def _without_collateral(df: DataFrame) -> DataFrame:
    """C2, first half: no collateral and no type is the type 'None'."""
    if "collateral_type" not in df.columns or "has_collateral" not in df.columns:
        return df
    c = F.col("collateral_type")
    return df.withColumn("collateral_type", F.when((F.col("has_collateral") == 0) & c.isNull(), F.lit("None")).otherwise(c))


def debt_recalc_expr() -> Column:
    """Debt / (12 * deposits), zero deposits -> NULL, clipped to [0, 10]."""
    return clip(safe_div(F.col("total_outstanding_debt"), F.col("avg_monthly_deposits") * 12), 0.0, 10.0)


def debt_burden_diagnostics(df: DataFrame) -> DataFrame:
    """Share of rows at the 3.0 cap and Pearson r(original, recalculated)."""
    return df.agg(
        F.avg(F.when(F.col(DEBT_COL) == DEBT_CAP, 1.0).otherwise(0.0)).alias("pct_at_cap"),
        safe_corr(DEBT_COL, debt_recalc_expr()).alias("corr"),
    )


def apply_debt_strategy(df: DataFrame, strategy: str | None, median: float | None = None) -> DataFrame:
    """C3 apply: 'drop' removes the column; 'recalc' recomputes it and fills NULLs with
    this frame's median, or ``median`` when given."""
    if DEBT_COL not in df.columns or strategy is None:
        return df
    if strategy == "drop":
        return df.drop(DEBT_COL)
    if "avg_monthly_deposits" not in df.columns:
        return df
    out = df.withColumn(DEBT_COL, debt_recalc_expr())
    if median is None:
        median = medians(out, {DEBT_COL: F.col(DEBT_COL)})[DEBT_COL]
    return out.withColumn(DEBT_COL, F.coalesce(F.col(DEBT_COL), F.lit(median).cast("double")))


def education_ordinal(col: str = "owner_education") -> Column:
    """C4: THPT/CĐ/ĐH/Master -> 1..4, anything else -> 2 (as double, like pandas)."""
    return map_values(col, EDUCATION_MAP, EDUCATION_DEFAULT).cast("double")


def one_hot_name(col: str, value: str) -> str:
    return f"{col}_{value}"


def one_hot(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """For each column, drop it and append ``col_value`` 0/1 columns in sorted value
    order (NULL -> all zeros); values unseen at fit also give all zeros."""
    out = df
    for col in ONE_HOT_COLS:
        if col not in out.columns:
            continue
        dummies = [F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)).alias(one_hot_name(col, v))
                   for v in categories.get(col, [])]
        out = out.select(*[c for c in out.columns if c != col], *dummies)
    return out


def log_transform(df: DataFrame, shifts: dict[str, float]) -> DataFrame:
    """log1p(x + shift); a shifted value <= -1 gives NULL."""
    out = df
    for col, shift in shifts.items():
        if col in out.columns:
            y = F.col(col) + F.lit(float(shift))
            out = out.withColumn(col, F.when(y > -1, F.log1p(y)))
    return out


@dataclass
class PreprocessorState:
    debt_strategy: str | None = None
    debt_corr: float | None = None
    debt_pct_at_cap: float | None = None
    categories: dict = field(default_factory=dict)
    log_shifts: dict = field(default_factory=dict)
    medians: dict = field(default_factory=dict)
    string_cols: list = field(default_factory=list)
    feature_names_out: list = field(default_factory=list)
    collateral_mode: str | None = None
    debt_median: float | None = None
    string_modes: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "PreprocessorState":
        return cls(**json.loads(text))


@dataclass(frozen=True)
class SplitStatistics:
    """What scoring takes from the frame it scores: C2's mode, C3's median (recalc) and C8's modes."""

    collateral_mode: str | None = None
    debt_median: float | None = None
    string_modes: dict = field(default_factory=dict)


class Preprocessor(Estimator):
    """Fit order C1 -> label split -> C2 -> C3 -> C4/C5 -> C6 -> C7/C8.

    ``distinct``: the rows given are a table that has been through C1, which is not taken again."""

    def __init__(self, fit_mode: bool = False, always_medians: bool = False, distinct: bool = False):
        super().__init__()
        self.fit_mode = fit_mode
        self.always_medians = always_medians
        self.distinct = distinct

    def _fit(self, dataset: DataFrame) -> "PreprocessorModel":
        drop = [c for c in NON_FEATURE if c in dataset.columns]
        train = dataset.drop(*drop)
        if not self.distinct:
            train = staged(distinct_rows(train), "distinct_train")         # C1 (T3)
        st = PreprocessorState()
        features = [c for c in train.columns if c not in PASSTHROUGH]

        x = train                                                          # C2
        if "collateral_type" in x.columns:
            st.collateral_mode = grouped_modes(_without_collateral(x), ["collateral_type"])["collateral_type"]
            x = fix_collateral_type(x, st.collateral_mode)

        if DEBT_COL in features:                                           # C3
            if "total_outstanding_debt" in features and "avg_monthly_deposits" in features:
                d = debt_burden_diagnostics(x).first()
                st.debt_pct_at_cap, st.debt_corr = d["pct_at_cap"], d["corr"]
                ok = st.debt_corr is not None and st.debt_corr == st.debt_corr and abs(st.debt_corr) > DEBT_CORR_MIN
                st.debt_strategy = "recalc" if ok else "drop"
            else:
                st.debt_strategy = "drop"
        if st.debt_strategy == "recalc":
            st.debt_median = medians(x, {DEBT_COL: debt_recalc_expr()})[DEBT_COL]
        x = apply_debt_strategy(x, st.debt_strategy, st.debt_median)

        if "owner_education" in x.columns:                                 # C4
            x = x.withColumn("owner_education", education_ordinal())
        present = [c for c in ONE_HOT_COLS if c in x.columns]              # C5
        if present:
            st.categories = {c: [] for c in present}
            pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in present))).alias("p")
            kinds = x.select(pairs).select("p.*").filter("v is not null").groupBy("c", "v").count()
            many = kinds.groupBy("c").count().filter(F.col("count") > MAX_CATEGORIES).select("c").collect()
            if many:
                raise ValueError(f"more than {MAX_CATEGORIES} categories in {sorted(r['c'] for r in many)}")
            for r in kinds.orderBy("c", "v").select("c", "v").collect():   # bounded by MAX_CATEGORIES
                st.categories[r["c"]].append(r["v"])
        x = one_hot(x, st.categories)

        money = [c for c in LOG_TRANSFORM_COLS if c in x.columns]          # C6
        if money:
            mins = x.agg(*[F.min(c).alias(c) for c in money]).first()
            st.log_shifts = {c: (abs(mins[c]) + 1.0 if mins[c] is not None and mins[c] < 0 else 0.0)
                             for c in money}
        x = log_transform(x, st.log_shifts)

        onehot = {one_hot_name(c, v) for c, vs in st.categories.items() for v in vs}
        numeric = [f.name for f in x.schema.fields
                   if isinstance(f.dataType, T.NumericType) and f.name not in PASSTHROUGH and f.name not in onehot]
        st.string_cols = [f.name for f in x.schema.fields
                          if isinstance(f.dataType, T.StringType) and f.name not in PASSTHROUGH]
        if st.string_cols:
            st.string_modes = grouped_modes(x, st.string_cols)
        if numeric:                                                        # C7
            nulls = x.agg(F.sum(sum([F.col(c).isNull().cast("int") for c in numeric], F.lit(0)))).first()[0]
            if self.always_medians or (nulls or 0) > 0:
                st.medians = {c: m for c, m in medians(x, {c: F.col(c) for c in numeric}).items() if m is not None}
        st.feature_names_out = [c for c in x.columns if c not in PASSTHROUGH]
        return PreprocessorModel(st, fit_mode=self.fit_mode)


class PreprocessorModel(Model):
    """Frozen C3/C5/C6/C7 state. ``apply`` takes the frame's statistics (T5) and is a projection;
    ``transform`` computes them first, or with ``fit_mode`` takes train's (works on streams)."""

    def __init__(self, state: PreprocessorState, fit_mode: bool = False):
        super().__init__()
        self.state = state
        self.fit_mode = fit_mode

    def train_statistics(self) -> SplitStatistics:
        st = self.state
        return SplitStatistics(st.collateral_mode, st.debt_median, dict(st.string_modes))

    def statistics(self, dataset: DataFrame) -> SplitStatistics:
        """The frame's own statistics: one pass for the modes, and one for the median if it is wanted."""
        st, x = self.state, _without_collateral(dataset)
        plain = [c for c in st.string_cols if c in x.columns]
        modes = grouped_modes(x, plain + (["collateral_type"] if "collateral_type" in x.columns else []))
        median = None
        if st.debt_strategy == "recalc" and {DEBT_COL, "total_outstanding_debt", "avg_monthly_deposits"} <= set(x.columns):
            median = medians(x, {DEBT_COL: debt_recalc_expr()})[DEBT_COL]
        return SplitStatistics(modes.get("collateral_type"), median, {c: modes[c] for c in plain})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.apply(dataset, self.train_statistics() if self.fit_mode else self.statistics(dataset))

    def apply(self, dataset: DataFrame, statistics: SplitStatistics, keep: tuple = ()) -> DataFrame:
        """C10 as a projection: ids and label, ``keep``, then the features of train in their order."""
        st = self.state
        keep = [c for c in (*PASSTHROUGH, *keep) if c in dataset.columns]
        x = dataset.drop(*[c for c in NON_FEATURE if c in dataset.columns and c not in keep])
        if "collateral_type" in x.columns:
            x = _without_collateral(x).withColumn("collateral_type", F.coalesce(F.col("collateral_type"), F.lit(statistics.collateral_mode)))
        if st.debt_strategy == "recalc" and DEBT_COL in x.columns and "avg_monthly_deposits" in x.columns:
            x = x.withColumn(DEBT_COL, F.coalesce(debt_recalc_expr(), F.lit(statistics.debt_median).cast("double")))
        elif st.debt_strategy == "drop":
            x = x.drop(DEBT_COL)
        if "owner_education" in x.columns:
            x = x.withColumn("owner_education", education_ordinal())
        x = one_hot(x, st.categories)
        x = log_transform(x, st.log_shifts)
        for c, m in st.medians.items():                                   # C7
            if c in x.columns:
                x = x.withColumn(c, F.coalesce(F.col(c), F.lit(float(m))))
        for c in st.string_cols:                                          # C8
            if c in x.columns:
                x = x.withColumn(c, F.coalesce(F.col(c), F.lit(statistics.string_modes.get(c)), F.lit("Unknown")))
        cols = []                                                         # B4
        for c in st.feature_names_out:
            cols.append(F.col(c) if c in x.columns else F.lit(0).alias(c))
        return x.select(*keep, *cols)

    def save(self, path: str) -> None:
        """The state is a few hundred bytes of JSON, written through Spark so it
        lands on the cluster's shared storage."""
        spark = self._spark()
        spark.createDataFrame([(self.state.to_json(), self.fit_mode)], "state string, fit_mode boolean") \
            .coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark, path: str) -> "PreprocessorModel":
        row = spark.read.json(path).first()
        return cls(PreprocessorState.from_json(row["state"]), bool(row["fit_mode"]))

    @staticmethod
    def _spark():
        from pyspark.sql import SparkSession
        return SparkSession.getActiveSession()


def residual_nulls(df: DataFrame) -> DataFrame:
    """NULL count per column after preprocessing, plus the row count (one pass)."""
    cols = [c for c in df.columns]
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  sum([F.sum(F.col(f"`{c}`").isNull().cast("long")) for c in cols], F.lit(0)).alias("null_cells"))
