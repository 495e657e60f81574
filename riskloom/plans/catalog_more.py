"""Paths that the other catalogs leave out: sources with rejects, files that are written and read back,
every split, every ratio (A1, A3, A6, A8, B1, B3, B9, C2, C3, C7, F23, F25, H1, I2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean as CL
from ..operators import features as FE
from ..operators import profile as P
from ..operators import rank as RK
from ..operators import targets as TG
from ..operators.ratios import RATIO_COLS
from ..session import shared_path
from ..sources import contract as CT
from ..sources import fixtures as FX
from ..sources import io as IO
from ..sources.tables import read_table
from . import datasets as DS
from .catalog_clean import CS_COLUMNS, PREP, SP
from .catalog_extra import _selection_sql
from .catalog_profile import D67_COLUMNS, POP_CTES, _acklam_sql, _pops
from .oracle_views import rnd, with_views
from .registry import register
from .sqlgen import q

D67, FF = ("dataset67",), ("financial_features",)
SPLIT_NAMES = ("train", "val", "test")
#: Every so many ids the written label is no label, so that its line must be rejected.
BAD_EVERY = 97


def _split_rows(spark, sf_dir, name):
    return DS.splits(spark, sf_dir).filter(F.col("split") == name).drop("split", "clone_ord")


def _written_splits(spark, sf_dir):
    """The three splits as CSV files, some labels broken: {split: path}."""
    def build():
        base = shared_path(spark, "csv_splits")
        for name in SPLIT_NAMES:
            label = F.when(F.col("sample_id") % BAD_EVERY == 0, F.lit("?")).otherwise(F.col("default").cast("string"))
            rows = _split_rows(spark, sf_dir, name)
            IO.write_table(rows.select(*(label.alias(c) if c == "default" else F.col(f"`{c}`") for c in rows.columns)), f"{base}/{name}", fmt="csv")
        return {name: f"{base}/{name}" for name in SPLIT_NAMES}
    return DS._memo(spark, sf_dir, "csv_splits", build)


def _csv_schema(spark, sf_dir):
    return DS.splits(spark, sf_dir).drop("split", "clone_ord").schema


_OK = f"sample_id % {BAD_EVERY} <> 0"


@register("A1_csv_splits_checked", with_views(
    f"SELECT split, count(*) FILTER ({_OK}) AS n_rows, count(*) FILTER (NOT ({_OK})) AS n_rejected, CAST(0 AS BIGINT) AS n_bad_label, "
    + rnd(f'avg(CAST("default" AS DOUBLE)) FILTER ({_OK})') + " AS default_rate, "
    f"count(*) FILTER ({_OK} AND (collateral_type IS NULL OR collateral_type = 'None')) AS null_collateral, "
    + rnd(f"sum(roa) FILTER ({_OK})") + " AS sum_roa FROM splits GROUP BY split", *D67, extra=SP))
def q_a1_csv(spark, sf_dir):
    """CSV splits written and read back with the declared schema, checked in one aggregate; 'None' is NULL."""
    rows, rejects = IO.read_splits_checked(spark, _written_splits(spark, sf_dir), "csv", _csv_schema(spark, sf_dir))
    good = rows.groupBy("split").agg(F.sum(F.col("collateral_type").isNull().cast("long")).alias("null_collateral"), F.sum("roa").alias("sum_roa"))
    return IO.split_report(rows, rejects).join(good, "split")


@register("A1_csv_rejects", with_views(
    f"SELECT split, sample_id, 'unreadable' AS reason FROM splits WHERE sample_id % {BAD_EVERY} = 0", *D67, extra=SP))
def q_a1_rejects(spark, sf_dir):
    """A1: the lines that do not fit the declared schema, listed with their split (the id is the line's first field)."""
    _, rejects = IO.read_splits_checked(spark, _written_splits(spark, sf_dir), "csv", _csv_schema(spark, sf_dir))
    return rejects.select("split", F.split("line", ",")[0].cast("long").alias("sample_id"), "reason")


_DISTRICTS = ("SELECT n_nationkey + 1 AS code, CAST(3 + n_regionkey AS DOUBLE) AS score, n_nationkey AS line FROM nation UNION ALL "
              "SELECT n_nationkey + 1, CAST(8 - n_regionkey AS DOUBLE), 1000 + n_nationkey FROM nation WHERE n_nationkey % 4 = 0")


@register("A8_lookup_files", with_views(
    "SELECT s.sample_id, s.district_code, d.score AS district_score FROM dataset67 s LEFT JOIN (SELECT code, arg_max(score, line) AS score FROM "
    f"({_DISTRICTS}) l WHERE code <> 13 GROUP BY code) d ON d.code = s.district_code", *D67))
def q_a8(spark, sf_dir):
    """A district lookup read from CSV files; the last line of a repeated key wins, an absent key is NULL."""
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").filter("n_nationkey <> 12")
    first = n.select((F.col("n_nationkey") + 1).cast("int").alias("code"), (F.lit(3.0) + F.col("n_regionkey")).alias("score"), F.col("n_nationkey").cast("long").alias("line"))
    again = n.filter("n_nationkey % 4 = 0").select((F.col("n_nationkey") + 1).cast("int").alias("code"), (F.lit(8.0) - F.col("n_regionkey")).alias("score"),
                                                   (F.col("n_nationkey") + 1000).cast("long").alias("line"))
    paths = [shared_path(spark, "lookup"), shared_path(spark, "lookup")]
    for rows, path in zip((first, again), paths):
        IO.write_table(rows, path, fmt="csv")
    lookup = FE.dedupe_lookup_last(IO.read_many(spark, paths, "csv", first.schema), "code", "score", "line")
    companies = DS.dataset67(spark, sf_dir).select("sample_id", "district_code")
    return companies.join(lookup, F.col("code") == F.col("district_code"), "left").select("sample_id", "district_code", F.col("score").alias("district_score"))


@register("B1_drop_unnamed", with_views(
    "SELECT 'Unnamed: 0' AS feature, " + rnd("100.0 * count(*) FILTER (sample_id % 3 <> 0) / count(*)", 2) + f" AS null_pct, {len(D67_COLUMNS)} AS kept_columns FROM dataset67 UNION ALL "
    f"SELECT 'Unnamed: 70', 100.0, {len(D67_COLUMNS)}", *D67), digits=2)
def q_b1(spark, sf_dir):
    """B1: index-spill columns with their share of NULLs, and the columns that stay."""
    d = DS.dataset67(spark, sf_dir)
    spilt = d.withColumn("Unnamed: 0", F.when(F.col("sample_id") % 3 == 0, F.col("sample_id"))).withColumn("Unnamed: 70", F.lit(None).cast("string"))
    return CT.unnamed_report(spilt).withColumn("kept_columns", F.lit(len(CT.drop_unnamed(spilt).columns)))


@register("B3b_module4_selection_all", with_views(
    "\nUNION ALL\n".join(f"SELECT '{n}' AS split, * FROM ({_selection_sql('S4', t)}) s_{n}" for n, t in zip(SPLIT_NAMES, ("pp_train", "pp_val", "pp_test"))), *D67, extra=PREP))
def q_b3b(spark, sf_dir):
    """Module-4 inputs with one-hot prefix expansion on all three splits."""
    frames = [TG.select_features(x, TG.MODULE_SPECS["S4"]).select(F.lit(n).alias("split"), "*") for n, x in zip(SPLIT_NAMES, DS.preprocessed(spark, sf_dir))]
    return reduce(DataFrame.unionByName, frames)


def _coverage_value_sql(cols):
    rows = "\nUNION ALL\n".join(
        f"SELECT '{m}' AS module, '{f}' AS feature, {i + 1} AS ord, CAST({f'count({q(f)})' if f in cols else '0'} AS BIGINT) AS filled, count(*) AS n, {str(f in cols).lower()} AS present FROM credit_sample"
        for m, fs in CT.MODULES.items() for i, f in enumerate(fs))
    return rows


@register("B9c_coverage_by_value", with_views(
    "SELECT module, count(*) AS expected, CAST(sum(CASE WHEN present THEN 1 ELSE 0 END) AS BIGINT) AS found, CAST(sum(CASE WHEN filled > 0 THEN 1 ELSE 0 END) AS BIGINT) AS filled, "
    + rnd("100.0 * sum(filled) / sum(n)", 2) + f" AS filled_pct FROM ({_coverage_value_sql(CS_COLUMNS)}) t GROUP BY module", "credit_sample"), digits=2)
def q_b9c(spark, sf_dir):
    """Coverage of the contract by values: columns there, columns with values, share of cells filled per module."""
    return CT.coverage_by_value(FX.credit_sample(spark, sf_dir, DS.financial_features(spark, sf_dir)))


@register("I2b_features_without_values", with_views(
    f"SELECT module, feature, ord FROM ({_coverage_value_sql(CS_COLUMNS)}) t WHERE filled = 0", "credit_sample"))
def q_i2b(spark, sf_dir):
    """Contract features without a single value, absent columns among them."""
    cs = FX.credit_sample(spark, sf_dir, DS.financial_features(spark, sf_dir))
    return CT.filled_counts(cs).filter("filled = 0").select("module", "feature", "ord")


@register("C2b_collateral_fill_all", with_views(
    "SELECT 'train' AS split, sample_id, collateral_type FROM tr_c2 UNION ALL SELECT 'val', sample_id, collateral_type FROM va_c2 "
    "UNION ALL SELECT 'test', sample_id, collateral_type FROM te_c2", *D67, extra=PREP))
def q_c2b(spark, sf_dir):
    """collateral_type fill on all splits, each with its own mode (T5)."""
    frames = {"train": DS.distinct_train(spark, sf_dir), "val": _split_rows(spark, sf_dir, "val"), "test": _split_rows(spark, sf_dir, "test")}
    return reduce(DataFrame.unionByName, [CL.fix_collateral_type(x).select(F.lit(n).alias("split"), "sample_id", "collateral_type") for n, x in frames.items()])


_RECALC = "greatest(least(total_outstanding_debt / nullif(avg_monthly_deposits * 12, 0), 10.0), 0.0)"
_RECALC = f"CASE WHEN total_outstanding_debt / nullif(avg_monthly_deposits * 12, 0) IS NULL THEN NULL ELSE {_RECALC} END"


@register("C3c_debt_recalculated", with_views(
    "\nUNION ALL\n".join(f"SELECT '{n}' AS split, sample_id, {rnd('coalesce(r, (SELECT quantile_cont(r, 0.5) FROM ' + t + '_r))')} AS debt_burden_ratio FROM {t}_r"
                         for n, t in zip(SPLIT_NAMES, ("tr", "va", "te"))), *D67,
    extra=[*PREP, *(f"{t}_r AS (SELECT sample_id, {_RECALC} AS r FROM {t}_raw)" for t in ("tr", "va", "te"))]))
def q_c3c(spark, sf_dir):
    """C3, the 'recalc' branch: the ratio from debt and deposits, gaps filled with each split's own median."""
    frames = {"train": DS.distinct_train(spark, sf_dir), "val": _split_rows(spark, sf_dir, "val"), "test": _split_rows(spark, sf_dir, "test")}
    return reduce(DataFrame.unionByName, [CL.apply_debt_strategy(x, "recalc").select(F.lit(n).alias("split"), "sample_id", "debt_burden_ratio") for n, x in frames.items()])


_GAP = "CASE WHEN sample_id % 7 = 0 THEN NULL ELSE {c} END"


@register("C7b_fitted_median_fill", with_views(
    "SELECT sample_id, " + ", ".join(f"{rnd(f'coalesce({_GAP.format(c=c)}, (SELECT quantile_cont({_GAP.format(c=c)}, 0.5) FROM tr_raw))')} AS {c}" for c in ("cic_score", "roa", "loan_to_value"))
    + " FROM va_raw", *D67, extra=PREP))
def q_c7b(spark, sf_dir):
    """Medians fitted on a train split with gaps fill the gaps of val through the fitted model."""
    gap = {c: F.when(F.col("sample_id") % 7 != 0, F.col(c)) for c in ("cic_score", "roa", "loan_to_value")}
    model = CL.Preprocessor().fit(DS.distinct_train(spark, sf_dir).withColumns(gap))
    return model.transform(_split_rows(spark, sf_dir, "val").withColumns(gap)).select("sample_id", *(F.col(c).cast("double").alias(c) for c in gap))


def _density_sql(bins: int) -> str:
    stacked = "\nUNION ALL\n".join(f"SELECT '{p}' AS population, '{c}' AS feature, CAST({q(c)} AS DOUBLE) AS value FROM pop_{p} WHERE {q(c)} IS NOT NULL" for p in "ab" for c in RATIO_COLS)
    start, end = f"lo + bin * ((hi - lo) / {bins})", f"lo + (bin + 1) * ((hi - lo) / {bins})"
    return (f"SELECT population, feature, bin, {rnd(start)} AS bin_start, {rnd(end)} AS bin_end, count(*) AS count, {rnd(f'count(*) / nullif(n * (({end}) - ({start})), 0)')} AS density FROM ("
            f"SELECT s.*, lo, hi, n, CAST(CASE WHEN hi = lo THEN {bins // 2} ELSE least(floor((value - lo) / ((hi - lo) / {bins})), {bins - 1}) END AS INT) AS bin "
            f"FROM stacked s JOIN (SELECT population, feature, min(value) AS lo, max(value) AS hi, count(*) AS n FROM stacked GROUP BY ALL) b USING (population, feature)) t "
            "GROUP BY population, feature, bin, lo, hi, n"), f"stacked AS ({stacked})"


_DENSITY, _STACKED = _density_sql(30)


@register("F23b_density_two_populations", with_views(_DENSITY, *FF, extra=[*POP_CTES, _STACKED]))
def q_f23b(spark, sf_dir):
    """30-bin density tables of the 12 ratios for two populations."""
    a, b = _pops(spark, sf_dir)
    both = a.withColumn("population", F.lit("a")).unionByName(b.withColumn("population", F.lit("b")))
    return P.histogram(both, RATIO_COLS, 30, ["population"], density=True)


def _qq_pooled_sql(col: str) -> str:
    m = ("CASE WHEN i + 1 = 1 THEN 1 - pow(0.5, 1.0 / n) WHEN i + 1 = n THEN pow(0.5, 1.0 / n) "
         "ELSE (i + 1 - 0.3175) / (n + 0.365) END")
    pts = (f"SELECT i, value, {_acklam_sql('m')} AS theoretical FROM (SELECT *, {m} AS m FROM (SELECT CAST({q(col)} AS DOUBLE) AS value, "
           f"row_number() OVER (ORDER BY {q(col)}) - 1 AS i, count(*) OVER () AS n FROM financial_features WHERE {q(col)} IS NOT NULL) a) b")
    return (f"SELECT '{col}' AS feature, i, {rnd('value')} AS value, {rnd('theoretical')} AS theoretical, {rnd('regr_slope(value, theoretical) OVER ()')} AS slope, "
            f"{rnd('regr_intercept(value, theoretical) OVER ()')} AS intercept FROM ({pts}) p_{col}")


@register("F25b_qq_all_ratios", with_views("\nUNION ALL\n".join(_qq_pooled_sql(c) for c in RATIO_COLS), *FF))
def q_f25b(spark, sf_dir):
    """Q-Q tables of all 12 ratios over all companies, with the fitted lines."""
    return P.qq_tables(DS.financial_features(spark, sf_dir), RATIO_COLS)


@register("H1b_sorted_positions", with_views(
    "SELECT ticker, year, row_number() OVER (ORDER BY ticker, year) - 1 AS pos FROM financial_features", *FF))
def q_h1b(spark, sf_dir):
    """H1: the panel's rows with their positions in (ticker, year) order."""
    return RK.position_by_value(DS.financial_features(spark, sf_dir).select("ticker", "year"), "ticker", ["year"])
