"""Sources/sinks and selections that complete SURVEY §2 A/B/C coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as CL
from ..operators import profile as P
from ..operators import targets as TG
from ..operators.ratios import RATIO_COLS
from ..operators.quantiles import medians
from ..session import shared_path
from ..sources import io as IO
from . import datasets as DS
from .catalog_clean import PP_NUMERIC, PREP
from .catalog_meta import SCORES, split_scores
from .oracle_views import rnd, with_views
from .registry import register
from .sqlgen import describe_sql, q

D67 = ("dataset67",)


@register("A7_params_document_roundtrip", with_views(
    "SELECT s.industry_code, CASE s.industry_code WHEN 10 THEN 'Food Manufacturing' WHEN 46 THEN 'Wholesale' "
    "WHEN 56 THEN 'F&B' ELSE 'Industry ' || CAST(s.industry_code AS VARCHAR) END AS industry_name, n.n_samples, "
    "s.feature, s.mean, s.median, s.std, s.count, f.mu, f.sigma FROM ("
    + describe_sql("financial_features", RATIO_COLS, ("mean", "median", "std", "count"), ["industry_code"])
    + ") s JOIN (SELECT industry_code, feature, mean AS mu, std_pop AS sigma FROM ("
    + describe_sql("financial_features", RATIO_COLS, ("mean", "std_pop"), ["industry_code"])
    + ") x) f USING (industry_code, feature) JOIN (SELECT industry_code, count(*) AS n_samples FROM financial_features "
    "GROUP BY industry_code) n ON n.industry_code = s.industry_code", "financial_features"))
def q_a7(spark, sf_dir):
    """Per-industry parameter documents written as JSON and read back with the
    declared nested schema; flattened per (industry, ratio)."""
    doc = P.industry_params(DS.financial_features(spark, sf_dir), RATIO_COLS)
    path = shared_path(spark, "params")
    IO.write_params(doc, path)
    back = IO.read_params(spark, path)
    st = back.select("industry_code", "industry_name", "n_samples",
                     F.explode("statistics").alias("feature", "s"), "distributions")
    return st.select("industry_code", "industry_name", "n_samples", "feature", "s.mean", "s.median", "s.std",
                     "s.count", F.col("distributions")[F.col("feature")]["mu"].alias("mu"),
                     F.col("distributions")[F.col("feature")]["sigma"].alias("sigma"))


@register("A10_scores_sink_partition_pruned", with_views(
    "SELECT sample_id, \"default\", " + ", ".join(rnd(m) + f" AS {m}" for m in ("S1", "S2", "S3", "S4"))
    + " FROM sc_va", *D67, extra=SCORES))
def q_a10(spark, sf_dir):
    """Scores of all splits written partitioned by split; reading split='val'
    back prunes to one partition folder."""
    sc = split_scores(spark, sf_dir)
    allsplits = (sc["tr"].withColumn("split", F.lit("train")).unionByName(sc["va"].withColumn("split", F.lit("val")))
                 .unionByName(sc["te"].withColumn("split", F.lit("test"))))
    path = shared_path(spark, "scores")
    IO.write_table(allsplits.drop("past_bankruptcy"), path, partition_by=("split",))
    return spark.read.parquet(path).filter(F.col("split") == "val").drop("split")


def _selection_sql(name: str, table: str) -> str:
    spec = TG.MODULE_SPECS[name]
    from ..operators.clean import ONE_HOT_COLS
    from .catalog_clean import ONE_HOT_DOMAIN
    cols = []
    for f in spec.features:
        if f in ONE_HOT_COLS:
            cols += [f"{f}_{v}" for v in ONE_HOT_DOMAIN[f]] if spec.expand_one_hot else [f]
        else:
            cols.append(f)
    present = set(PP_NUMERIC) | {f"{c}_{v}" for c, vs in ONE_HOT_DOMAIN.items() for v in vs}
    sel = []
    for c in cols:
        sel.append(f"{rnd('CAST(' + q(c) + ' AS DOUBLE)')} AS {q(c)}" if c in present else f"0.0 AS {q(c)}")
    return f"SELECT sample_id, \"default\", {', '.join(sel)} FROM {table}"


@register("B2_module2_selection", with_views(_selection_sql("S2", "pp_train"), *D67, extra=PREP))
def q_b2(spark, sf_dir):
    """Module-2 inputs in contract order; the dropped debt_burden_ratio -> 0.0."""
    return TG.select_features(DS.preprocessed(spark, sf_dir)[0], TG.MODULE_SPECS["S2"])


@register("B3_module4_selection", with_views(_selection_sql("S4", "pp_val"), *D67, extra=PREP))
def q_b3(spark, sf_dir):
    """Module-4 inputs with one-hot prefix expansion (val)."""
    return TG.select_features(DS.preprocessed(spark, sf_dir)[1], TG.MODULE_SPECS["S4"])


@register("B7_industry_default_filter", with_views(
    "SELECT sample_id, industry_code, " + rnd("roa") + " AS roa FROM dataset67 WHERE industry_code = 46 AND \"default\" = 1",
    *D67))
def q_b7(spark, sf_dir):
    """Equality filters on industry and default class (pushed into the plan)."""
    d = DS.dataset67(spark, sf_dir)
    return d.filter((F.col("industry_code") == 46) & (F.col("default") == 1)).select("sample_id", "industry_code", "roa")


@register("C7_train_medians", with_views(
    "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, {rnd(f'quantile_cont(CAST({q(c)} AS DOUBLE), 0.5)')} AS median, "
                         f"(SELECT n FROM tr_nulls) > 0 AS applied FROM tr_c6" for c in PP_NUMERIC), *D67, extra=PREP))
def q_c7(spark, sf_dir):
    """Train medians of every numeric feature after C2-C6, and whether the
    reference would store them (only when train has a numeric NULL)."""
    sp = DS.splits(spark, sf_dir)
    model = DS.fitted_preprocessor(spark, sf_dir)
    tr = DS.distinct_train(spark, sf_dir)
    st = model.state
    x = CL.fix_collateral_type(tr)
    x = CL.apply_debt_strategy(x, st.debt_strategy)
    x = x.withColumn("owner_education", CL.education_ordinal())
    x = CL.log_transform(CL.one_hot(x, st.categories), st.log_shifts)
    cols = [c for c in PP_NUMERIC if c in x.columns]
    nulls = sum([F.sum(F.col(c).isNull().cast("long")) for c in cols], F.lit(0))
    applied = x.agg(nulls.alias("n")).first()["n"] > 0
    # as fitted where the fit stored them, else counted here
    found = st.medians if applied else medians(x, {c: F.col(c) for c in cols})
    return spark.createDataFrame([(c, float(found[c]) if found.get(c) is not None else None, applied) for c in cols], "feature string, median double, applied boolean")
