"""Hand-made micro frames for the edge cases of SURVEY §5 (2) and brute-force checks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions.columns import clip, inverse_normal_cdf, round_half_up, safe_div
from riskloom.operators import clean as CL
from riskloom.operators import metrics as MX
from riskloom.operators import rank as RK
from riskloom.operators import sampling as S
from riskloom.operators import targets as TG
from riskloom.operators.learners import decide_strategy
from riskloom.operators.ratios import remove_outliers


def test_clones_needed_anchor():
    # 3,000 rows with 168 defaults at 8.5 % -> 95 clones -> 3,095 rows
    assert S.clones_needed(3000, 168, 0.085) == 95
    assert S.clones_needed(100, 50, 0.085) <= 0


def test_safe_div_and_clip_keep_nulls(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (6.0, 2.0)], "a double, b double")
    out = df.select(safe_div("a", "b").alias("q"), clip(F.col("a"), 2.0, 5.0).alias("c")).collect()
    assert out[0]["q"] is None and out[1]["q"] is None and out[2]["q"] == 3.0
    assert out[0]["c"] == 2.0 and out[1]["c"] is None and out[2]["c"] == 5.0


def test_round_half_up_is_arithmetic(spark):
    df = spark.createDataFrame([(0.1234565,), (2.5,), (-2.5,)], "x double")
    got = [r[0] for r in df.select(round_half_up("x", 6)).collect()]
    assert got[0] == math.floor(0.1234565 * 1e6 + 0.5) / 1e6
    assert [r[0] for r in df.select(round_half_up("x", 0)).collect()][1:] == [3.0, -2.0]


def test_minmax_norm_constant_column_is_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    out = TG.with_norms(df, ["x"], fill_median=False).select("_n_x").collect()
    assert [r[0] for r in out] == [0.0, 0.0, 0.0]


def test_collateral_mode_ties_pick_smallest(spark):
    rows = [(1, "B"), (1, "A"), (1, None), (0, None)]
    df = spark.createDataFrame(rows, "has_collateral int, collateral_type string")
    # non-null after the 'None' fill: B, A, None -> a three-way tie -> smallest value 'A'
    vals = [r["collateral_type"] for r in CL.fix_collateral_type(df).collect()]
    assert sorted(vals) == ["A", "A", "B", "None"]


def test_education_unknown_maps_to_two(spark):
    df = spark.createDataFrame([("THPT",), ("Bachelor",), (None,), ("Master",)], "owner_education string")
    vals = [r[0] for r in df.select(CL.education_ordinal()).collect()]
    assert vals == [1.0, 2.0, 2.0, 4.0]


def test_log_transform_below_shift_is_null(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (None,)], "free_cash_flow double")
    out = [r[0] for r in CL.log_transform(df, {"free_cash_flow": 3.0}).collect()]
    assert out[0] is None and abs(out[1] - math.log1p(3.0)) < 1e-12 and out[2] is None


def test_one_hot_unseen_value_all_zero(spark):
    df = spark.createDataFrame([("CBD",), ("Mars",), (None,)], "business_zone string")
    out = CL.one_hot(df, {"business_zone": ["CBD", "Urban"]}).collect()
    assert [tuple(r) for r in out] == [(1, 0), (0, 0), (0, 0)]


def test_preprocessor_fit_transform_no_nulls_and_aligned(spark, sf_dir):
    from riskloom.plans import datasets as DS
    sp = DS.splits(spark, sf_dir)
    model = CL.Preprocessor().fit(sp.filter("split = 'train'"))
    assert model.state.debt_strategy in ("drop", "recalc")
    va = model.transform(sp.filter("split = 'val'"))
    assert va.columns[2:] == model.state.feature_names_out
    nulls = CL.residual_nulls(va.drop("sample_id", "default")).first()["null_cells"]
    assert nulls == 0


def test_outliers_sequential_differs_from_single_pass(spark):
    rows = [(float(i), float(i % 7)) for i in range(200)] + [(1e6, 3.0), (5.0, 1e6)]
    df = spark.createDataFrame(rows, "a double, b double")
    seq = remove_outliers(df, ["a", "b"], k=2.0).count()
    assert 0 < seq < len(rows)


def _brute_metrics(scores, labels):
    P = sum(labels)
    N = len(labels) - P
    auc_num = 0.0
    for s, y in zip(scores, labels):
        if y == 1:
            for s2, y2 in zip(scores, labels):
                if y2 == 0:
                    auc_num += 1.0 if s > s2 else 0.5 if s == s2 else 0.0
    ts = sorted(set(scores))
    best, ks = (-1.0, None), 0.0
    for t in ts:
        tp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 1)
        fp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 0)
        f1 = 2 * tp / (tp + fp + P) if tp else 0.0
        if f1 > best[0]:
            best = (f1, t)
        ks = max(ks, tp / P - fp / N)
    return auc_num / (P * N), ks, best[1], best[0]


def test_curve_metrics_match_brute_force_with_ties(spark):
    rnd = random.Random(7)
    scores = [round(rnd.random(), 1) for _ in range(300)]
    labels = [1 if rnd.random() < s * 0.6 else 0 for s in scores]
    df = spark.createDataFrame(list(zip(scores, labels)), "p double, y int")
    m = MX.curve_metrics(MX.binary_curve(df, "p", "y", n_buckets=4)).first()
    auc, ks, thr, f1 = _brute_metrics(scores, labels)
    assert abs(m["auc"] - auc) < 1e-12 and abs(m["ks"] - ks) < 1e-12
    assert m["best_threshold"] == thr and abs(m["best_f1"] - f1) < 1e-12


def test_single_class_auc_is_null(spark):
    df = spark.createDataFrame([(0.1, 0), (0.7, 0)], "p double, y int")
    m = MX.curve_metrics(MX.binary_curve(df, "p", "y")).first()
    assert m["auc"] is None and m["ks"] is None


def test_position_by_hash_is_a_permutation(spark):
    df = spark.range(5000).withColumn("k", RK.md5_key("id"))
    out = RK.position_by_hash(df, "k", out="pos", digits=2)
    rows = out.select("id", "k", "pos").collect()
    assert sorted(r["pos"] for r in rows) == list(range(5000))
    assert [r["id"] for r in sorted(rows, key=lambda r: r["pos"])] == \
        [r["id"] for r in sorted(rows, key=lambda r: r["k"])]


def test_stratified_split_sizes_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("sample_id"), (F.col("id") % 3).alias("industry_code"),
                                  (F.col("id") % 10 == 0).cast("int").alias("default"))
    out = S.stratified_split(df, clone_col=None)
    got = {(r["industry_code"], r["default"], r["split"]): r["count"]
           for r in out.groupBy("industry_code", "default", "split").count().collect()}
    sizes = {(r["industry_code"], r["default"]): r["count"] for r in df.groupBy("industry_code", "default").count().collect()}
    for key, n in sizes.items():
        assert got[key + ("train",)] == int(n * 0.70)
        assert got[key + ("val",)] == int(n * 0.15)


def test_decide_strategy():
    assert decide_strategy(0.90, 0.80, 0.03) == ("A", 1.0, 0.0)
    assert decide_strategy(0.80, 0.90, 0.03) == ("B", 0.0, 1.0)
    s, wa, wb = decide_strategy(0.80, 0.81, 0.03)
    assert s == "ensemble" and abs(wa + wb - 1) < 1e-12
    assert decide_strategy(-0.2, 0.0, 0.03)[0] == "B"
    assert decide_strategy(-0.01, -0.02, 0.03) == ("ensemble", 0.5, 0.5)


@pytest.mark.parametrize("p", [0.001, 0.02, 0.3, 0.5, 0.9, 0.999])
def test_inverse_normal_cdf(spark, p):
    got = spark.range(1).select(inverse_normal_cdf(F.lit(p))).first()[0]
    # invert with erf: Phi(x) = (1 + erf(x / sqrt 2)) / 2
    assert abs((1 + math.erf(got / math.sqrt(2))) / 2 - p) < 1e-8


def test_drop_unnamed_and_numeric_partition(spark):
    from riskloom.functions.columns import numeric_columns, string_columns
    from riskloom.sources.contract import drop_unnamed
    from riskloom.sources.io import split_xy
    df = spark.createDataFrame([(1, "a", 2.0, 0, 7)], "`Unnamed: 0` int, s string, x double, default int, sample_id long")
    assert drop_unnamed(df).columns == ["s", "x", "default", "sample_id"]
    assert numeric_columns(df, exclude=("sample_id", "default", "Unnamed: 0")) == ["x"]
    assert string_columns(df) == ["s"]
    x, label = split_xy(df)
    assert label == "default" and "sample_id" not in x.columns and "default" not in x.columns


def test_string_mode_fill_c8(spark):
    from riskloom.operators.clean import PreprocessorModel, PreprocessorState
    st = PreprocessorState(string_cols=["s"], feature_names_out=["s"], string_modes={"s": "q"})
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "s string")
    per_frame = [r[0] for r in PreprocessorModel(st).transform(df).collect()]
    frozen = [r[0] for r in PreprocessorModel(st, fit_mode=True).transform(df).collect()]
    assert per_frame[-1] == "b" and frozen[-1] == "q"


CONSTANT = [(0.1, 1.0, 5.0, None, 1), (0.1, 2.0, 5.0, None, 1), (0.1, 4.0, 5.0, None, 1), (None, 3.0, 6.0, 1.0, 1)]


def test_correlation_with_constant_columns_is_null(spark):
    """Constant, constant where both sides are present, all NULL: NULL at every site, no error."""
    from riskloom.operators import correlation as CR
    df = spark.createDataFrame(CONSTANT, "a double, b double, c double, d double, default int")
    got = {(r["feature_1"], r["feature_2"]): r["corr"] for r in CR.correlation_pairs(df, ["a", "b", "c", "d"]).collect()}
    assert all(v is None for k, v in got.items() if k != ("b", "c"))
    assert abs(got["b", "c"] - 0.2581988897471611) < 1e-12
    grouped = CR.correlation_pairs(df.withColumn("g", F.lit("x")), ["a", "b", "c"], ["g"]).collect()
    assert sum(r["corr"] is not None for r in grouped) == 1
    assert CR.target_correlations(df, ["a", "b", "c"]).count() == 0  # one class
    assert MX.sanity_check(df, "b", "default").first()["corr"] is None
    assert TG.target_diagnostics(df, "b").first()["corr_default"] is None


def test_zero_revenue_after_zero_takes_the_fill(spark):
    from riskloom.operators.ratios import calculate_ratios
    from riskloom.sources.fixtures import financial_raw
    raw = financial_raw(spark, "/root/testdata/sf0.001")
    key = raw.groupBy("ticker").count().filter("count >= 3").orderBy("ticker").first()["ticker"]
    zero = raw.filter(F.col("ticker") == key).withColumn("revenue", F.lit(0.0))
    got = [r["revenue_growth"] for r in calculate_ratios(zero).collect()]
    assert len(got) >= 3 and all(abs(x - 0.10) < 1e-12 for x in got)


def test_lookup_takes_the_last_row_and_asks_for_the_order(spark):
    from riskloom.operators.features import industry_risk_lookup
    df = spark.createDataFrame([(10,), (46,)], "industry_code int")
    risk = spark.createDataFrame([(10, 9, 1), (10, 4, 2), (46, 6, 1), (46, 6, 2)], "vsic_code int, risk_score int, line int")
    with pytest.raises(ValueError):
        industry_risk_lookup(df, risk)
    got = {r["industry_code"]: r["industry_risk_score"] for r in industry_risk_lookup(df, risk, order="line").collect()}
    assert got == {10: 4, 46: 6}


def test_categorical_profile_keeps_columns_with_many_levels(spark):
    from riskloom.operators.profile import categorical_profile
    df = spark.createDataFrame([(f"v{k % 12}", "ab"[k % 2]) for k in range(48)], "many string, few string")
    got = sorted(tuple(r) for r in categorical_profile(df).filter("feature = 'few'").collect())
    assert got == [("few", 2, "a", 24), ("few", 2, "b", 24)]
    assert [tuple(r) for r in categorical_profile(df).filter("feature = 'many'").collect()] == [("many", 12, None, None)]
