"""What must hold at any size: exact quantiles, ranks, duplicates and outliers without a task, a map or a
join that grows with a hot value; scoring as a projection; filters that reach the files."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import clean as CL
from riskloom.operators import duplicates as DU
from riskloom.operators import profile as P
from riskloom.operators import quantiles as Q
from riskloom.operators import rank as RK
from riskloom.operators import ratios as R
from riskloom.operators import sampling as S
from riskloom.plans import datasets as DS


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


# ------------------------------------------------------------------ quantiles


def frame(spark):
    rnd = np.random.default_rng(5)
    n = 6000
    a = np.where(rnd.random(n) < 0.5, 2.5, rnd.lognormal(3, 4, n))  # one value on half the rows
    b = rnd.normal(0, 1e-9, n)
    c = np.round(rnd.normal(0, 50, n))
    d = 1e6 + np.arange(n) * 2.0 ** -33  # neighbours in the last bits
    e = rnd.choice([-0.0, 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308], n)
    pdf = pd.DataFrame({"g": rnd.choice(["x", "y", "hot", "hot", None], n), "a": a, "b": b, "c": c, "d": d, "e": e})
    pdf.loc[::9, "a"] = None
    pdf.loc[pdf.g == "y", "b"] = None  # a group without values
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, a double, b double, c double, d double, e double").repartition(6)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_quantiles_equal_quantile_cont(spark, monkeypatch, broadcast):
    monkeypatch.setattr(Q, "BROADCAST_CELLS", broadcast)
    pdf, df = frame(spark)
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    cols = ["a", "b", "c", "d", "e"]
    got = {(r["g"], r["feature"]): (r["n"], r["q"]) for r in Q.exact_quantiles(df, {c: F.col(c) for c in cols}, probs, by=["g"]).collect()}
    for g in ("x", "y", "hot", None):
        part = pdf[pdf.g == g] if g else pdf[pdf.g.isna()]
        for c in cols:
            values = part[c].dropna().to_numpy()
            if not len(values):
                assert (g, c) not in got
                continue
            n, q = got[g, c]
            assert n == len(values)
            for p, have in zip(probs, q):
                pos = p * (len(values) - 1)
                s = np.sort(values)
                lo, hi = s[int(np.floor(pos))], s[int(np.ceil(pos))]
                assert have == pytest.approx(lo if lo == hi else lo + (hi - lo) * (pos - np.floor(pos)), rel=1e-12)
    assert Q.medians(df.filter("false"), {"a": F.col("a")}) == {"a": None}
    row = Q.quantile_row(df, {"a": F.col("a"), "z": F.lit(None)}, [0.5]).first()
    assert row["z"] is None and row["a"][0] == pytest.approx(float(pdf.a.median()))


def test_a_hot_value_is_one_entry(spark):
    """Half of the rows are equal and the rest distinct: no aggregate keeps the rows."""
    df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.lit(7.0)).otherwise(F.col("id").cast("double")).alias("x")).repartition(4)
    cells = df.groupBy(Q.first_cell(F.col("x")).alias("cell")).count()
    assert cells.count() < 600
    assert Q.medians(df, {"x": F.col("x")}) == {"x": float(np.median(np.where(np.arange(200_000) % 2 == 0, 7.0, np.arange(200_000))))}


def test_first_cell_never_falls(spark):
    rng = random.Random(1)
    xs = sorted([rng.choice([-1, 1]) * 2 ** rng.uniform(-1073, 1023) for _ in range(4000)] + [0.0, 5e-324, -5e-324, 1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0), float("inf"), float("-inf")])
    cells = [r[0] for r in spark.createDataFrame([(float(x),) for x in xs], "x double").coalesce(1).select(Q.first_cell(F.col("x"))).collect()]
    assert cells == sorted(cells)


def test_modes_ties_and_nulls(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None), ("b", None), ("a", None), ("c", None)], "s string, t string")
    assert Q.grouped_modes(df, ["s", "t"]) == {"s": "a", "t": None}


def test_no_percentile_is_left():
    import pathlib
    root = pathlib.Path(__file__).resolve().parents[1] / "riskloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            text = p.read_text()
            assert "F.percentile(" not in text and "F.median(" not in text and "F.mode(" not in text and "collect_set(" not in text, p


# ------------------------------------------------------------------ ranks


def test_a_value_on_a_third_of_the_rows_fills_no_task(spark):
    n = 60_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id").cast("double") % 1000).alias("v"),
                               F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("stratum"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = RK.sorted_parts(df, ["v"]).groupBy(F.shiftright("_id", 33)).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in parts]
    assert len(sizes) >= 8 and max(sizes) <= 2 * n / len(sizes)
    got = RK.position_by_value(df, "v", ["id"], ["stratum"]).collect()
    want = df.toPandas().sort_values(["stratum", "v", "id"])
    want["pos"] = want.groupby("stratum").cumcount()
    assert sorted((r["id"], r["pos"]) for r in got) == sorted(zip(want.id, want.pos))


def test_positions_with_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([(None, 1), (2.0, 1), (2.0, 2), (None, None), (1.0, None)], "v double, g int")
    got = sorted((str(r["g"]), str(r["v"]), r["pos"]) for r in RK.position_by_value(df, "v", [], ["g"]).collect())
    assert got == sorted([("None", "None", 0), ("None", "1.0", 1), ("1", "None", 0), ("1", "2.0", 1), ("2", "2.0", 0)])
    assert RK.position_by_value(df.filter("false"), "v").count() == 0
    assert [RK.buckets_for(n) for n in (0, 1, 50_000, 50_001, 10 ** 9)] == [1, 1, 1, 2, 20_000]
    assert [RK.digits_for(n) for n in (0, 50_000 * 16, 50_000 * 17)] == [1, 1, 2]


def test_contiguous_folds_of_few_rows(spark):
    got = sorted(tuple(r) for r in S.contiguous_folds(spark.range(7).withColumnRenamed("id", "sample_id"), "sample_id", k=5).collect())
    assert got == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 3), (6, 4)]


# ------------------------------------------------------------------ duplicates


def test_duplicates_are_null_safe_and_exact(spark, monkeypatch):
    rows = [(1, None, "a"), (None, 1, "a"), (1, None, "a"), (1, 1, None), (1, 1, None), (1, 1, None), (2, 2, ""), (2, 2, None)]
    df = spark.createDataFrame(rows, "x int, y int, `a b` string").repartition(3)
    for digest in (DU.row_digest, lambda cols: (F.lit(1).cast("long"), F.lit(2).cast("long"))):  # and if all digests collide
        monkeypatch.setattr(DU, "row_digest", digest)
        assert sorted(map(str, DU.distinct_rows(df).collect())) == sorted(map(str, df.distinct().collect()))
        assert DU.count_duplicates(df).first()["duplicates"] == 3
        assert DU.count_duplicates(df.filter("false")).first()["duplicates"] == 0
    assert DU.distinct_rows(df).columns == df.columns


def test_rows_without_a_twin_are_not_shuffled(spark, sf_dir):
    wide = DS.dataset67(spark, sf_dir)
    text = plan(DU.distinct_rows(wide).filter("sample_id > 0"))
    for line in text.split("\n"):  # whole rows go through an exchange only behind the join with repeated digests
        if "hashpartitioning" in line:
            assert "LeftSemi" in text
    alone, _ = DU._apart(wide)
    assert "hashpartitioning" not in plan(alone)


# ------------------------------------------------------------------ outliers


def sequential(pdf, cols, k):
    out = pdf
    for c in cols:
        m, s = out[c].mean(), out[c].std()
        out = out[(out[c] >= m - k * s) & (out[c] <= m + k * s)]
    return out


@pytest.mark.parametrize("heavy", [False, True])
def test_outliers_in_two_passes_equal_the_steps(spark, monkeypatch, heavy):
    rng = np.random.default_rng(4)
    n, cols = 4000, [f"c{k}" for k in range(6)]
    data = {c: rng.standard_cauchy(n) * 100 if heavy else rng.normal(3, 1, n) + np.where(rng.random(n) < 0.002, 30, 0) for c in cols}
    pdf = pd.DataFrame(data)
    pdf.loc[rng.random(n) < 0.01, "c2"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).reset_index(), "index long, " + ", ".join(f"{c} double" for c in cols)).repartition(3).cache()
    calls = []
    real = R.staged
    monkeypatch.setattr(R, "staged", lambda d, name="stage": calls.append(name) or real(d, name))
    got = sorted(r["index"] for r in R.remove_outliers(df, cols, k=4.0).collect())
    assert got == sorted(sequential(pdf, cols, 4.0).index) and 0 < len(got) < n
    assert heavy or len(calls) == 1  # one tail table: two scans
    assert R.remove_outliers(df.filter("false"), cols).count() == 0 == R.remove_outliers(df.limit(1), cols).count()


def test_fixture_outliers_take_few_scans(spark, sf_dir, monkeypatch):
    calls = []
    real = R.staged
    monkeypatch.setattr(R, "staged", lambda d, name="stage": calls.append(name) or real(d, name))
    assert R.remove_outliers(DS.financial_features(spark, sf_dir)).count() > 0
    assert len(calls) <= 4


# ------------------------------------------------------------------ histograms


def test_histogram_counts_like_numpy(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 900), "x": rng.normal(size=900), "y": np.where(rng.random(900) < 0.4, 1.0, rng.random(900)), "z": 4.0})
    pdf.loc[::5, "x"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, x double, y double, z double").repartition(4)
    monkeypatch.setattr(P, "HELD_GROUPS", 1)
    got = {(r["g"], r["feature"], r["bin"]): (r["count"], r["density"]) for r in P.histogram(df, ["x", "y", "z"], 10, ["g"], density=True).collect()}
    for g in ("a", "b", None):
        part = pdf[pdf.g == g] if g else pdf[pdf.g.isna()]
        for c in ("x", "y"):
            counts, edges = np.histogram(part[c].dropna(), 10)
            dens = np.histogram(part[c].dropna(), 10, density=True)[0]
            assert {b: got[g, c, b][0] for b in range(10) if (g, c, b) in got} == {b: k for b, k in enumerate(counts) if k}
            assert all(got[g, c, b][1] == pytest.approx(dens[b]) for b in range(10) if (g, c, b) in got)
        assert got[g, "z", 5] == (len(part), None)
    pooled = P.histogram(df, ["x"], 4, ["g"], bounds_by=[]).groupBy("bin").agg(F.sum("count")).collect()
    assert {r[0]: r[1] for r in pooled} == {b: k for b, k in enumerate(np.histogram(pdf.x.dropna(), 4)[0]) if k}
    assert P.histogram(df.filter("false"), ["x"], 4, ["g"]).count() == 0


# ------------------------------------------------------------------ scoring and files


def test_scoring_is_a_projection(spark, sf_dir):
    model = DS.fitted_preprocessor(spark, sf_dir)
    val = DS.splits(spark, sf_dir).filter(F.col("split") == "val")
    stats = model.statistics(val)
    text = plan(model.apply(val, stats))
    assert "Aggregate" not in text and "Join" not in text and "Exchange" not in text
    same = model.apply(val, stats).exceptAll(model.transform(val))
    assert same.count() == 0
    assert model.apply(val, model.train_statistics()).count() == val.count()


def test_recalculated_debt_takes_the_split_median(spark):
    state = CL.PreprocessorState(debt_strategy="recalc", debt_median=9.0, feature_names_out=[CL.DEBT_COL])
    df = spark.createDataFrame([(1, 120.0, 10.0, 3.0), (2, 240.0, 10.0, 3.0), (3, 360.0, 10.0, 3.0), (4, 5.0, 0.0, 3.0)],
                               "sample_id int, total_outstanding_debt double, avg_monthly_deposits double, debt_burden_ratio double")
    model = CL.PreprocessorModel(state)
    assert [r[CL.DEBT_COL] for r in model.transform(df).orderBy("sample_id").collect()] == [1.0, 2.0, 3.0, 2.0]
    assert [r[CL.DEBT_COL] for r in CL.PreprocessorModel(state, fit_mode=True).transform(df).orderBy("sample_id").collect()] == [1.0, 2.0, 3.0, 9.0]


def test_filters_reach_the_stage_files(spark, sf_dir):
    from riskloom.plans.catalog_extra import q_b7
    text = plan(q_b7(spark, sf_dir))
    assert "EqualTo(industry_code,46)" in text and "EqualTo(default,1)" in text
    read = next(line for line in text.split("\n") if line.startswith("ReadSchema"))
    assert read.count(":") <= 5  # the four columns of the query


def test_a_cluster_must_name_a_shared_folder():
    from riskloom.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_changed_input_is_computed_anew(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    monkeypatch.setattr(DS, "input_paths", lambda sf_dir: [path])
    spark.range(3).write.parquet(path)
    calls = []
    for _ in range(2):
        DS._memo(spark, "here", "x", lambda: calls.append(1))
    spark.range(2).write.mode("append").parquet(path)
    DS._memo(spark, "here", "x", lambda: calls.append(1))
    assert len(calls) == 2


def test_rejected_lines_are_listed(spark, tmp_path):
    from riskloom.sources.io import read_checked, read_splits_checked, split_report
    (tmp_path / "a.csv").write_text("sample_id,default,s\n1,0,None\n2,x,b\n3,1,\n4,1,c,extra\n5,7,d\n")
    (tmp_path / "empty.csv").write_text("sample_id,default,s\n")
    schema = spark.createDataFrame([], "sample_id long, default int, s string").schema
    rows, rejects = read_checked(spark, str(tmp_path / "a.csv"), "csv", schema)
    assert sorted((r["sample_id"], r["default"], r["s"]) for r in rows.collect()) == [(1, 0, None), (3, 1, None), (5, 7, "d")]
    assert sorted(r["line"] for r in rejects.collect()) == ["2,x,b", "4,1,c,extra"]
    rows, rejects = read_splits_checked(spark, {"train": str(tmp_path / "a.csv"), "val": str(tmp_path / "empty.csv")}, "csv", schema)
    report = {r["split"]: tuple(r)[1:4] for r in split_report(rows, rejects).collect()}
    assert report == {"train": (3, 2, 1)}


# ------------------------------------------------------------------ statements


def test_hundredths_are_the_decimal_cast(spark):
    from riskloom.sources.fixtures import DEC_MONEY, DEC_RATE, hundredths

    values = [0.0, -0.0, 0.07, 0.29, 0.575, 1.005, 1.115, 8.345, 9.994999999999999, -0.145, -3.07, 1234.565, 81235.675, 0.1 + 0.2, 1e-9, 99999.994999999, 104949.5, 999_999_999.99, 9_999_999_999.99, None]
    rates = [v if v is None or abs(v) < 99 else v % 90 for v in values]
    df = spark.createDataFrame(list(zip(values, rates)), "x double, r double")
    for r in df.select(hundredths(F.col("x"), DEC_MONEY).alias("a"), (F.col("x").cast(DEC_MONEY) * 100).cast("long").alias("b"),
                       hundredths(F.col("r"), DEC_RATE).alias("c"), (F.col("r").cast(DEC_RATE) * 100).cast("long").alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d)


def test_lines_meet_before_they_are_counted(spark, sf_dir):
    """Lines are dealt by order key in pieces that may be split, then added in two steps: no scan task holds an entry a line, no task a hot key."""
    from riskloom.sources.fixtures import financial_raw

    text = financial_raw(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    at = [text.index(x) for x in ("hashpartitioning(l_orderkey", "partial_sum(ext", "REBALANCE_PARTITIONS_BY_COL")]  # last step first
    assert at == sorted(at) and "decimal" not in text[at[0]:at[2]]


def test_orders_meet_by_customer_before_they_are_counted(spark, sf_dir, monkeypatch):
    """Orders are dealt by customer in as many pieces as they need, and only then summed: no join task holds a sum an order too."""
    from riskloom.sources import fixtures as FX

    whole = FX.financial_raw(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    monkeypatch.setattr(FX, "PIECE_ORDERS", -(-orders // 7))
    dealt = FX.financial_raw(spark, sf_dir)
    text = dealt._jdf.queryExecution().executedPlan().toString()
    assert text.index("partial_sum(cast(gross") < text.index("hashpartitioning(o_custkey") < text.index("hashpartitioning(l_orderkey")  # last step first
    assert "hashpartitioning(o_custkey#" in text and ", 7), REPARTITION_BY_NUM" in text
    assert sorted(map(str, dealt.collect())) == sorted(map(str, whole.collect()))
