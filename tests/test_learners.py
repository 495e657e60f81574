"""Invariants for learned operators (SURVEY §5 (3)): scores in [0, 1], bankrupt <= 0.30,
one row per input, save/load equality, meta-model PD in [0, 1]; search, trees and attributions
against plain versions."""

import math
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import learners as L
from riskloom.operators import search as G
from riskloom.operators import trees as T
from riskloom.plans import datasets as DS
from riskloom.sources.store import ModelStore, input_state


@pytest.fixture
def partitions_200(spark):
    """Spark's default number of shuffle partitions, as a user's session has it."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_module_s4_invariants_and_roundtrip(spark, sf_dir, tmp_path, partitions_200):
    tr, va, _ = DS.preprocessed(spark, sf_dir)
    mod = L.ScoreModule("S4").fit(tr, va, L.first_points())
    assert mod.state.strategy in ("A", "B", "ensemble")
    assert abs(mod.state.w_a + mod.state.w_b - 1.0) < 1e-9
    scored = mod.append_score(va, "S4")
    assert scored.count() == va.count()
    agg = scored.agg(F.min("S4"), F.max("S4"),
                     F.max(F.when(F.col("past_bankruptcy") == 1, F.col("S4"))).alias("bk")).first()
    assert 0.0 <= agg[0] <= agg[1] <= 1.0
    assert agg["bk"] is None or agg["bk"] <= 0.30 + 1e-12
    imp = mod.feature_importance()
    assert len(imp) == len(mod.state.columns) and imp[0][1] >= imp[-1][1] and abs(sum(v for _, v in imp) - 1) < 1e-9
    mod.save(str(tmp_path / "s4"))
    again = L.ScoreModule.load(spark, str(tmp_path / "s4"))
    assert again.state == mod.state
    a = mod.predict_score(va)
    b = again.predict_score(va).select("sample_id", F.col("S4").alias("b"))
    assert a.join(b, "sample_id").agg(F.max(F.abs(F.col("S4") - F.col("b"))), F.count("*")).first() == (0.0, va.count())


def test_meta_model(spark, sf_dir, tmp_path, partitions_200):
    from riskloom.plans.catalog_meta import split_scores
    sc = split_scores(spark, sf_dir)
    mm = L.MetaModel().fit(sc["tr"], sc["va"], grids=L.first_meta_points())
    pd_ = mm.predict_proba(sc["te"])
    lo, hi, n = pd_.agg(F.min("pd_score"), F.max("pd_score"), F.count(F.lit(1))).first()
    assert 0.0 <= lo <= hi <= 1.0 and n == sc["te"].count()
    assert 0.0 <= mm.state.threshold <= 1.0
    coefs = mm.lr_coefficients()
    assert len(coefs) == 8 and coefs[0][1] >= coefs[-1][1]
    attr = mm.linear_attribution(sc["va"]).collect()
    assert len(attr) == 8 and all(r["mean_abs_contribution"] >= 0 for r in attr)
    mm.save(str(tmp_path / "meta"))
    again = L.MetaModel.load(spark, str(tmp_path / "meta"))
    assert [r["pd_score"] for r in again.predict_proba(sc["va"]).orderBy("sample_id").collect()] == [r["pd_score"] for r in mm.predict_proba(sc["va"]).orderBy("sample_id").collect()]
    # attributions add up to the log odds, for either model
    background = L.background_rows(sc["tr"], 16)
    for strategy in "AB":
        mm.state.strategy = strategy
        rows = mm.contributions(sc["va"], background).join(mm._both(sc["va"]), "sample_id").collect()
        for r in rows:
            p = r["_pa"] if strategy == "A" else r["_pb"]
            assert math.isclose(r["base"] + sum(r["phi"].values()), math.log(p / (1 - p)), rel_tol=1e-6, abs_tol=1e-6)
    mm.state.strategy, mm.state.w_a, mm.state.w_b = "ensemble", 0.5, 0.5
    assert mm.explained == "A"  # of equal weights the first
    assert len(mm.tree_attribution(sc["va"], background).collect()) == 8
    with pytest.raises(ValueError):
        mm.contributions(sc["va"], sc["tr"].crossJoin(spark.range(400)).drop("id").limit(L.MAX_BACKGROUND + 1))


# ------------------------------------------------------------------ trees


def test_boosted_first_split_is_the_best():
    rng = np.random.default_rng(0)
    x, y = np.round(rng.normal(size=(80, 4)), 1), rng.normal(size=80)
    f = T.boost(x, y, trees=1, depth=1, rate=1.0, l2=2.0, least=5, bins=128)
    g = y - y.mean()

    def gain(c, b):
        left = x[:, c] <= b
        if min(left.sum(), (~left).sum()) < 5:
            return 0
        return sum(g[s].sum() ** 2 / (s.sum() + 2) for s in (left, ~left)) - g.sum() ** 2 / 82

    best = max(gain(c, b) for c in range(4) for b in np.unique(x[:, c]))
    assert gain(f.feature[0], f.bound[0]) == pytest.approx(best) and f.gain[0] == pytest.approx(best)
    left = x[:, f.feature[0]] <= f.bound[0]
    assert f.predict(x[left][:1])[0] == pytest.approx(y.mean() + g[left].sum() / (left.sum() + 2))


def test_longer_training_holds_the_shorter_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    x[::11, 2] = np.nan
    x = T.filled(x)
    y = x[:, 0] * 2 + (x[:, 1] > 0) + np.where(np.isinf(x[:, 2]), 3.0, 0.0)
    for long, short in ((T.boost(x, y, trees=60, depth=4, subsample=0.8), T.boost(x, y, trees=20, depth=4, subsample=0.8)), (T.bag(x, y, trees=12), T.bag(x, y, trees=5))):
        n = len(short.roots)
        assert np.array_equal(long.predict(x, n), short.predict(x)) and np.array_equal(long.first(n).predict(x), short.predict(x))
    f = T.boost(x, y, trees=150, depth=4)
    assert np.corrcoef(f.predict(x), y)[0, 1] > 0.99
    p = T.boost(x[:, :2], (x[:, 0] > 0).astype(float), trees=40, depth=2, logistic=True).predict(x[:, :2])
    assert ((p > 0) == (x[:, 0] > 0)).mean() > 0.98
    assert len(T.boost(x[:0], y[:0]).roots) == 0 and T.boost(x, np.ones(300), trees=3).predict(x).tolist() == [1.0] * 300


def test_shapley_values_are_those_of_all_coalitions():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(200, 4)), 1)
    f = T.boost(x, x[:, 0] * x[:, 1] + np.abs(x[:, 2]), trees=15, depth=3)
    rows, back = x[:5], x[50:57]
    got = T.shapley(f, rows, back)
    for r, phi in zip(rows, got):
        def value(s):
            mixed = back.copy()
            mixed[:, list(s)] = r[list(s)]
            return f.predict(mixed).mean()
        for i in range(4):
            rest = [c for c in range(4) if c != i]
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (value((*s, i)) - value(s)) for n in range(4) for s in combinations(rest, n))
            assert phi[i] == pytest.approx(want, abs=1e-9)
        assert phi.sum() == pytest.approx(f.predict(r[None])[0] - f.predict(back).mean())


def test_logistic_is_stationary():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.logistic(size=400) > 0).astype(float)
    w = rng.uniform(0.5, 2, 400)
    b = T.logistic(x, y, w, c=0.5)
    p = 1 / (1 + np.exp(-(x @ b[:3] + b[3])))
    assert np.allclose(x.T @ (w * (p - y)) + b[:3] / 0.5, 0, atol=1e-6) and abs((w * (p - y)).sum()) < 1e-6


# ------------------------------------------------------------------ search


def test_scores_of_points_and_folds_match_sql(spark, sf_dir):
    tr = DS.preprocessed(spark, sf_dir)[0]
    samples, _, _ = L.module_samples(tr, ("S2", "S3"))
    small = {m: tuple(G.Estimator(e.kind, tuple((k, v[:2] if k == "trees" else v[:1]) for k, v in e.grid)) for e in G.GRIDS[m]) for m in samples}
    estimators = {(m, s): e for m in samples for s, e in zip("AB", small[m])}
    predictions = G.out_of_fold(spark, samples, estimators).cache()
    n = tr.count()
    assert predictions.count() == n * 2 * 4 and sorted(np.unique(samples["S2"].fold)) == [0, 1, 2, 3, 4]
    frame = predictions.toArrow()  # noqa: F841 - read by the SQL
    want = duckdb.sql("""SELECT p.module, p.model, p.point, p.fold, 1 - sum((label - prediction) ** 2) / sum((label - m) ** 2) FROM frame p
        JOIN (SELECT module, model, point, fold, avg(label) AS m FROM frame GROUP BY ALL) USING (module, model, point, fold) GROUP BY ALL""").fetchall()
    got = {tuple(r)[:4]: r["score"] for r in G.r2_by_fold(predictions).collect()}
    assert len(got) == 40 and all(got[tuple(w[:4])] == pytest.approx(w[4], abs=1e-9) for w in want)
    best = G.best_points(G.r2_by_fold(predictions))
    for (m, s), (point, mean) in best.items():
        means = {k: np.mean([v for (a, b, c, _), v in got.items() if (a, b, c) == (m, s, k)]) for k in (0, 1)}
        assert mean == pytest.approx(max(means.values())) and means[point] == pytest.approx(max(means.values()))
    # a point's two tree counts come from one training: the shorter one is what it gives alone
    alone = G.out_of_fold(spark, samples, {("S2", "A"): small["S2"][0].only(small["S2"][0].points()[0])}).orderBy("row").collect()
    assert [r["prediction"] for r in alone] == [r["prediction"] for r in predictions.filter("module = 'S2' and model = 'A' and point = 0").orderBy("row").collect()]


def test_auc_of_points_and_folds_matches_sql(spark, sf_dir):
    from riskloom.operators.meta import engineer_features, fit_standard_scaler
    from riskloom.plans.catalog_meta import split_scores
    train = split_scores(spark, sf_dir)["tr"]
    mm = L.MetaModel()
    sample = mm.sample(train, fit_standard_scaler(engineer_features(train)))
    per_class = [np.bincount(sample.fold[sample.y == c], minlength=5) for c in (0, 1)]
    assert all(c.max() - c.min() <= 1 for c in per_class)  # stratified
    grids = (G.META_GRIDS[0], G.Estimator(G.META_GRIDS[1].kind, tuple((k, v[:2] if k == "trees" else v[:1]) for k, v in G.META_GRIDS[1].grid)))
    predictions, scores = mm.grid_search(sample, spark, grids)
    frame = predictions.toArrow()  # noqa: F841 - read by the SQL
    want = duckdb.sql("""SELECT a.model, a.point, a.fold, avg(CASE WHEN a.prediction > b.prediction THEN 1.0 WHEN a.prediction = b.prediction THEN 0.5 ELSE 0 END)
        FROM frame a JOIN frame b USING (model, point, fold) WHERE a.label = 1 AND b.label = 0 GROUP BY ALL""").fetchall()
    got = {(r["model"], r["point"], r["fold"]): r["score"] for r in scores.collect()}
    assert len(got) == (4 + 2) * 5 and len(want) > 0 and all(got[w[:3]] == pytest.approx(w[3]) for w in want)
    one_class = spark.createDataFrame([("meta", "A", 0, 0, 1, 1.0, 0.3)], G.PREDICTIONS)
    assert G.auc_by_fold(one_class).first()["score"] == 0.5


def test_full_grids_are_the_default():
    assert [len(e.points()) for m in ("S1", "S2", "S3", "S4") for e in G.GRIDS[m]] == [24, 16, 24, 12, 12, 16, 16, 16]
    assert [len(e.points()) for e in G.META_GRIDS] == [4, 12]
    assert all(len(e.points()) == 1 for pair in L.first_points().values() for e in pair)


def test_sample_is_bounded_and_the_same_again(spark):
    df = spark.range(5000).select(F.col("id").alias("sample_id"), (F.col("id") % 7).cast("double").alias("a"), F.lit(None).cast("double").alias("b"),
                                  (F.col("id") % 2).alias("y"), (F.col("id") % 5).alias("fold"))
    a, b = (G.sample(df.repartition(k), ["sample_id"], ["a", "b"], "y", "fold", max_rows=500) for k in (3, 7))
    assert 400 < len(a.y) < 600 and np.array_equal(a.x, b.x) and np.isinf(a.x[:, 1]).all()
    assert len(G.sample(df, ["sample_id"], ["a"], "y", "fold", max_rows=5000).y) == 5000


# ------------------------------------------------------------------ store


def test_store_finds_models_by_input_and_parameters(spark, tmp_path):
    data, fitted = str(tmp_path / "in"), []
    spark.range(10).write.parquet(data)

    def get(**params):
        store = ModelStore(spark, str(tmp_path / "store"))  # as another process would
        key = store.key([data], **params)
        return store.get(key, lambda p: spark.read.parquet(p).count(), lambda: fitted.append(1) or 10, lambda m, p: spark.range(m).write.parquet(p))

    assert get(depth=3) == 10 and len(fitted) == 1
    assert get(depth=3) == 10 and len(fitted) == 1
    assert get(depth=4) == 10 and len(fitted) == 2
    spark.range(3).write.mode("append").parquet(data)
    assert get(depth=3) == 10 and len(fitted) == 3
    assert len(input_state(spark, [data])) > 1
    # without its manifest a model is not there
    store = ModelStore(spark, str(tmp_path / "store"))
    key = store.key([data], depth=3)
    (tmp_path / "store" / key / "manifest.json").unlink()
    assert store.find(key) is None


def test_second_process_loads_the_pipeline(spark, sf_dir, tmp_path):
    from riskloom.plans.pipeline import CreditScoringPipeline
    sp = DS.splits(spark, sf_dir)
    train, val = (sp.filter(F.col("split") == s) for s in ("train", "val"))
    store = ModelStore(spark, str(tmp_path / "store"))
    key = store.key(DS.input_paths(sf_dir), modules="S2")
    pipe = store.get(key, None, lambda: CreditScoringPipeline(L.first_points()).fit(train, val, modules=("S2",)), lambda m, p: m.save(p))
    again = ModelStore(spark, str(tmp_path / "store")).get(key, lambda p: CreditScoringPipeline.load(spark, p, ("S2",)), None, None)
    ids = ["sample_id", "clone_ord"]
    diff = pipe.predict_scores(val).join(again.predict_scores(val).withColumnRenamed("S2", "b"), ids).agg(F.max(F.abs(F.col("S2") - F.col("b"))), F.count("*")).first()
    assert tuple(diff) == (0.0, val.count())


def test_train_is_made_distinct_once(spark, sf_dir, monkeypatch):
    """The pipeline's preprocessor is fitted on the distinct rows that the modules learn from, with the state that the raw rows give."""
    from riskloom.operators import clean as CL
    from riskloom.plans import datasets as DS
    from riskloom.plans import pipeline as P

    calls, distinct_rows = [], P.distinct_rows
    for module in (CL, P):
        monkeypatch.setattr(module, "distinct_rows", lambda df: calls.append(1) or distinct_rows(df))
    monkeypatch.setattr(P, "fit_modules", lambda *a: {})
    sp = DS.splits(spark, sf_dir)
    train, val = (sp.filter(F.col("split") == k) for k in ("train", "val"))
    fitted = P.CreditScoringPipeline().fit(train.unionByName(train.limit(3)), val)
    assert len(calls) == 1
    found, plain = fitted.preprocessor.state, CL.Preprocessor().fit(train).state
    assert found.debt_corr == pytest.approx(plain.debt_corr, abs=1e-12)  # sums in another order
    plain.debt_corr = found.debt_corr
    assert found == plain


def test_a_query_prepares_the_splits_it_uses(spark, sf_dir, monkeypatch):
    """C11 takes train and val: no other split is prepared for it."""
    from riskloom.plans import catalog_meta as CM

    monkeypatch.setattr(DS, "_MEMO", {k: v for k, v in DS._MEMO.items() if not k[2].startswith(("preprocessed", "split_targets", "proxy_scores", "train_ranges"))})
    CM.q_c11(spark, sf_dir)
    made = {k[2] for k in DS._MEMO}
    assert {"preprocessed/train", "preprocessed/val"} <= made and "preprocessed/test" not in made


def test_places_in_trees_are_those_of_a_plain_walk():
    from riskloom.operators import trees as T

    rnd = np.random.default_rng(3)
    x = T.filled(np.where(rnd.random((1500, 6)) < 0.1, np.nan, rnd.normal(size=(1500, 6))))
    y = np.minimum(x[:, 0], 3) + rnd.normal(size=1500)
    for f in (T.boost(x, y, trees=7, depth=4), T.bag(x, y, trees=5), T.boost(x[:, :0], y, trees=2)):
        width = 0 if (f.feature < 0).all() else 6
        places = f.leaves(x[:, :width], len(f.roots))
        for i in range(0, 1500, 97):
            for k, node in enumerate(f.roots.tolist()):
                while f.feature[node] >= 0:
                    node = int(f.left[node]) + int(x[i, f.feature[node]] > f.bound[node])
                assert places[i, k] == node
    assert T.BLOCK * 100 * 8 < 1 << 19  # places of 100 trees fit a core's cache


# ------------------------------------------------------------------ all rows


def test_modules_and_meta_model_learn_from_all_rows(spark):
    """More rows than the 20,000 that training was once cut to: all are learned from."""
    from riskloom.operators.meta import engineer_features, fit_standard_scaler
    from riskloom.operators.targets import MODULE_SPECS

    n = 21_000
    one = (F.col("id") % 977) / 977
    ids = spark.range(n, numPartitions=3).select(F.col("id").alias("sample_id"), (F.col("id") % 9 == 0).cast("int").alias("default"), one.alias("u"))
    train = ids.select("sample_id", "default", *((F.col("u") * (k + 1)).alias(c) for k, c in enumerate(MODULE_SPECS["S2"].features)))
    learned, columns, _ = L.module_samples(train, ("S2",))
    s = learned["S2"]
    assert s.x.shape == (n, len(columns["S2"])) and np.bincount(s.fold).tolist() == [n // 5] * 5
    scores = ids.select("sample_id", "default", *(F.pow("u", F.lit(k)).alias(f"S{k}") for k in (1, 2, 3, 4)))
    assert len(L.MetaModel().sample(scores, fit_standard_scaler(engineer_features(scores))).y) == n


def test_background_of_any_size_is_counted_whole(spark):
    """Mean |Shapley value| over all background rows, not a few of them; the same as row by row."""
    rng = np.random.default_rng(5)
    feats = L.FEATURE_COLS
    scores = spark.createDataFrame([(i, int(i % 7 == 0), *map(float, np.round(v, 2))) for i, v in enumerate(rng.random((700, 4)))], "sample_id long, default int, S1 double, S2 double, S3 double, S4 double")
    few = scores.filter("sample_id < 40")
    mm = L.MetaModel()
    mm.state = L.MetaState({c: (0.4, 0.3) for c in feats}, "B", 0.0, 1.0, None, None, 0.5, 1.0, [])

    def inputs(df):
        table = mm._features(df).select(*feats).toArrow()
        return np.column_stack([table.column(c).to_numpy() for c in feats])

    x = inputs(scores)
    mm.gbt = T.boost(x, (x[:, 0] * x[:, 1] > x[:, 2]).astype(float), trees=12, depth=4, logistic=True)
    got = {r["feature"]: r["mean_abs_shap"] for r in mm.tree_attribution(few, scores).collect()}
    want = np.abs(T.shapley(mm.gbt, inputs(few), x)).mean(0)
    assert [got[c] for c in feats] == pytest.approx(want.tolist(), abs=1e-12) and max(want) > 0
    leaves = T.paths(mm.gbt)
    counts = L.counted(mm._features(scores.repartition(5)).select(*feats), leaves)
    assert counts.tolist() == T.pattern_counts(leaves, x).tolist()
    with pytest.raises(ValueError):
        mm.tree_attribution(few, scores.filter("false"))


def test_trees_grown_by_pieces_are_those_grown_at_once(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 5))
    x[::9, 1] = np.inf
    y = np.minimum(x[:, 0] * x[:, 2], 2) + rng.normal(size=3000)
    whole = T.bag(x, y, trees=4)
    monkeypatch.setattr(T, "CELLS", 5 * T.BINS * 3)  # three open nodes at a time
    pieces = T.bag(x, y, trees=4)
    for name in ("feature", "bound", "left", "value", "gain", "roots"):
        assert np.array_equal(getattr(whole, name), getattr(pieces, name))
    # a shallow bagged tree is the top of a deep one, and trees grown apart are the same trees
    assert np.array_equal(whole.predict(x, depth=5), T.bag(x, y, trees=4, depth=5).predict(x))
    assert np.array_equal(T.bag(x, y, trees=4, skip=3).predict(x), whole.part(3, 4).predict(x))


def test_bagged_depths_share_a_training():
    assert [len(G.GRIDS["S2"][k].trainings()) for k in (0, 1)] == [12, 2]
    assert sorted((p, t, d) for _, points in G.GRIDS["S2"][1].trainings() for p, t, d in points) == [(k, v["trees"], v["depth"]) for k, v in enumerate(G.GRIDS["S2"][1].points())]
    assert all(params["depth"] is None for params, _ in G.GRIDS["S2"][1].trainings())


def test_models_are_written_and_read_in_pieces(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3))
    s = G.Sample(x, x[:, 0] + rng.normal(size=400), np.arange(400) % 5)
    estimators = {("m", "A"): G.Estimator.of("boost", depth=(3,), trees=(4,)), ("m", "B"): G.Estimator.of("bag", depth=(None,), least=(5.0,), trees=(12,)),
                  ("none", "A"): G.Estimator.of("boost", depth=(3,), trees=(4,))}
    monkeypatch.setattr(G, "PIECE", 300)
    monkeypatch.setattr(G, "PART_TREES", 5)
    got = G.forests(G.refit(spark, {"m": s, "none": G.Sample(x[:0], s.y[:0], s.fold[:0])}, estimators))
    want = {("m", "A"): T.boost(x, s.y, depth=3, trees=4), ("m", "B"): T.bag(x, s.y, trees=12), ("none", "A"): T.boost(x[:0], s.y[:0])}
    G.write_forests(spark, got, str(tmp_path / "models"))
    for found in (got, G.forests(spark.read.schema(G.FITTED).parquet(str(tmp_path / "models")))):
        assert found.keys() == want.keys()
        for key, f in want.items():
            assert np.array_equal(found[key].predict(x), f.predict(x)) and np.array_equal(found[key].importance(3), f.importance(3))


def test_auc_of_many_scores_is_that_of_one_window(spark, monkeypatch):
    from riskloom.operators import rank

    rng = np.random.default_rng(8)
    rows = [("meta", "A", p, f, i, float(rng.random() < 0.3), round(float(rng.random()), 2)) for p in (0, 1) for f in (0, 1) for i in range(150)]
    monkeypatch.setattr(rank, "BUCKET_ROWS", 20)
    for r in G.auc_by_fold(spark.createDataFrame(rows, G.PREDICTIONS)).collect():
        mine = [(y, s) for _, _, p, f, _, y, s in rows if (p, f) == (r["point"], r["fold"])]
        pairs = [(a > b) + 0.5 * (a == b) for ya, a in mine for yb, b in mine if ya and not yb]
        assert r["score"] == pytest.approx(np.mean(pairs)) and r["n"] == 150


def test_large_forests_are_broadcast_to_be_scored(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 2))
    f, g = T.bag(x, x[:, 0], trees=3), T.boost(x, x[:, 1], trees=3)
    df = spark.createDataFrame(x.tolist(), "a double, b double")
    monkeypatch.setattr(L, "SHARED_NODES", len(g.feature))
    got = [r["p"] for r in df.select("a", "b", L.forest_column([F.col("a"), F.col("b")], [(0.25, f), (0.75, g)]).alias("p")).collect()]
    assert f.__dict__["_broadcasts"] and "_broadcasts" not in g.__dict__
    assert got == pytest.approx((0.25 * f.predict(x) + 0.75 * g.predict(x)).tolist(), abs=1e-15)
