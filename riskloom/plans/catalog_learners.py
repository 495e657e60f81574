"""Learned operators.

Learned models have no SQL oracle: the driver records a rows-only check. Invariants
(scores in [0, 1], bankrupt <= 0.30, one row per input, save/load equality) are
asserted in tests/test_learners.py. Fitted models are kept in a store, keyed by the input files and the
parameters; a query fits only what it reports.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import learners as L
from ..operators import search as G
from ..operators.meta import FEATURE_COLS, engineer_features, fit_standard_scaler, risk_grade
from ..operators.sampling import CLONE_COL
from ..session import shared_path
from ..sources.contract import ID_COL
from ..sources.store import ModelStore
from . import datasets as DS
from .catalog_meta import SCORES, split_scores
from .oracle_views import rnd, with_views
from .pipeline import CreditScoringPipeline, collect_scores, recheck_meta, train_meta, validate_meta
from .registry import register

SPLIT_NAMES = ("train", "val", "test")


def _parts(spark, sf_dir):
    sp = DS.splits(spark, sf_dir)
    return {k: sp.filter(F.col("split") == k) for k in SPLIT_NAMES}


def _params(**more):
    return {"grids": str(QUERY_GRIDS), "meta": str(G.META_GRIDS), "folds": G.FOLDS, "seed": G.SEED, **more}


#: The modules' grids of the queries that only use the models; ``K5_grid_search_*`` search the whole ones.
QUERY_GRIDS = L.first_points()


def pipeline(spark, sf_dir) -> CreditScoringPipeline:
    """The fitted pipeline: from the store, else fitted over QUERY_GRIDS and stored."""
    def build():
        store, parts = ModelStore(spark), _parts(spark, sf_dir)
        return store.get(store.key(DS.input_paths(sf_dir), **_params(model="pipeline")), lambda p: CreditScoringPipeline.load(spark, p),
                         lambda: CreditScoringPipeline(QUERY_GRIDS).fit(parts["train"], parts["val"]), lambda model, p: model.save(p))
    return DS._memo(spark, sf_dir, "pipeline", build)


def scores(spark, sf_dir) -> tuple[dict, object]:
    """(model scores of each split, their summary)."""
    def build():
        return collect_scores(pipeline(spark, sf_dir), _parts(spark, sf_dir))
    return DS._memo(spark, sf_dir, "model_scores", build)


def meta(spark, sf_dir) -> L.MetaModel:
    def build():
        store = ModelStore(spark)
        return store.get(store.key(DS.input_paths(sf_dir), **_params(model="meta")), lambda p: L.MetaModel.load(spark, p),
                         lambda: train_meta(scores(spark, sf_dir)[0])[0], lambda model, p: model.save(p))
    return DS._memo(spark, sf_dir, "meta", build)


def _named(spark, rows: list, estimators: dict):
    """Point numbers with their parameters as JSON, to be joined (one row a grid point)."""
    points = [(m, side, k, json.dumps(p, sort_keys=True)) for (m, side), est in estimators.items() for k, p in enumerate(est.points())]
    return rows.join(F.broadcast(spark.createDataFrame(points, "module string, model string, point int, params string")), ["module", "model", "point"])


def _module_grid(spark, sf_dir, module):
    def build():
        samples, _, _ = L.module_samples(DS.preprocessed_split(spark, sf_dir, "train"), (module,))
        return L.module_grid_search(spark, samples, G.GRIDS)
    found = DS._memo(spark, sf_dir, f"module_grid/{module}", build)
    return _named(spark, found, {(module, s): e for s, e in zip("AB", G.GRIDS[module])}).withColumnRenamed("score", "r2")


@register("K5_grid_search_S1")
def q_k5_s1(spark, sf_dir):
    """K5/K1: R² of every grid point of module 1's models on each of the five contiguous folds."""
    return _module_grid(spark, sf_dir, "S1")


@register("K5_grid_search_S2")
def q_k5_s2(spark, sf_dir):
    """K5/K2: R² of every grid point of module 2's models on each of the five contiguous folds."""
    return _module_grid(spark, sf_dir, "S2")


@register("K5_grid_search_S3")
def q_k5_s3(spark, sf_dir):
    """K5/K3: R² of every grid point of module 3's models on each of the five contiguous folds."""
    return _module_grid(spark, sf_dir, "S3")


@register("K5_grid_search_S4")
def q_k5_s4(spark, sf_dir):
    """K5/K4: R² of every grid point of module 4's models on each of the five contiguous folds."""
    return _module_grid(spark, sf_dir, "S4")


@register("L6_L7_grid_search")
def q_l6(spark, sf_dir):
    """AUC of every grid point of both meta-models on each of the five stratified folds (scores of the proxies)."""
    def build():
        train = split_scores(spark, sf_dir)["tr"]
        mm = L.MetaModel()
        return mm.grid_search(mm.sample(train, fit_standard_scaler(engineer_features(train))), spark, G.META_GRIDS)[1]
    found = DS._memo(spark, sf_dir, "meta_grid", build)
    return _named(spark, found, {("meta", s): e for s, e in zip("AB", G.META_GRIDS)}).withColumnRenamed("score", "auc")


@register("K7_module_fit_summary")
def q_k7(spark, sf_dir):
    """K5-K7: per module the chosen points, their cross-validated R², validation R²/MAE and the strategy with its weights."""
    rows = [(m, s.strategy, float(s.w_a), float(s.w_b), s.r2_a, s.r2_b, s.mae_a, s.mae_b, s.cv_a, s.cv_b, json.dumps(s.point_a, sort_keys=True), json.dumps(s.point_b, sort_keys=True))
            for m, s in ((m, mod.state) for m, mod in pipeline(spark, sf_dir).modules.items())]
    return spark.createDataFrame(rows, "module string, strategy string, w_a double, w_b double, r2_a double, r2_b double, "
                                       "mae_a double, mae_b double, cv_r2_a double, cv_r2_b double, point_a string, point_b string")


@register("M2_predict_scores_val")
def q_m2(spark, sf_dir):
    """M2/M3/K8/K9: S1..S4 of every val row from the trained modules (label kept)."""
    return pipeline(spark, sf_dir).predict_scores(_parts(spark, sf_dir)["val"], with_label=True)


@register("M4_score_collection_summary")
def q_m4(spark, sf_dir):
    """Per split summary of the model scores (NULL gate passed)."""
    return scores(spark, sf_dir)[1]


@register("K10_feature_importance")
def q_k10(spark, sf_dir):
    """Feature importances per module, descending (ensemble -> model A's)."""
    rows = [(m, i + 1, f, float(v)) for m, mod in pipeline(spark, sf_dir).modules.items()
            for i, (f, v) in enumerate(mod.feature_importance())]
    return spark.createDataFrame(rows, "module string, rank int, feature string, importance double")


@register("K11b_module_validate")
def q_k11b(spark, sf_dir):
    """R^2 / MAE of each trained module's scores against its val target."""
    va = DS.preprocessed_split(spark, sf_dir, "val")
    rows = [(m, r["r2"], r["mae"]) for m, mod in pipeline(spark, sf_dir).modules.items() for r in [mod.validate(va)]]
    return spark.createDataFrame(rows, "module string, r2 double, mae double")


@register("L9_meta_fit_summary")
def q_l9(spark, sf_dir):
    """Chosen points, LR vs boosted-tree AUC (folds and val), strategy, weights, tuned threshold."""
    st = meta(spark, sf_dir).state
    return spark.createDataFrame([(st.strategy, st.w_a, st.w_b, st.auc_a, st.auc_b, st.threshold, st.pos_weight, st.cv_a, st.cv_b, json.dumps(st.point_a), json.dumps(st.point_b, sort_keys=True))],
                                 "strategy string, w_a double, w_b double, auc_lr double, auc_gbt double, "
                                 "threshold double, pos_weight double, cv_auc_lr double, cv_auc_gbt double, point_lr string, point_gbt string")


@register("L10_meta_pd_test")
def q_l10(spark, sf_dir):
    """PD, class at the tuned threshold and risk grade for every test row."""
    mm = meta(spark, sf_dir)
    return mm.predict_proba(scores(spark, sf_dir)[0]["test"]).select(ID_COL, CLONE_COL, "default", "pd_score",
                                                                     (F.col("pd_score") >= F.lit(mm.state.threshold)).cast("int").alias("predicted"),
                                                                     risk_grade("pd_score").alias("risk_grade"))


@register("L18b_meta_validate")
def q_l18b(spark, sf_dir):
    """Meta-model validation rows on val and test (auc, f1, ks, brier, threshold)."""
    return validate_meta(meta(spark, sf_dir), scores(spark, sf_dir)[0])


@register("L20_linear_attribution")
def q_l20(spark, sf_dir):
    """L20 (LR): mean |coef * (x - mean)| per meta feature on val."""
    return meta(spark, sf_dir).linear_attribution(scores(spark, sf_dir)[0]["val"])


@register("L20b_tree_attribution")
def q_l20b(spark, sf_dir):
    """Mean |interventional Shapley value| per feature of the explained model on val, over all rows of train as background."""
    sc = scores(spark, sf_dir)[0]
    return meta(spark, sf_dir).tree_attribution(sc["val"], sc["train"])


# Any fixed coefficients: they make the linear case checkable by SQL.
LINEAR_COEFS = [0.5, -1.25, 2.0, 0.75, -0.5, 1.5, -2.25, 0.25]


def _linear_sql():
    feats = ("SELECT S1, S2, S3, S4, least(S1, S2, S3, S4) AS min_score, S1 * S2 AS S1_x_S2, "
             "sqrt(((S1 - m) ** 2 + (S2 - m) ** 2 + (S3 - m) ** 2 + (S4 - m) ** 2) / 3) AS score_std, "
             "0.15 * S1 + 0.45 * S2 + 0.15 * S3 + 0.25 * S4 AS weighted_avg FROM (SELECT *, (S1 + S2 + S3 + S4) / 4 AS m FROM sc_va) z")
    return "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, {rnd(f'avg(abs({k} * ({c} - a)))')} AS mean_abs_contribution "
                                f"FROM (SELECT {c}, avg({c}) OVER () AS a FROM ({feats}) f) g" for c, k in zip(FEATURE_COLS, LINEAR_COEFS))


@register("L20c_linear_attribution_fixed", with_views(_linear_sql(), "dataset67", extra=SCORES))
def q_l20c(spark, sf_dir):
    """L20 (linear): mean |coef * (x - mean)| of fixed coefficients on the val split's proxy scores."""
    return L.linear_attribution(engineer_features(split_scores(spark, sf_dir)["va"]), LINEAR_COEFS)


@register("L21_lr_coefficients")
def q_l21(spark, sf_dir):
    """Logistic-regression coefficients per meta feature, descending."""
    coefs = meta(spark, sf_dir).lr_coefficients()
    return spark.createDataFrame([(i + 1, f, float(c)) for i, (f, c) in enumerate(coefs)],
                                 "rank int, feature string, coefficient double")


@register("A9_save_load_roundtrip")
def q_a9(spark, sf_dir):
    """Save pipeline + meta-model, reload, re-score val by its ids; max |diff| must be 0."""
    pipe, mm = pipeline(spark, sf_dir), meta(spark, sf_dir)
    base = shared_path(spark, "models")
    pipe.save(f"{base}/pipeline")
    mm.save(f"{base}/meta")
    again = CreditScoringPipeline.load(spark, f"{base}/pipeline")
    val, ids = _parts(spark, sf_dir)["val"], [ID_COL, CLONE_COL]
    diff = pipe.predict_scores(val).join(again.predict_scores(val).select(*ids, *[F.col(m).alias(f"b_{m}") for m in ("S1", "S2", "S3", "S4")]), ids)
    d = diff.agg(*[F.max(F.abs(F.col(m) - F.col(f"b_{m}"))).alias(f"max_diff_{m}") for m in ("S1", "S2", "S3", "S4")],
                 F.count(F.lit(1)).alias("rows"))
    checked = recheck_meta(spark, f"{base}/meta", scores(spark, sf_dir)[0])
    return d.crossJoin(checked.groupBy().agg(F.first("strategy").alias("meta_strategy"),
                                             F.max("auc").alias("meta_max_auc")))
