"""Tier-1 module learners and the tier-2 meta-model.

xgboost / lightgbm / sklearn are not used: boosted and bagged trees are ``trees.py``, their grid search and
final training ``search.py`` (Spark tasks, each on all training rows), logistic regression is Spark ML's. Scores are row projections: the trees run in an Arrow function over
a batch's inputs.

The whole grids are the default; ``grids`` takes smaller ones (``first_points()``: the first point of each; then nothing is searched).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..session import staged
from ..sources.contract import ID_COL
from . import search as G
from . import trees as T
from .meta import FEATURE_COLS, engineer_features, fit_standard_scaler, standardize
from .metrics import binary_curve, curve_metrics, regression_metrics
from .sampling import CLONE_COL, contiguous_folds, stratified_folds
from .targets import MODULE_SPECS, ModuleSpec, apply_post_rule, fused_targets, scale_target, select_columns, target_raw

# The gaps above which one model alone is taken.
R2_GAP = 0.03
AUC_GAP = 0.02
#: Nodes of a forest beyond which it is broadcast to be scored.
SHARED_NODES = 1 << 16
#: Rows that stand for absent features when trees are explained row by row; more are refused (``tree_attribution`` takes any number).
MAX_BACKGROUND = 256


def first_points() -> dict:
    """The grids cut down to their first points, for quick runs."""
    return {m: tuple(e.first_point() for e in pair) for m, pair in G.GRIDS.items()}


def first_meta_points() -> tuple:
    return tuple(e.first_point() for e in G.META_GRIDS)


def decide_strategy(score_a: float, score_b: float, gap: float) -> tuple[str, float, float]:
    """|delta| > gap -> single winner (A on ties); else weights proportional to the
    scores (0.5/0.5 when their sum is <= 0)."""
    if abs(score_a - score_b) > gap:
        return ("A", 1.0, 0.0) if score_a >= score_b else ("B", 0.0, 1.0)
    total = score_a + score_b
    if total <= 0:
        return "ensemble", 0.5, 0.5
    return "ensemble", score_a / total, score_b / total


def _matrix(inputs: pa.Array, width: int) -> np.ndarray:
    return T.filled(inputs.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(inputs), width))


def forest_column(inputs: Sequence[Column], parts: Sequence[tuple[float, T.Forest]], classes: bool = False) -> Column:
    """Weighted sum of forests' predictions of a row's inputs (probabilities if ``classes``).

    Large forests are broadcast: a worker reads them once, not once a task."""
    width, sc = len(inputs), SparkSession.active().sparkContext
    parts = [(w, _shared(sc, f) if len(f.feature) > SHARED_NODES else f.walker()) for w, f in parts]

    @F.arrow_udf("double")
    def run(rows: pa.Array) -> pa.Array:
        x, out = _matrix(rows, width), 0.0
        for w, f in parts:
            f = f if isinstance(f, T.Walker) else f.value
            out = out + w * G.predict("boost_classes" if classes else "boost", f, x, len(f.roots))
        return pa.array(out, pa.float64())

    return run(F.array(*inputs))


def _shared(sc, forest: T.Forest):
    """The forest's broadcast in this application, made once."""
    known = forest.__dict__.setdefault("_broadcasts", {})
    if sc.applicationId not in known:
        known[sc.applicationId] = sc.broadcast(forest.walker())
    return known[sc.applicationId]


# ----------------------------------------------------------------------------- tier 1
@dataclass
class ModuleState:
    name: str
    columns: list
    target_lo: float
    target_hi: float
    strategy: str
    w_a: float
    w_b: float
    r2_a: float | None
    r2_b: float | None
    mae_a: float | None
    mae_b: float | None
    point_a: dict = field(default_factory=dict)
    point_b: dict = field(default_factory=dict)
    cv_a: float | None = None
    cv_b: float | None = None


class ScoreModule:
    """K7: select -> target -> scale -> search and fit A and B -> decide; K8/K9 scoring."""

    def __init__(self, name: str):
        self.name = name
        self.spec: ModuleSpec = MODULE_SPECS[name]
        self.state: ModuleState | None = None
        self.model_a: T.Forest | None = None
        self.model_b: T.Forest | None = None

    def fit(self, train: DataFrame, val: DataFrame, grids: Mapping | None = None) -> "ScoreModule":
        fitted = fit_modules(train, val, (self.name,), grids)[self.name]
        self.state, self.model_a, self.model_b = fitted.state, fitted.model_a, fitted.model_b
        return self

    def inputs(self, df: DataFrame) -> list[Column]:
        """The module's inputs; an absent column is 0.0."""
        return [F.col(f"`{c}`").cast("double") if c in df.columns else F.lit(0.0) for c in self.state.columns]

    def append_score(self, df: DataFrame, out: str | None = None) -> DataFrame:
        """K8/K9 as a column append: weighted or single prediction, clipped, post rule."""
        st = self.state
        parts = [(w, m) for w, m in ((st.w_a, self.model_a), (st.w_b, self.model_b)) if w]
        raw = forest_column(self.inputs(df), parts)
        return df.withColumn(out or self.name, apply_post_rule(clip(raw, 0.0, 1.0), df.columns, self.spec))

    def predict_score(self, df: DataFrame, out: str | None = None) -> DataFrame:
        """K8/K9: ids, label and one score column in [0, 1]."""
        out = out or self.name
        keep = [c for c in (ID_COL, CLONE_COL, "default") if c in df.columns]
        return self.append_score(df, out).select(*keep, out)

    def validate(self, val: DataFrame) -> dict:
        """R^2 / MAE of the final score vs the val target (4 dp)."""
        t = scale_target(target_raw(val, self.spec), self.state.target_lo, self.state.target_hi)
        p = self.append_score(t, "_score")
        r = regression_metrics(p.select(F.col("target").alias("t"), F.col("_score").alias("p")), "t", "p").first()
        return {"r2": round(r["r2"], 4) if r["r2"] is not None else None, "mae": round(r["mae"], 4)}

    def feature_importance(self) -> list[tuple[str, float]]:
        """Sorted importances; an ensemble reports model A's."""
        m = self.model_b if self.state.strategy == "B" else self.model_a
        return sorted(zip(self.state.columns, m.importance(len(self.state.columns)).tolist()), key=lambda kv: -kv[1])

    # A9 persistence
    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        G.write_forests(spark, {(self.name, "A"): self.model_a, (self.name, "B"): self.model_b}, f"{path}/models")
        _write_json(f"{path}/state", asdict(self.state))

    @classmethod
    def load(cls, spark, path: str) -> "ScoreModule":
        state = ModuleState(**_read_json(spark, f"{path}/state"))
        mod = cls(state.name)
        models = G.forests(spark.read.schema(G.FITTED).parquet(f"{path}/models"))
        mod.state, mod.model_a, mod.model_b = state, models[state.name, "A"], models[state.name, "B"]
        return mod


def module_samples(train: DataFrame, names: Sequence[str]) -> tuple[dict, dict, dict]:
    """(samples, columns, target ranges) by module: contiguous folds in the order of the ids, scaled targets."""
    keyed = contiguous_folds(train, ID_COL, G.FOLDS, out="_fold")
    with_targets = staged(fused_targets(keyed, {f"_t_{m}": MODULE_SPECS[m] for m in names}), "module_targets")
    ends = with_targets.agg(*(f(f"_t_{m}").alias(f"{k}{m}") for m in names for k, f in (("lo", F.min), ("hi", F.max)))).first()
    columns = {m: select_columns(MODULE_SPECS[m], train.columns) for m in names}
    ranges = {m: (ends[f"lo{m}"], ends[f"hi{m}"]) for m in names}
    rows = with_targets.withColumns({c: F.lit(0.0) for m in names for c in columns[m] if c not in train.columns})  # T10
    for m in names:
        rows = scale_target(rows, *ranges[m], col=f"_t_{m}", out=f"_y_{m}")
    return G.samples(rows, [ID_COL], {m: (columns[m], f"_y_{m}") for m in names}, "_fold"), columns, ranges


def module_grid_search(spark, samples: Mapping, grids: Mapping) -> DataFrame:
    """K5: module, model, point, fold, n, score (R² on the fold) of every point of the modules' grids."""
    estimators = {(m, side): est for m in samples for side, est in zip("AB", grids[m])}
    return staged(G.r2_by_fold(staged(G.out_of_fold(spark, samples, estimators), "out_of_fold")), "module_grid")


def fit_modules(train: DataFrame, val: DataFrame, names: Sequence[str] = tuple(G.GRIDS), grids: Mapping | None = None) -> dict[str, ScoreModule]:
    """K1-K7 for several modules in one search job, one training job and one validation pass."""
    spark, grids = train.sparkSession, grids or G.GRIDS
    samples, columns, ranges = module_samples(train, names)
    if all(len(e.points()) == 1 for m in names for e in grids[m]):  # nothing to choose
        points = {(m, side): (0, None) for m in names for side in "AB"}
    else:
        points = G.best_points(module_grid_search(spark, samples, grids))
    chosen = {(m, side): est.only(est.points()[points[m, side][0]]) for m in names for side, est in zip("AB", grids[m])}
    models = G.forests(staged(G.refit(spark, samples, chosen), "refit"))
    found = {m: ScoreModule(m) for m in names}
    t = fused_targets(val, {f"_t_{m}": MODULE_SPECS[m] for m in names})
    aggs = []
    for m, mod in found.items():
        mod.model_a, mod.model_b = models[m, "A"], models[m, "B"]
        mod.state = ModuleState(m, columns[m], *ranges[m], "A", 1.0, 0.0, None, None, None, None, chosen[m, "A"].points()[0], chosen[m, "B"].points()[0], points[m, "A"][1], points[m, "B"][1])
        t = scale_target(t, *ranges[m], col=f"_t_{m}", out=f"_y_{m}")
        for side, model in (("A", mod.model_a), ("B", mod.model_b)):
            t = t.withColumn(f"_p_{m}{side}", forest_column(mod.inputs(val), [(1.0, model)]))
            y, p = F.col(f"_y_{m}"), F.col(f"_p_{m}{side}")
            total = F.count(y) * F.var_pop(y)
            aggs += [F.when(F.min(y) < F.max(y), 1 - F.try_divide(F.sum((y - p) * (y - p)), total)).alias(f"r2_{m}{side}"), F.avg(F.abs(y - p)).alias(f"mae_{m}{side}")]
    row = t.agg(*aggs).first()
    for m, mod in found.items():
        st = mod.state
        st.r2_a, st.r2_b, st.mae_a, st.mae_b = (row[f"{k}_{m}{side}"] for k in ("r2", "mae") for side in "AB")
        st.strategy, st.w_a, st.w_b = decide_strategy(st.r2_a or 0.0, st.r2_b or 0.0, R2_GAP)
    return found


def _write_json(path: str, obj: dict) -> None:
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(obj),)], "state string").coalesce(1).write.mode("overwrite").json(path)


def _read_json(spark, path: str) -> dict:
    return json.loads(spark.read.json(path).first()["state"])


# ----------------------------------------------------------------------------- tier 2
@dataclass
class MetaState:
    scaler: dict
    strategy: str
    w_a: float
    w_b: float
    auc_a: float | None
    auc_b: float | None
    threshold: float
    pos_weight: float
    lr_coefficients: list
    point_a: dict = field(default_factory=dict)
    point_b: dict = field(default_factory=dict)
    cv_a: float | None = None
    cv_b: float | None = None


class MetaModel:
    """LR (balanced weights) vs boosted trees (positive weight), AUC-based choice,
    best-F1 threshold on val, PD / class / grade."""

    def __init__(self):
        self.state: MetaState | None = None
        self.lr: LogisticRegressionModel | None = None
        self.gbt: T.Forest | None = None
        self.assembler = VectorAssembler(inputCols=FEATURE_COLS, outputCol="features")

    def _features(self, scores: DataFrame, scaler: dict | None = None) -> DataFrame:
        keep = tuple(c for c in (ID_COL, CLONE_COL, "default") if c in scores.columns)
        return standardize(engineer_features(scores, keep=keep), scaler or self.state.scaler, keep=keep)

    def sample(self, s_train: DataFrame, scaler: dict, label: str = "default") -> G.Sample:
        """Scaled features, label and stratified fold of the training rows."""
        design = self._features(s_train, scaler)
        ids = [c for c in (ID_COL, CLONE_COL) if c in design.columns]
        folds = staged(stratified_folds(design.withColumn("_id", F.concat_ws("|", *ids)), label, G.FOLDS, id_col="_id", out="_fold"), "meta_folds")
        n, pos = folds.agg(F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0))).first()
        return G.sample(folds, ["_id"], FEATURE_COLS, label, "_fold", positive=float(int((n - pos) / max(pos, 1))))

    def grid_search(self, sample: G.Sample, spark, grids: tuple) -> tuple[DataFrame, DataFrame]:
        """(out-of-fold predictions, AUC by point and fold) of both models' grids."""
        estimators = {("meta", side): est for side, est in zip("AB", grids)}
        predictions = staged(G.out_of_fold(spark, {"meta": sample}, estimators), "meta_out_of_fold")
        return predictions, staged(G.auc_by_fold(predictions), "meta_grid")

    def fit(self, s_train: DataFrame, s_val: DataFrame, label: str = "default", grids: tuple | None = None) -> "MetaModel":
        spark, grids = s_train.sparkSession, grids or G.META_GRIDS
        scaler = fit_standard_scaler(engineer_features(s_train))
        sample = self.sample(s_train, scaler, label)
        points = G.best_points(self.grid_search(sample, spark, grids)[1])
        a, b = (est.only(est.points()[points["meta", side][0]]) for side, est in zip("AB", grids))
        self.gbt = G.forests(staged(G.refit(spark, {"meta": sample}, {("meta", "B"): b}), "meta_refit"))["meta", "B"]
        # balanced class weights n / (2 n_c), which sum to n
        design = self._features(s_train, scaler)
        n, pos = design.agg(F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0))).first()
        weight = F.when(F.col(label) == 1, F.lit(n / (2.0 * max(pos, 1)))).otherwise(F.lit(n / (2.0 * max(n - pos, 1))))
        rows = self.assembler.transform(design.withColumn("_w", weight).withColumn("_y", F.col(label).cast("double")))
        self.lr = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w", elasticNetParam=0.0, standardization=False,
                                     regParam=1.0 / (a.points()[0]["c"] * n), maxIter=200).fit(rows.select("features", "_w", "_y"))
        self.state = MetaState(scaler, "A", 1.0, 0.0, None, None, 0.5, sample.positive, self.lr.coefficients.toArray().tolist(),
                               a.points()[0], b.points()[0], points["meta", "A"][1], points["meta", "B"][1])
        both = staged(self._both(s_val), "meta_val")
        self.state.auc_a, self.state.auc_b = (_auc(both, p, label) for p in ("_pa", "_pb"))
        self.state.strategy, self.state.w_a, self.state.w_b = decide_strategy(self.state.auc_a or 0.0, self.state.auc_b or 0.0, AUC_GAP)
        pd_ = both.withColumn("pd_score", self._blend())
        self.state.threshold = curve_metrics(binary_curve(pd_, "pd_score", label)).first()["best_threshold"]
        return self

    def _both(self, scores: DataFrame) -> DataFrame:
        """ids, label, _pa, _pb: both models' probabilities."""
        d = self._features(scores)
        keep = [c for c in (ID_COL, CLONE_COL, "default") if c in d.columns]
        lr = self.lr.copy().setProbabilityCol("_prob").setPredictionCol("_pred").setRawPredictionCol("_raw")
        return (lr.transform(self.assembler.transform(d)).withColumn("_pb", forest_column([F.col(c) for c in FEATURE_COLS], [(1.0, self.gbt)], classes=True))
                .select(*keep, vector_to_array("_prob")[1].alias("_pa"), "_pb"))

    def _blend(self) -> Column:
        st = self.state
        p = {"A": F.col("_pa"), "B": F.col("_pb")}.get(st.strategy, F.lit(st.w_a) * F.col("_pa") + F.lit(st.w_b) * F.col("_pb"))
        return clip(p, 0.0, 1.0)

    def predict_proba(self, scores: DataFrame) -> DataFrame:
        """PD = wA pA + wB pB (or the single winner), clipped to [0, 1]."""
        both = self._both(scores)
        return both.select(*(c for c in both.columns if c not in ("_pa", "_pb")), self._blend().alias("pd_score"))

    def lr_coefficients(self) -> list[tuple[str, float]]:
        """LR coefficients by feature, descending."""
        return sorted(zip(FEATURE_COLS, self.lr.coefficients.toArray().tolist()), key=lambda kv: -kv[1])

    @property
    def explained(self) -> str:
        """The model that attributions explain: the chosen one, of an ensemble the heavier, A on ties."""
        return self.state.strategy if self.state.strategy in ("A", "B") else ("A" if self.state.w_a >= self.state.w_b else "B")

    def linear_attribution(self, scores: DataFrame) -> DataFrame:
        """L20 (LR): mean |coef * (x - mean)| per feature, centred on the explained frame."""
        return linear_attribution(self._features(scores).select(*FEATURE_COLS), self.lr.coefficients.toArray().tolist())

    def contributions(self, scores: DataFrame, background: DataFrame) -> DataFrame:
        """Ids, label, base, and each feature's interventional Shapley value (``phi`` map) on the explained model's log odds.

        ``background``: score rows that stand for absent features, at most MAX_BACKGROUND (ValueError beyond). A row's values
        and ``base`` (the mean over the background) add up to its log odds.
        """
        rows = self._features(background).select(*FEATURE_COLS).limit(MAX_BACKGROUND + 1).toArrow()
        if not 0 < rows.num_rows <= MAX_BACKGROUND:
            raise ValueError(f"the background needs 1 to {MAX_BACKGROUND} rows")
        back = T.filled(np.column_stack([rows.column(c).to_numpy().astype(float) for c in FEATURE_COLS]))
        d, names = self._features(scores), F.array(*map(F.lit, FEATURE_COLS))
        keep = [c for c in (ID_COL, CLONE_COL, "default") if c in d.columns]
        if self.explained == "A":
            coefs, means = self.lr.coefficients.toArray(), back.mean(0)
            phi = F.array(*(F.lit(float(k)) * (F.col(c) - F.lit(float(m))) for c, k, m in zip(FEATURE_COLS, coefs, means)))
            base = float(self.lr.intercept + coefs @ means)
        else:
            forest, base = self.gbt, float(self.gbt.predict(back).mean())

            @F.arrow_udf("array<double>")
            def values(inputs: pa.Array) -> pa.Array:
                return pa.array(list(T.shapley(forest, _matrix(inputs, back.shape[1]), back)), pa.list_(pa.float64()))

            phi = values(F.array(*(F.col(c) for c in FEATURE_COLS)))
        return d.select(*keep, F.lit(base).alias("base"), F.map_from_arrays(names, phi).alias("phi"))

    def tree_attribution(self, scores: DataFrame, background: DataFrame) -> DataFrame:
        """Mean |Shapley value| per feature of the explained model, over all rows of the background, however many.

        What the values need of the background is counted in one pass over it: means, or how many rows meet which conditions of each leaf.
        """
        d, back = self._features(scores).select(*FEATURE_COLS), self._features(background).select(*FEATURE_COLS)
        if self.explained == "A":
            mean = back.agg(*(F.avg(c).alias(c) for c in FEATURE_COLS)).first()
            if mean[0] is None:
                raise ValueError("the background needs rows")
            phi = [F.lit(float(k)) * (F.col(c) - F.lit(mean[c])) for c, k in zip(FEATURE_COLS, self.lr.coefficients.toArray())]
        else:
            leaves = T.paths(self.gbt)
            tables = T.shapley_tables(leaves, counted(back, leaves))

            @F.arrow_udf("array<double>")
            def values(inputs: pa.Array) -> pa.Array:
                return pa.array(list(T.shapley_of_tables(leaves, tables, _matrix(inputs, len(FEATURE_COLS)))), pa.list_(pa.float64()))

            d = d.select(values(F.array(*FEATURE_COLS)).alias("phi"))
            phi = [F.col("phi")[k] for k in range(len(FEATURE_COLS))]
        means = d.agg(*(F.avg(F.abs(p)).alias(c) for c, p in zip(FEATURE_COLS, phi)))
        args = ", ".join(f"'{c}', `{c}`" for c in FEATURE_COLS)
        return means.selectExpr(f"stack({len(FEATURE_COLS)}, {args}) AS (feature, mean_abs_shap)")

    def save(self, path: str) -> None:
        self.lr.write().overwrite().save(f"{path}/lr")
        G.write_forests(SparkSession.getActiveSession(), {("meta", "B"): self.gbt}, f"{path}/gbt")
        _write_json(f"{path}/state", asdict(self.state))

    @classmethod
    def load(cls, spark, path: str) -> "MetaModel":
        m = cls()
        m.state = MetaState(**_read_json(spark, f"{path}/state"))
        m.lr = LogisticRegressionModel.load(f"{path}/lr")
        m.gbt = G.forests(spark.read.schema(G.FITTED).parquet(f"{path}/gbt"))["meta", "B"]
        return m


def counted(features: DataFrame, leaves: list) -> np.ndarray:
    """``trees.pattern_counts`` of all rows: counted in tasks, added by place (as many places as the leaves' conditions have outcomes)."""
    size, names = sum(1 << len(p[1]) for p in leaves), features.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for part in parts:
            total += T.pattern_counts(leaves, T.filled(np.column_stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    found = features.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        raise ValueError("the background needs rows")
    out = np.zeros(size, np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


def linear_attribution(features: DataFrame, coefs: Sequence[float]) -> DataFrame:
    """L20 (linear): feature, mean_abs_contribution = mean |coef * (x - mean of x)|, for all columns in order."""
    cols = features.columns
    means = features.agg(*[F.avg(c).alias(c) for c in cols]).first()
    aggs = [F.avg(F.abs(F.lit(float(k)) * (F.col(c) - F.lit(float(means[c] or 0.0))))).alias(c) for c, k in zip(cols, coefs)]
    args = ", ".join(f"'{c}', `{c}`" for c in cols)
    return features.agg(*aggs).selectExpr(f"stack({len(cols)}, {args}) AS (feature, mean_abs_contribution)")


def background_rows(scores: DataFrame, rows: int = 64) -> DataFrame:
    """``rows`` score rows with the smallest hashes of their ids: the same on every run."""
    ids = [c for c in (ID_COL, CLONE_COL) if c in scores.columns]
    return scores.orderBy(F.md5(F.concat_ws("|", *ids)), *ids).limit(rows)


def _auc(pred: DataFrame, score: str, label: str) -> float | None:
    return curve_metrics(binary_curve(pred, score, label)).first()["auc"]


__all__ = ["ScoreModule", "MetaModel", "decide_strategy", "fit_modules", "first_points", "first_meta_points", "background_rows", "linear_attribution"]
