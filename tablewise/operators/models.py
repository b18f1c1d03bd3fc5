"""Candidate models, leaderboard, champion, clustering.

Contract with the reference: same candidate list, same metrics, same selection
rule. Fits are Spark ML estimators, forests (:mod:`forest`) and boosted trees
(:mod:`boosting`) on one persisted, assembled train set;
metric aggregates come from :mod:`tablewise.operators.metrics`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.errors import AnalysisException, ArithmeticException, IllegalArgumentException
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.exprs import q
from tablewise.operators import kmeans as KM
from tablewise.operators import metrics as MT
from tablewise.operators.boosting import BoostedTrees
from tablewise.operators.forest import RandomForest
from tablewise.operators import prep as PR
from tablewise.operators.schema import detect_problem_type
from tablewise.session import fit_parallelism, persist_spread

# Candidate names in fitting order (ties go to the earlier one).
CLASSIFIERS = ["Logistic Regression", "Random Forest", "Gradient Boosted Trees"]
REGRESSORS = ["Linear Regression", "Random Forest Regressor", "Gradient Boosted Trees Regressor"]

# What fitting raises for data that a candidate cannot take.
UNFIT = (ValueError, TypeError, AnalysisException, ArithmeticException, IllegalArgumentException)


@dataclass
class ModelSettings:
    trees: int = 100
    forest_depth: int = 10
    boost_rounds: int = 100
    boost_depth: int = 6
    boost_step: float = 0.3
    logistic_iter: int = 1000
    seed: int = 42
    # Boosted trees write their table every n rounds to the session's checkpoint
    # folder (executor loss then costs n rounds, not the whole fit).
    checkpoint_every: int = 10
    boost_bins: int = 256
    # Dates as seconds since 1970 ("number") or one category a value ("category").
    date_features: str = "number"
    # Split-statistics budget per task for forests; a level with more takes several passes.
    tree_memory_mb: int = 64


def _boosted(objective: str, s: ModelSettings, classes: int = 2) -> BoostedTrees:
    return BoostedTrees(objective, classes, rounds=s.boost_rounds, depth=s.boost_depth, step=s.boost_step, bins=s.boost_bins, checkpoint_every=s.checkpoint_every)


def classifier(name: str, n_train: int, n_classes: int, s: ModelSettings):
    """M10–M12."""
    if name == "Logistic Regression":
        # sklearn's C=1 L2 penalty ↔ regParam = 1/(C·n) on the mean loss.
        return LogisticRegression(maxIter=s.logistic_iter, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                  standardization=False, family="auto")
    if name == "Random Forest":
        return RandomForest("class", n_classes, s.trees, s.forest_depth, subset="sqrt", seed=s.seed, memory_mb=s.tree_memory_mb)
    if name == "Gradient Boosted Trees":
        return _boosted("logistic" if n_classes <= 2 else "softmax", s, n_classes)
    raise ValueError(name)


def regressor(name: str, s: ModelSettings):
    """M13–M15."""
    if name == "Linear Regression":
        return LinearRegression(regParam=0.0, elasticNetParam=0.0, solver="auto")
    if name == "Random Forest Regressor":
        return RandomForest("squared", trees=s.trees, depth=s.forest_depth, subset="all", seed=s.seed, memory_mb=s.tree_memory_mb)
    if name == "Gradient Boosted Trees Regressor":
        return _boosted("squared", s)
    raise ValueError(name)


@dataclass
class SupervisedRun:
    problem_type: str
    target: str
    labels: list | None
    preprocessor: PR.Preprocessor
    train: DataFrame
    test: DataFrame
    models: dict = field(default_factory=dict)
    metrics: list = field(default_factory=list)
    failures: list = field(default_factory=list)
    champion: str | None = None

    def leaderboard(self, spark) -> DataFrame:
        """M24 rows plus M26 best-value flags."""
        return leaderboard_frame(spark, self.problem_type, self.metrics)

    def champion_model(self):
        return self.models.get(self.champion)

    def score(self, df: DataFrame) -> DataFrame:
        """Preprocess and predict new rows with the champion."""
        return self.champion_model().transform(self.preprocessor.transform(df))


def _class_metrics(pred: DataFrame, n_classes: int) -> dict:
    m = MT.classification_metrics(pred, "label", "prediction").first().asDict()
    try:
        if n_classes == 2:
            src = "probability" if "probability" in pred.columns else "rawPrediction"
            sc = pred.select("label", vector_to_array(F.col(src))[1].alias("score"))
            auc = MT.roc_auc_binary(sc, "label", "score").first()["roc_auc"]
        else:
            src = "probability" if "probability" in pred.columns else "rawPrediction"
            per = MT.roc_auc_ovr(pred.select("label", vector_to_array(F.col(src)).alias("p")), "label", "p")
            auc = MT.roc_auc_macro(per).first()["roc_auc"]
    except (ValueError, ArithmeticException):  # an AUC that is not defined is missing, not 0
        auc = None
    m["roc_auc"] = auc
    return m


def leaderboard_frame(spark, problem_type: str, rows: list[dict]) -> DataFrame:
    if problem_type == "classification":
        metric_cols = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]
    elif problem_type == "regression":
        metric_cols = ["mse", "rmse", "mae", "r2_score"]
    else:
        metric_cols = ["silhouette_score", "training_cost"]
    schema = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("algorithm", T.StringType())]
                          + [T.StructField(c, T.DoubleType()) for c in metric_cols])
    df = spark.createDataFrame([tuple([r["position"], r["algorithm"]] + [r.get(c) for c in metric_cols])
                                for r in rows], schema)
    return leaderboard_best(df)


def leaderboard_best(lb: DataFrame) -> DataFrame:
    """Flag the best value per metric (max accuracy/f1/r2, min mse/rmse).

    The leaderboard has one row per candidate (three), so plain aggregates are
    taken first and joined back as literals."""
    marks = {"accuracy": "max", "f1_score": "max", "r2_score": "max", "mse": "min", "rmse": "min",
             "silhouette_score": "max"}
    present = [c for c in marks if c in lb.columns]
    if not present:
        return lb
    best = lb.agg(*[(F.max(c) if marks[c] == "max" else F.min(c)).alias(c) for c in present]).first()
    return lb.select("*", *[(F.col(c) == F.lit(best[c])).alias(f"best_{c}") for c in present])


def select_champion(problem_type: str, rows: list[dict]) -> str | None:
    """Max weighted F1 / max R² / max silhouette; ties → earlier candidate."""
    key = {"classification": "f1_score", "regression": "r2_score", "clustering": "silhouette_score"}[problem_type]
    best = None
    for r in sorted(rows, key=lambda r: r["position"]):
        v = r.get(key)
        if v is None:
            continue
        if best is None or v > best[1]:
            best = (r["algorithm"], v)
    return best[0] if best else None


def train_supervised(df: DataFrame, target: str, key: str | None = None, exclude: list[str] | None = None,
                     settings: ModelSettings | None = None, fit_scope: str = "train",
                     candidates: list[str] | None = None, parallel: int = 3) -> SupervisedRun:
    """M1–M9 + M10–M15 + M19–M25 for one target."""
    s = settings or ModelSettings()
    if not target or target not in df.columns:
        raise ValueError("train_supervised needs a target column")
    held = data = persist_spread(PR.drop_null_target(df, target), key)  # read by every step below
    problem = detect_problem_type(held, target)
    labels = None
    if problem == "classification":
        labels = PR.class_labels(data, target)
        data = data.withColumn("label", PR.label_expr(target, labels))
    else:
        data = data.withColumn("label", q(target).cast("double"))
    num, cat = PR.feature_columns(data.drop("label"), target, (exclude or []) + ([key] if key else []), s.date_features)
    train, test = PR.hash_split(data, key)
    pre = PR.fit_preprocessor(data if fit_scope == "all" else train, num, cat)
    keep = ([key] if key else []) + ["label", "features"]
    train_v = pre.transform(train).select(*keep).persist(StorageLevel.MEMORY_AND_DISK)
    test_v = pre.transform(test).select(*keep).persist(StorageLevel.MEMORY_AND_DISK)
    n_train = train_v.count()
    test_v.count()
    held.unpersist()  # train/test vectors are persisted now
    run = SupervisedRun(problem, target, labels, pre, train_v, test_v)
    names = candidates or (CLASSIFIERS if problem == "classification" else REGRESSORS)
    from concurrent.futures import ThreadPoolExecutor

    def fit(item):
        pos, name = item
        try:
            est = (classifier(name, n_train, len(labels), s) if problem == "classification" else regressor(name, s))
            model = est.fit(train_v)
            pred = model.transform(test_v)
            # several jobs read the predictions: each row is predicted once
            pred = pred.select(*[c for c in ("label", "prediction", "probability", "rawPrediction") if c in pred.columns]).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                if problem == "classification":
                    m = _class_metrics(pred, len(labels))
                else:
                    m = MT.regression_metrics(pred, "label", "prediction").first().asDict()
            finally:
                pred.unpersist()
            return pos, name, model, m, None
        except UNFIT as e:  # a candidate that cannot be fitted is logged; a lost job or executor raises
            return pos, name, None, None, f"{type(e).__name__}: {e}"

    # Candidates are independent: their fits run as concurrent Spark jobs.
    workers = fit_parallelism(df.sparkSession, parallel)
    with ThreadPoolExecutor(max_workers=workers) as pool:
        done = list(pool.map(fit, list(enumerate(names))))
    for pos, name, model, m, err in sorted(done, key=lambda t: t[0]):
        if err:
            run.failures.append((name, err))
            continue
        run.models[name] = model
        run.metrics.append(dict(position=pos, algorithm=name, **m))
    run.champion = select_champion(problem, run.metrics)
    return run


# --- M16–M18 clustering ------------------------------------------------------------
@dataclass
class ClusteringRun:
    features: DataFrame
    metrics: list = field(default_factory=list)
    models: dict = field(default_factory=dict)
    best_k: int | None = None
    silhouette_metric: str = "squaredEuclidean"

    def assign(self, df: DataFrame | None = None) -> DataFrame:
        """Rows with their ``Cluster`` label."""
        model = self.models[self.best_k]
        out = model.transform(self.features if df is None else df)
        return out.withColumnRenamed("prediction", "Cluster")


def kmeans_search(features: DataFrame, ks=(2, 3, 4, 5), restarts: int = 10, seed: int = 42,
                  features_col: str = "features", max_iter: int = 300) -> ClusteringRun:
    """K-means for each k (while rows > k), ``restarts`` seeds each,
    the least training cost kept per k; best k by silhouette. All models share
    the scans: the data is read once an iteration, whatever their number.

    Silhouette is Spark's ``ClusteringEvaluator`` (squared Euclidean distance),
    which is O(n·k) — an exact Euclidean silhouette needs all pairs of rows and
    is not offered. The metric used is reported on the run.
    """
    data = features.persist(StorageLevel.MEMORY_AND_DISK)
    n = data.count()
    run = ClusteringRun(data)
    evaluator = ClusteringEvaluator(featuresCol=features_col, predictionCol="prediction",
                                    distanceMeasure="squaredEuclidean")
    wanted = [(k, seed + r) for k in ks if n > k for r in range(restarts)]
    fits = list(zip(wanted, KM.fit_many(data, wanted, features_col, max_iter))) if wanted else []
    for pos, k in enumerate(ks):
        cands = [(model.cost, s, model) for (kk, s), model in fits if kk == k]
        if not cands:
            continue
        cost, _, model = min(cands, key=lambda t: t[:2])  # least cost; earlier seed on ties
        sil = evaluator.evaluate(model.transform(data))
        run.models[k] = model
        run.metrics.append(dict(position=pos, algorithm=f"KMeans (k={k})", k=k, silhouette_score=sil,
                                training_cost=cost))
    if not run.metrics:
        raise ValueError(f"kmeans_search: {n} rows are too few for k in {list(ks)}")
    best = max(sorted(run.metrics, key=lambda r: r["position"]), key=lambda r: r["silhouette_score"])
    run.best_k = best["k"]
    return run
