"""Registered queries: one callable per operator, (spark, sf_dir) → DataFrame.

Each runs over the whole supplied tables (or fixtures Spark derives from
them). Floating outputs are rounded only here, for the oracle comparison; the
library itself returns full precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.sources.fixtures import dirty_orders, order_features, table
from tablewise.operators import profile as P
from tablewise.operators import schema as S
from tablewise.session import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def _profile(df: DataFrame) -> DataFrame:
    return rounded(P.profile(df))


@query("profile_lineitem")
def profile_lineitem(spark, sf_dir):
    return _profile(table(spark, sf_dir, "lineitem"))


@query("profile_dirty_orders")
def profile_dirty_orders(spark, sf_dir):
    return _profile(dirty_orders(spark, sf_dir))


@query("missing_table")
def missing_table(spark, sf_dir):
    return S.schema_table(dirty_orders(spark, sf_dir)).drop("position")


@query("duplicate_rows")
def duplicate_rows(spark, sf_dir):
    return P.profile_summary(dirty_orders(spark, sf_dir))


# --- cleaning ----------------------------------------------------------------------
from tablewise.operators import clean as C  # noqa: E402
from tablewise.plans import cleaning as CP  # noqa: E402


@query("clean_dedupe")
def clean_dedupe(spark, sf_dir):
    return C.drop_duplicates(dirty_orders(spark, sf_dir))


@query("clean_drop_nulls")
def clean_drop_nulls(spark, sf_dir):
    return C.drop_nulls(dirty_orders(spark, sf_dir), "o_totalprice")


@query("impute_mean")
def impute_mean(spark, sf_dir):
    return rounded(C.impute_mean(dirty_orders(spark, sf_dir), "o_totalprice"), 4)


@query("impute_median")
def impute_median(spark, sf_dir):
    return rounded(C.impute_median(dirty_orders(spark, sf_dir), "o_totalprice"), 4)


@query("impute_mode")
def impute_mode(spark, sf_dir):
    return C.impute_mode(dirty_orders(spark, sf_dir), "o_orderstatus")


@query("impute_constant")
def impute_constant(spark, sf_dir):
    return C.impute_constant(dirty_orders(spark, sf_dir), "o_orderstatus", None)


@query("cap_iqr")
def cap_iqr(spark, sf_dir):
    return rounded(C.cap_iqr(dirty_orders(spark, sf_dir), "o_totalprice"), 4)


@query("remove_outliers")
def remove_outliers(spark, sf_dir):
    return C.remove_outliers(dirty_orders(spark, sf_dir), "o_totalprice")


@query("convert_types")
def convert_types(spark, sf_dir):
    d = dirty_orders(spark, sf_dir)
    return d.select("o_orderkey",
                    C.convert_expr(d, "price_text", "int").alias("price_int"),
                    C.convert_expr(d, "price_text", "float").alias("price_float"),
                    C.convert_expr(d, "date_text", "datetime").cast("string").alias("date_value"),
                    C.convert_expr(d, "o_custkey", "str").alias("custkey_text"),
                    C.convert_expr(d, "o_orderpriority", "category").alias("priority_category"))


DEMO_PLAN = CP.CleaningPlan(True, [
    CP.ColumnStrategy("o_orderstatus", "impute_mode"),
    CP.ColumnStrategy("o_totalprice", "impute_median", None, "cap_iqr"),
    CP.ColumnStrategy("price_text", "impute_mean", None, "none", "float"),
    CP.ColumnStrategy("date_text", "drop", None, "none", "datetime"),
])


def _demo_clean(spark, sf_dir):
    return CP.apply_plan(dirty_orders(spark, sf_dir), DEMO_PLAN)


@query("apply_plan")
def apply_plan(spark, sf_dir):
    res = _demo_clean(spark, sf_dir)
    d = res.data
    return rounded(d.withColumn("date_text", F.col("date_text").cast("string")), 4)


@query("cleaning_report")
def cleaning_report(spark, sf_dir):
    res = _demo_clean(spark, sf_dir)
    return rounded(res.log_frame(spark).select("seq", "column", "action", "affected_rows",
                                               "lower_bound", "upper_bound"), 4)


@query("recommend_plan")
def recommend_plan(spark, sf_dir):
    d = dirty_orders(spark, sf_dir)
    rows = P.profile_columns(d)
    dup = P.profile_summary(d).first()["duplicate_rows"]
    plan = CP.recommend_plan(d, rows, dup)
    return CP.plan_frame(spark, plan).drop("position")


# --- EDA -----------------------------------------------------------------------------
from tablewise.operators import eda as E  # noqa: E402

LINEITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_lineitem")
def describe_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(E.describe(li, S.column_roles(li)[0]), 6)


@query("skew_lineitem")
def skew_lineitem(spark, sf_dir):
    return rounded(E.skewness(table(spark, sf_dir, "lineitem")), 6)


@query("top_values_orders")
def top_values_orders(spark, sf_dir):
    return E.top_values(table(spark, sf_dir, "orders"), 5)


@query("cardinality_orders")
def cardinality_orders(spark, sf_dir):
    return E.cardinality(table(spark, sf_dir, "orders"))


@query("correlation_matrix")
def correlation_matrix(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(E.correlation_matrix(li, S.column_roles(li)[0]), 6)


@query("top_correlations")
def top_correlations(spark, sf_dir):
    return E.top_correlations(order_features(spark, sf_dir))


@query("target_info_numeric")
def target_info_numeric(spark, sf_dir):
    return rounded(E.target_info(table(spark, sf_dir, "orders"), "o_totalprice"), 4)


@query("target_info_categorical")
def target_info_categorical(spark, sf_dir):
    return E.target_info(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("class_balance")
def class_balance(spark, sf_dir):
    return rounded(E.class_balance(table(spark, sf_dir, "orders"), "o_orderstatus"), 6)


@query("distribution_labels")
def distribution_labels(spark, sf_dir):
    return E.distribution_labels(order_features(spark, sf_dir))


@query("key_findings")
def key_findings(spark, sf_dir):
    return rounded(E.key_findings(order_features(spark, sf_dir), "returned"), 4)


@query("suggest_features")
def suggest_features(spark, sf_dir):
    return E.suggest_features(order_features(spark, sf_dir), "returned")


@query("apply_features")
def apply_features(spark, sf_dir):
    """E14, long form: one row per order and engineered feature."""
    of = settled(order_features(spark, sf_dir), "order-features")  # the join is read by each step below
    sug = E.suggest_features(of, "returned")
    names = [r["feature"] for r in sug.collect()]
    wide = E.apply_features(of, sug)
    arr = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return rounded(wide.select("o_orderkey", F.inline(arr)), 6)


# --- chart data ----------------------------------------------------------------------
from tablewise.operators import charts as V  # noqa: E402


@query("heatmap_features")
def heatmap_features(spark, sf_dir):
    return rounded(V.heatmap_data(order_features(spark, sf_dir)), 6)


@query("histogram_price")
def histogram_price(spark, sf_dir):
    return rounded(V.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 30), 6)


@query("density_price")
def density_price(spark, sf_dir):
    d = V.density_curve(table(spark, sf_dir, "orders"), "o_totalprice", 200)
    return d.select("point", F.round("x", 4).alias("x"), F.round("density", 14).alias("density"))


@query("box_by_flag")
def box_by_flag(spark, sf_dir):
    return rounded(V.box_stats(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag")[0], 6)


@query("box_outliers_events")
def box_outliers_events(spark, sf_dir):
    return V.box_stats(table(spark, sf_dir, "events"), "value", "event_type")[1]


@query("bar_priority")
def bar_priority(spark, sf_dir):
    return V.value_frequency(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("trendline")
def trendline(spark, sf_dir):
    return rounded(V.ols_trendline(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), 6)


@query("strongest_pair")
def strongest_pair(spark, sf_dir):
    of = order_features(spark, sf_dir)
    num = S.non_constant_numeric(of)
    best = V.strongest_pair(E.correlation_pairs(of, num))
    return rounded(spark.createDataFrame([(best[2], best[3], best[4])],
                                         "feature_1 string, feature_2 string, correlation double"), 6)


@query("scatter_points")
def scatter_points(spark, sf_dir):
    return V.scatter_points(order_features(spark, sf_dir), "n_lines", "sum_qty", "o_orderpriority")


@query("chart_manifest")
def chart_manifest(spark, sf_dir):
    return V.chart_manifest(order_features(spark, sf_dir), "o_orderpriority")


# --- ML preparation and metrics ------------------------------------------------------
from pyspark.ml.functions import vector_to_array  # noqa: E402

from tablewise.operators import metrics as MT  # noqa: E402
from tablewise.operators import prep as PR  # noqa: E402

SCALE_COLS = ["c_acctbal", "o_totalprice", "sum_qty", "avg_disc"]


@query("label_encode")
def label_encode(spark, sf_dir):
    df, _ = PR.label_encode(table(spark, sf_dir, "orders"), "o_orderpriority")
    return df.select("o_orderkey", "label")


@query("standard_scale")
def standard_scale(spark, sf_dir):
    of = order_features(spark, sf_dir)
    pre = PR.fit_preprocessor(of, SCALE_COLS, [])
    return rounded(of.select("o_orderkey", *PR.standard_scale_exprs(pre.stats)), 6)


@query("one_hot")
def one_hot(spark, sf_dir):
    of = order_features(spark, sf_dir)
    pre = PR.fit_preprocessor(of, [], ["c_mktsegment"])
    names = F.array(*[F.lit(n) for n in pre.feature_names])
    out = pre.transform(of).select("o_orderkey", vector_to_array("features").alias("v"))
    return out.select("o_orderkey", F.posexplode("v").alias("slot", "value")).select(
        "o_orderkey", F.element_at(names, F.col("slot") + 1).alias("feature"), "value")


@query("hash_split")
def hash_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tr, te = PR.hash_split(o, "o_orderkey")
    return (tr.select("o_orderkey", F.lit("train").alias("split"))
            .unionByName(te.select("o_orderkey", F.lit("test").alias("split"))))


def _formula_predictions(spark, sf_dir):
    of = order_features(spark, sf_dir)
    return of.select("o_orderkey", F.col("returned").alias("label"),
                     (F.col("n_lines") > 4).cast("int").alias("prediction"),
                     F.col("avg_disc").alias("score"))


@query("classification_metrics")
def classification_metrics(spark, sf_dir):
    return rounded(MT.classification_metrics(_formula_predictions(spark, sf_dir)), 6)


@query("roc_auc_binary")
def roc_auc_binary(spark, sf_dir):
    return rounded(MT.roc_auc_binary(_formula_predictions(spark, sf_dir)), 6)


@query("roc_auc_ovr")
def roc_auc_ovr(spark, sf_dir):
    of = order_features(spark, sf_dir)
    df, _ = PR.label_encode(of, "o_orderstatus")
    df = df.select("label", F.array(F.col("avg_disc"), F.col("n_lines") / 7.0,
                                    F.col("returned") * 0.5 + F.col("avg_disc")).alias("probability"))
    per = [(int(r["cls"]), r["roc_auc"]) for r in MT.roc_auc_ovr(df).collect()]  # one row per class
    vals = [v for _, v in per if v is not None]
    rows = per + [(None, sum(vals) / len(vals) if vals else None)]  # macro mean, as roc_auc_macro
    return rounded(spark.createDataFrame(rows, "cls int, roc_auc double"), 6)


@query("regression_metrics")
def regression_metrics(spark, sf_dir):
    of = order_features(spark, sf_dir)
    df = of.select(F.col("o_totalprice").alias("label"), (F.col("sum_qty") * 1500.0).alias("prediction"))
    return rounded(MT.regression_metrics(df), 4)


# --- models and attribution (rows-only checks: fitted models have no SQL oracle) ------
from pyspark.ml.functions import array_to_vector  # noqa: E402

from tablewise.operators import explain as X  # noqa: E402
from tablewise.operators import models as M  # noqa: E402

_RUNS: dict = {}


def _run(spark, sf_dir, target):
    key = (sf_dir, target, id(spark))
    if key not in _RUNS:
        of = order_features(spark, sf_dir)
        _RUNS[key] = M.train_supervised(of, target, key="o_orderkey")
    return _RUNS[key]


@query("leaderboard_cls")
def leaderboard_cls(spark, sf_dir):
    return _run(spark, sf_dir, "returned").leaderboard(spark)


@query("leaderboard_reg")
def leaderboard_reg(spark, sf_dir):
    return _run(spark, sf_dir, "o_totalprice").leaderboard(spark)


def _kmeans(spark, sf_dir):
    key = (sf_dir, "kmeans", id(spark))
    if key not in _RUNS:
        emb = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
        _RUNS[key] = M.kmeans_search(emb)
    return _RUNS[key]


@query("kmeans_search")
def kmeans_search(spark, sf_dir):
    return M.leaderboard_frame(spark, "clustering", _kmeans(spark, sf_dir).metrics)


@query("cluster_assign")
def cluster_assign(spark, sf_dir):
    return _kmeans(spark, sf_dir).assign().select("vec_id", "Cluster")


def _forest(spark, sf_dir):
    run = _run(spark, sf_dir, "o_totalprice")
    return run, run.models["Random Forest Regressor"]


def _forest_shap(spark, sf_dir):
    key = (sf_dir, "forest_shap", id(spark))
    if key not in _RUNS:
        run, model = _forest(spark, sf_dir)
        _RUNS[key] = X.tree_shap(model, run.test, "o_orderkey").persist()
    return _RUNS[key]


@query("tree_shap")
def tree_shap(spark, sf_dir):
    return _forest_shap(spark, sf_dir)


@query("linear_shap")
def linear_shap(spark, sf_dir):
    run = _run(spark, sf_dir, "o_totalprice")
    return X.linear_shap(run.models["Linear Regression"], run.train, run.test, "o_orderkey")


@query("shap_importance")
def shap_importance(spark, sf_dir):
    run, _ = _forest(spark, sf_dir)
    sh = X.choose_class(_forest_shap(spark, sf_dir))
    return X.shap_importance(sh, run.preprocessor.feature_names)


@query("local_explanation")
def local_explanation(spark, sf_dir):
    run, _ = _forest(spark, sf_dir)
    return X.local_explanation(_forest_shap(spark, sf_dir), "o_orderkey", run.preprocessor.feature_names)


@query("shap_distribution")
def shap_distribution(spark, sf_dir):
    run, _ = _forest(spark, sf_dir)
    return X.shap_long(_forest_shap(spark, sf_dir), "o_orderkey", run.preprocessor.feature_names, run.test)


@query("native_importance")
def native_importance(spark, sf_dir):
    run = _run(spark, sf_dir, "returned")
    return X.native_importance(run.models["Random Forest"], run.preprocessor.feature_names)


# --- result tables --------------------------------------------------------------------
from tablewise.operators import results as RS  # noqa: E402


@query("dataset_summary")
def dataset_summary(spark, sf_dir):
    d = dirty_orders(spark, sf_dir)
    res = CP.apply_plan(d, DEMO_PLAN)
    return RS.dataset_summary(spark, res.original_shape[0], res.data, res.data.count(), "o_totalprice")


@query("run_summary")
def run_summary(spark, sf_dir):
    from tablewise.plans.analyze import analyze
    a = analyze(dirty_orders(spark, sf_dir), "o_totalprice", DEMO_PLAN, key="o_orderkey")
    return a.tables["run_summary"].select("dataset.*", "problem_type", "selected_model", "attribution_method",
                                          F.size("cleaning_actions").alias("n_actions"),
                                          F.size("top_predictive_features").alias("n_features"))


# --- remaining single operators -------------------------------------------------------
from tablewise.sources import io as IO  # noqa: E402


@query("preview_orders")
def preview_orders(spark, sf_dir):
    """S3: first 5 rows by key (a top-n, the limit is the feature)."""
    return IO.preview(table(spark, sf_dir, "orders"), 5, ["o_orderkey"]).withColumn(
        "o_orderdate", F.col("o_orderdate").cast("string"))


@query("constant_columns")
def constant_columns(spark, sf_dir):
    """T5: which numeric columns of lineitem vary."""
    li = table(spark, sf_dir, "lineitem")
    num, _ = S.column_roles(li)
    keep = set(S.non_constant_numeric(li, num))
    return spark.createDataFrame([(c, c in keep) for c in num], "column string, non_constant boolean")


@query("eda_numeric_summary")
def eda_numeric_summary(spark, sf_dir):
    """The compact per-column summary (first 15 numeric columns)."""
    li = table(spark, sf_dir, "lineitem")
    summary = E.eda_summary(li, None)["numeric_columns_summary"]
    rows = [(c, v["mean"], v["std"], v["min"], v["max"], v["skewness"]) for c, v in summary.items()]
    return rounded(spark.createDataFrame(
        rows, "column string, mean double, std double, min double, max double, skewness double"), 6)


@query("score_champion")
def score_champion(spark, sf_dir):
    """Score the held-out rows with the regression champion."""
    run = _run(spark, sf_dir, "o_totalprice")
    return run.champion_model().transform(run.test).select("o_orderkey", "label", "prediction")


@query("skew_events")
def skew_events(spark, sf_dir):
    """E2 on a long right tail (events.value)."""
    return rounded(E.skewness(table(spark, sf_dir, "events"), ["value"]), 6)


@query("csv_roundtrip")
def csv_roundtrip(spark, sf_dir):
    """S4 + S1: write the dirty fixture as CSV, read it back with NA tokens and
    type inference (the file lives under the session's shared scratch folder)."""
    import uuid
    from tablewise.session import scratch_path
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
    IO.write_cleaned(dirty_orders(spark, sf_dir), path, fmt="csv")
    return IO.read_csv(spark, path)


# --- vocabularies, boosted trees, quantiles of many groups ------------------------------
from tablewise.functions.quantiles import quantile_table  # noqa: E402
from tablewise.operators import boosting as B  # noqa: E402
from tablewise.operators import vocabulary as VO  # noqa: E402


@query("vocabulary_codes")
def vocabulary_codes(spark, sf_dir):
    """M3, M7: values and codes of a column of few and one of many values."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_custkey").cast("string").alias("customer"))
    v = VO.fit_vocabulary(o, ["o_orderpriority", "customer"])
    return v.table.select(F.get(F.array(F.lit("o_orderpriority"), F.lit("customer")), F.col("column")).alias("column"), "value", "code", "n")


@query("one_hot_sparse")
def one_hot_sparse(spark, sf_dir):
    """M7, M8: the slots that are set, by name, of vectors over the customers, segments and line counts of orders."""
    of = order_features(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer")), "o_orderkey")
    v = VO.fit_vocabulary(of, ["customer", "c_mktsegment"])
    coded = VO.encode(of.select("o_orderkey", "customer", "c_mktsegment"), v, ["k0", "k1"])
    starts = v.offsets(1)
    slots = coded.select("o_orderkey", F.explode(F.array(F.col("k0") + starts[0], F.col("k1") + starts[1])).alias("slot")).where("slot is not null")
    return slots.join(v.names(1), "slot").select("o_orderkey", "slot", "name")


@query("boosted_rounds")
def boosted_rounds(spark, sf_dir):
    """Losses, splits and leaves of three rounds of second-order boosting with one split each."""
    from pyspark.ml.feature import VectorAssembler
    of = order_features(spark, sf_dir).where("n_lines is not null and returned is not null and sum_qty is not null and o_totalprice is not null")
    of = of.select(F.col("n_lines").cast("double").alias("a"), F.col("returned").cast("double").alias("b"), F.floor(F.col("sum_qty") / 100).cast("double").alias("c"), (F.col("o_totalprice") / 100000).alias("label"))
    model = B.BoostedTrees("squared", rounds=3, depth=1, bins=1024).fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(of))
    rows = []
    for r, (t,) in enumerate(model.trees):
        f = int(t.feature[0])
        rows.append((r, "abc"[f], float(t.threshold[0]), float(t.gain[0]), float(t.value[1]), float(t.value[2]), model.losses[r]))
    return rounded(spark.createDataFrame(rows, "round int, feature string, threshold double, gain double, left_value double, right_value double, loss double"), 6)


@query("quartiles_by_order")
def quartiles_by_order(spark, sf_dir):
    """V6: exact quartiles of as many groups as there are orders."""
    t = quantile_table(table(spark, sf_dir, "lineitem"), ["l_extendedprice"], [0.25, 0.5, 0.75], "l_orderkey")
    return rounded(t.select("group", *[F.col("qs")[i].alias(x) for i, x in enumerate(("q1", "median", "q3"))]), 6)
