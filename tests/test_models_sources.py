import os
import tempfile

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewise.operators import models as M
from tablewise.plans.analyze import analyze
from tablewise.sources import io
from tablewise.sources.synthetic import synth_churn, synth_housing
from conftest import SF001

FAST = M.ModelSettings(trees=5, forest_depth=4, boost_rounds=3, boost_depth=3, logistic_iter=50)


def test_synthetic_tables(spark):
    churn = synth_churn(spark)
    assert churn.count() == 153 and len(churn.columns) == 9
    housing = synth_housing(spark)
    assert housing.count() == 150
    assert housing.where("HouseID = 6").first()["Square_Footage"] == 12000
    assert housing.where("Neighborhood is null").count() == 1


def test_read_csv_na_tokens_and_types(spark):
    d = tempfile.mkdtemp(prefix="tw-csv-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as f:
        f.write("a,b,c,d\n1,1.5,x,True\n,NA,n/a,False\n3,NaN,None,\n")
    df = io.read_csv(spark, path)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean"}
    rows = df.orderBy(F.col("a").asc_nulls_last()).collect()
    assert rows[0]["a"] == 1 and rows[2]["a"] is None and rows[1]["b"] is None and rows[1]["c"] is None


def test_leaderboard_classification(spark):
    run = M.train_supervised(synth_churn(spark, 400), "Churn", key="CustomerID", settings=FAST)
    lb = run.leaderboard(spark).collect()
    assert [r["algorithm"] for r in lb] == M.CLASSIFIERS
    assert run.champion in M.CLASSIFIERS
    assert all(0 <= r["accuracy"] <= 1 for r in lb)


def test_leaderboard_regression(spark):
    run = M.train_supervised(synth_housing(spark, 300), "House_Price", key="HouseID", settings=FAST)
    lb = run.leaderboard(spark).collect()
    assert [r["algorithm"] for r in lb] == M.REGRESSORS
    best = max(lb, key=lambda r: r["r2_score"])
    assert run.champion == best["algorithm"]


def test_kmeans_search_embeddings(spark):
    emb = io.read_table(spark, f"{SF001}/embeddings.parquet").select(
        "vec_id", array_to_vector("embedding").alias("features"))
    run = M.kmeans_search(emb, restarts=2)
    assert run.best_k in (2, 3, 4, 5)
    assert run.assign().select("Cluster").distinct().count() == run.best_k


def test_analyze_end_to_end(spark):
    a = analyze(synth_churn(spark, 300), "Churn", key="CustomerID", settings=FAST)
    assert a.problem_type == "classification"
    rs = a.tables["run_summary"].first()
    assert rs["selected_model"] == a.champion
    assert rs["dataset"]["original_rows"] == 303
    assert "dataset_summary" in a.tables and "chart_manifest" in a.tables


def test_analyze_clustering(spark):
    a = analyze(synth_housing(spark, 120).drop("House_Price"), None, settings=FAST)
    assert a.problem_type == "clustering"
    assert a.tables["clusters"].count() == 120


def test_analyze_multiclass(spark):
    a = analyze(synth_churn(spark, 300), "Contract_Type", key="CustomerID", settings=FAST)
    assert a.problem_type == "classification"
    assert a.tables["leaderboard"].count() == 3
    rs = a.tables["run_summary"].first()
    assert rs["attribution_method"] in ("tree_shap", "linear_shap", "native_importance")
    assert len(rs["top_predictive_features"]) == 5
