import os

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from tablewise.operators import results as R
from tablewise.plans import cleaning as CP
from tablewise.plans.analyze import analyze
from tablewise.session import checkpoint_dir, materialize, scratch_path
from tablewise.sources import io
from tablewise.sources.fixtures import dirty_orders
from conftest import SF001


def test_checkpoint_dir_from_session(spark):
    d = checkpoint_dir(spark)
    assert d and spark.conf.get("spark.checkpoint.dir") in d
    df = materialize(spark.range(10))
    assert df.count() == 10


def test_write_cleaned_and_clusters(spark):
    base = scratch_path(spark, "io-test")
    df = spark.range(5).withColumnRenamed("id", "x")
    p = io.write_cleaned(df, os.path.join(base, "cleaned"))
    assert spark.read.parquet(p).count() == 5
    with pytest.raises(ValueError):
        io.write_clusters(df, p, source_path=p)
    io.write_clusters(df, os.path.join(base, "clusters"), source_path=p)


def test_save_and_load_model(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                             LinearRegression(labelCol="y")]).fit(df)
    path = io.save_model(model, scratch_path(spark, "model-test"))
    again = io.load_model(path)
    a = [r["prediction"] for r in model.transform(df).collect()]
    b = [r["prediction"] for r in again.transform(df).collect()]
    assert a == b


def test_write_results_partitioned(spark):
    out = scratch_path(spark, "results-test")
    paths = R.write_results({"t": spark.range(3)}, out, "run1")
    back = spark.read.parquet(paths["t"])
    assert back.where("run_id = 'run1'").count() == 3


def test_preview_ordered(spark):
    rows = io.preview(spark.range(100), 3, ["id"]).collect()
    assert [r["id"] for r in rows] == [0, 1, 2]


def test_sample_rows_repeatable(spark):
    df = spark.range(10000)
    a = io.sample_rows(df, 0.1, key="id").count()
    b = io.sample_rows(df, 0.1, key="id").count()
    assert a == b and 800 < a < 1200


def test_recommend_and_apply_on_dirty_orders(spark):
    from tablewise.operators.profile import profile_columns, profile_summary
    d = dirty_orders(spark, SF001)
    plan = CP.recommend_plan(d, profile_columns(d), profile_summary(d).first()["duplicate_rows"])
    assert plan.drop_duplicates
    cols = {s.column_name: s for s in plan.columns}
    assert cols["o_totalprice"].missing_value_action == "impute_median"
    assert cols["date_text"].type_conversion == "datetime"
    res = CP.apply_plan(d, plan)
    assert res.data.where("o_totalprice is null").count() == 0
    assert res.data.where("o_orderstatus is null").count() == 0
    assert res.report_frame(spark).first()["original_rows"] == d.count()


def test_analyze_without_model(spark):
    a = analyze(dirty_orders(spark, SF001), "o_orderstatus", model=False)
    assert {"profile", "cleaned", "describe", "chart_manifest", "run_summary"} <= set(a.tables)
    assert a.tables["dataset_summary"].first()["original_rows"] == dirty_orders(spark, SF001).count()


def test_analysis_write(spark):
    a = analyze(dirty_orders(spark, SF001), None, model=False)
    out = scratch_path(spark, "analysis-out")
    paths = a.write(out, "r1")
    assert "profile" in paths and "cleaned" not in paths
    assert spark.read.parquet(paths["profile"]).where("run_id = 'r1'").count() == 7
