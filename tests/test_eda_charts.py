import math

import pytest
from pyspark.sql import functions as F

from tablewise.operators import charts as V
from tablewise.operators import eda as E


def test_skew_matches_reference_value(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 3, 9, 50]], "x double")
    r = E.skewness(df, ["x"]).first()
    assert r["skewness"] == pytest.approx(2.5329972394, abs=1e-9)


def test_skew_small_n_and_constant_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, k double")
    rows = {r["column"]: r["skewness"] for r in E.skewness(df, ["a", "k"]).collect()}
    assert rows["a"] is None and rows["k"] is None


def test_pairwise_complete_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (None, 1.0), (4.0, None), (5.0, 9.0)], "a double, b double")
    (_, _, _, _, r), = E.correlation_pairs(df, ["a", "b"])
    assert r == pytest.approx(0.9930989591, abs=1e-9)


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0)], "k double, a double")
    (_, _, _, _, r), = E.correlation_pairs(df, ["k", "a"])
    assert r is None


def test_top_values_counts_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), (None,), ("a",), (None,)], "c string")
    rows = E.top_values(df, 2, ["c"]).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in rows] == [(None, 3), ("a", 2)]


def test_histogram_counts_sum(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x")).union(
        spark.createDataFrame([(None,)], "x double"))
    h = V.histogram(df, "x", 30).collect()
    assert len(h) == 30 and sum(r["count"] for r in h) == 1000


def test_density_integrates_to_one(spark):
    df = spark.range(2000).select((F.randn(3) * 2).alias("x"))
    d = V.density_curve(df, "x", 200).orderBy("point").collect()
    step = d[1]["x"] - d[0]["x"]
    assert sum(r["density"] for r in d) * step == pytest.approx(1.0, abs=0.01)


def test_box_stats(spark):
    rows = [("a", float(v)) for v in [1, 2, 2, 3, 3, 9, 50]] + [("b", 1.0), ("b", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    s, o = V.box_stats(df, "x", "g")
    a = s.where("group = 'a'").first()
    assert (a["q1"], a["median"], a["q3"]) == (2.0, 3.0, 6.0)
    assert a["whisker_high"] == 9.0 and a["outliers"] == 1
    assert [r["value"] for r in o.collect()] == [50.0]


def test_strongest_pair_tie_row_major():
    pairs = [(0, 1, "a", "b", 0.5), (0, 2, "a", "c", -0.9), (1, 2, "b", "c", 0.9)]
    assert V.strongest_pair(pairs)[:2] == (0, 2)


def test_class_balance(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] + [(None,)], "y int")
    r = {x["class"]: x for x in E.class_balance(df, "y").collect()}
    assert r["1"]["share"] == 0.75 and r["1"]["imbalance_ratio"] == 3.0


def test_heatmap_reuses_pairs(spark):
    df = spark.createDataFrame([(float(i), 5.0, float(i * i), float(-i)) for i in range(20)],
                               "a double, k double, b double, c double")
    pairs = E.correlation_pairs(df, ["a", "k", "b", "c"])
    got = sorted(tuple(r) for r in V.heatmap_data(df, pairs).collect())
    exp = sorted(tuple(r) for r in V.heatmap_data(df).collect())
    assert [g[:4] for g in got] == [e[:4] for e in exp]
    assert all((g[4] is None and e[4] is None) or g[4] == pytest.approx(e[4]) for g, e in zip(got, exp))
    assert {r[2] for r in got} == {"a", "b", "c"}  # feature_1; the constant k is left out


def test_correlation_of_tiny_variances_in_a_wide_table(spark):
    df = spark.range(200).select(*[(F.sin(F.col("id") * (k + 1)) * 1e-7).alias(f"c{k}") for k in range(66)])
    wide = {(a, b): r for _, _, a, b, r in E.correlation_pairs(df)}
    assert len(wide) == 66 * 65 // 2 and all(r is not None for r in wide.values())
    for i, j, a, b, r in E.correlation_pairs(df, ["c0", "c1", "c65"]):
        assert r == pytest.approx(wide[(a, b)], abs=1e-9)


def test_eda_summary_has_every_column(spark):
    df = spark.range(6).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"n{i}") for i in range(17)],
                               *[F.concat(F.lit(f"c{i}_"), F.col("id") % 2).alias(f"s{i}") for i in range(17)])
    out = E.eda_summary(df)
    assert set(out["numeric_columns_summary"]) == {f"n{i}" for i in range(17)}
    assert {r["column"] for r in out["categorical_columns_summary"]} == {f"s{i}" for i in range(17)}
