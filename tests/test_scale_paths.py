"""The large-data code paths give the same answers as the small-data ones."""

import functools

import pytest

import tablewise.functions.quantiles as Q
from tablewise.operators import charts as V
from tablewise.operators import eda as E
from tablewise.operators import profile as P
from tablewise.sources.fixtures import dirty_orders, table
from conftest import SF001


def _force_refine(monkeypatch):
    monkeypatch.setattr(Q, "quantiles_from_counts",
                        functools.partial(Q.quantiles_from_counts, method="refine", buckets=16, leaf=8))
    monkeypatch.setattr(Q, "quantiles", functools.partial(Q.quantiles, method="refine", buckets=16, leaf=8))
    for mod in (E, V):
        monkeypatch.setattr(mod, "quantiles", Q.quantiles)


def test_profile_refine_equals_default(spark, monkeypatch):
    df = dirty_orders(spark, SF001)
    base = P.profile_columns(df)
    _force_refine(monkeypatch)
    forced = P.profile_columns(df)
    for a, b in zip(base, forced):
        for k in ("q1", "q3", "outlier_count", "unique_count", "missing_count", "sample_values"):
            assert a[k] == pytest.approx(b[k]) if isinstance(a[k], float) else a[k] == b[k]


def test_describe_and_box_refine_equal_default(spark, monkeypatch):
    li = table(spark, SF001, "lineitem")
    base = E.describe_rows(li, ["l_quantity", "l_extendedprice", "l_discount"])
    bsum = {r["group"]: r for r in V.box_stats(li, "l_extendedprice", "l_returnflag")[0].collect()}
    _force_refine(monkeypatch)
    forced = E.describe_rows(li, ["l_quantity", "l_extendedprice", "l_discount"])
    fsum = {r["group"]: r for r in V.box_stats(li, "l_extendedprice", "l_returnflag")[0].collect()}
    for a, b in zip(base, forced):
        assert (a["q25"], a["q50"], a["q75"]) == pytest.approx((b["q25"], b["q50"], b["q75"]))
    for g in bsum:
        assert (bsum[g]["q1"], bsum[g]["median"], bsum[g]["q3"]) == pytest.approx(
            (fsum[g]["q1"], fsum[g]["median"], fsum[g]["q3"]))
        assert bsum[g]["outliers"] == fsum[g]["outliers"]


def test_engineered_features_read_the_join_once(spark):
    """The joined features are written once; each step reads that table."""
    from tablewise.queries import QUERIES
    files = QUERIES["apply_features"](spark, SF001).inputFiles()
    assert files and all("order-features-" in f for f in files)


def test_training_rows_are_spread(spark):
    """Rows that lie in one partition are trained on by all cores, with and without a key, and none is lost."""
    from tablewise.operators import models as M
    rows = [(i, float(i % 7), "ab"[i % 2], float(3 * (i % 7) + i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "`the id` int, x double, c string, y double").coalesce(1)
    for key in ("the id", None):
        run = M.train_supervised(df, "y", key=key, candidates=["Linear Regression"])
        assert run.train.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
        assert run.train.count() + run.test.count() == 200 and not run.failures
    from tablewise.session import persist_spread
    nulls = persist_spread(df.selectExpr("cast(null as int) k", "x", "c", "y"), "k")
    assert max(nulls.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) < 100
    assert M.train_supervised(df.repartition(16), "y", key="the id", candidates=["Linear Regression"]).train.rdd.getNumPartitions() == 16
