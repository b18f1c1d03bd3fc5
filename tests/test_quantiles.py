import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tablewise.functions.quantiles import quantiles


def _np_quantile(vals, p):
    vals = [v for v in vals if v is not None]
    return float(np.quantile(np.asarray(vals, dtype=float), p)) if vals else None


@pytest.mark.parametrize("method", ["small", "refine"])
def test_quantiles_match_numpy(spark, method):
    rng = np.random.default_rng(1)
    vals = list(rng.lognormal(3, 2, 5000)) + [None] * 50 + [7.0] * 2000  # hot value + nulls
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles(df, ["x"], probs, method=method, buckets=16, leaf=50)[("", "x")]
    for p, g in zip(probs, got):
        assert g == pytest.approx(_np_quantile(vals, p), rel=1e-12, abs=1e-12)


def test_grouped_refine_matches_small(spark):
    rng = np.random.default_rng(2)
    rows = [(str(g), float(v)) for g in range(4) for v in rng.normal(g, 1 + g, 700)]
    rows += [("3", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    a = quantiles(df, ["x"], [0.25, 0.5, 0.75], by="g", method="small")
    b = quantiles(df, ["x"], [0.25, 0.5, 0.75], by="g", method="refine", buckets=8, leaf=20)
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-12)


def test_empty_and_constant(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 5.0)], "a double, k double")
    r = quantiles(df, ["a", "k"], [0.25, 0.75], method="refine")
    assert r[("", "a")] == [None, None]
    assert r[("", "k")] == [5.0, 5.0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=60))
def test_refine_property(spark, xs):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in xs], "x double")
    got = quantiles(df, ["x"], [0.25, 0.5, 0.75], method="refine", buckets=4, leaf=3)[("", "x")]
    for p, g in zip([0.25, 0.5, 0.75], got):
        exp = _np_quantile(xs, p)
        assert (g is None and exp is None) or g == pytest.approx(exp, abs=1e-9)


@pytest.mark.parametrize("method", ["small", "refine"])
def test_quantiles_from_counts(spark, method):
    from pyspark.sql import functions as F
    from tablewise.functions.quantiles import quantiles_from_counts
    rng = np.random.default_rng(7)
    vals = list(np.round(rng.normal(0, 3, 3000), 1)) + [2.0] * 1500
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    freq = df.groupBy(F.lit("x").alias("column"), F.col("x").alias("num_value")).count()
    probs = [0.25, 0.5, 0.75, 0.9]
    got = quantiles_from_counts(freq, ["x"], probs, method=method, buckets=8, leaf=10)[("", "x")]
    for p, g in zip(probs, got):
        assert g == pytest.approx(_np_quantile(vals, p), abs=1e-12)


def test_box_plot_by_a_key_column(spark):
    """12,000 groups, one with a third of the rows: no cap, and groups stay a table."""
    from pyspark.sql import functions as F
    from tablewise.functions.quantiles import quantile_table
    from tablewise.operators import charts as V
    hot = spark.range(18_000).select(F.lit(-1).cast("long").alias("g"), F.pmod(F.col("id") * 7919, F.lit(10_007)).cast("double").alias("x"))
    df = spark.range(36_000).select(F.pmod("id", F.lit(12_000)).alias("g"), (F.col("id") % 101).cast("double").alias("x")).unionByName(hot)
    want = {r["g"]: r["p"] for r in df.groupBy(F.col("g").cast("string").alias("g")).agg(
        F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p")).collect()}
    summary = {r["group"]: [r["q1"], r["median"], r["q3"]] for r in V.box_stats(df, "x", "g")[0].collect()}
    assert len(summary) == 12_001 and summary == want
    got = {r["group"]: r["qs"] for r in quantile_table(df, ["x"], [0.25, 0.5, 0.75], "g", leaf=500).where("group < '1'").collect()}
    assert got == {g: p for g, p in want.items() if g < "1"}


def test_infinities_are_extreme_values(spark):
    """An interval with an infinity shrinks like any other: nothing is left over to gather."""
    inf = float("inf")
    vals = [-inf] * 3 + [inf] * 4 + [1e308, -1e308, 5e-324, 0.0, -0.0] + [float(v) for v in np.random.default_rng(3).lognormal(0, 60, 400)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.98, 1.0]
    got = quantiles(df, ["x"], probs, method="refine", buckets=1024, leaf=3)[("", "x")]
    ordered = sorted(vals)
    for p, g in zip(probs, got):
        h = p * (len(vals) - 1)
        a, b = ordered[int(h)], ordered[min(int(h) + 1, len(vals) - 1)]
        assert g == (a if a == b or h == int(h) else pytest.approx(a + (b - a) * (h - int(h)), rel=1e-12))
    assert quantiles(spark.createDataFrame([(-1e308,), (1e308,), (inf,), (inf,)], "x double"), ["x"], [1 / 6, 0.5, 1.0], method="refine") == {("", "x"): [0.0, inf, inf]}


def test_only_counted_tables_are_broadcast(spark, monkeypatch):
    """Targets beyond the counted limit, here all, are merged, whatever the size of their files."""
    from pyspark.sql import functions as F
    from tablewise.functions import quantiles as Q
    monkeypatch.setattr(Q, "BROADCAST_ROWS", -1)
    plans, settle = [], Q._settle
    monkeypatch.setattr(Q, "_settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df))
    df = spark.range(6000).select(F.pmod("id", F.lit(300)).alias("g"), (F.pmod(F.col("id") * 7919, F.lit(6007)) / 8).alias("x"))
    df = df.unionByName(spark.range(2000).select(F.pmod("id", F.lit(10)).alias("g"), F.when(F.col("id") > 3, F.col("id") % 57 + 0.5).alias("x")))
    df = df.unionByName(spark.createDataFrame([(777, None), (888, 1.0)], "g long, x double"))
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    want = {r["g"]: r["p"] for r in df.groupBy(F.col("g").cast("string").alias("g")).agg(F.percentile("x", F.array(*[F.lit(p) for p in probs])).alias("p")).collect()}
    for leaf in (10, 100, 10_000):  # every group is long, some are, none is
        t = Q.quantile_table(df, ["x"], probs, "g", buckets=16, leaf=leaf)
        plans.append(t._jdf.queryExecution().executedPlan().toString())
        assert {r["group"]: r["qs"] for r in t.collect()} == want
    assert len(plans) > 6 and not [p for p in plans if "Broadcast" in p]
