import datetime

import pytest
from pyspark.sql import functions as F

from tablewise.operators import vocabulary as VO


def codes_of(v, column):
    return {r["value"]: (r["code"], r["n"]) for r in v.values(column).collect()}


def test_codes_follow_value_order_over_many_ranges(spark):
    df = spark.range(30_000).select(F.concat(F.lit("v"), F.pmod(F.col("id") * 7919, F.lit(9_973)).cast("string")).alias("a b"),
                                    F.when(F.col("id") % 3 == 0, "é").when(F.col("id") % 3 == 1, "hot").alias("c.d"), F.lit(None).cast("string").alias("none"))
    v = VO.fit_vocabulary(df, ["a b", "c.d", "none"])
    assert v.sizes == [9_973, 2, 0]
    got = codes_of(v, "a b")
    assert [x for x, _ in sorted(got.items(), key=lambda kv: kv[1][0])] == sorted(f"v{i}" for i in range(9_973))
    assert sorted(c for c, _ in got.values()) == list(range(9_973)) and sum(n for _, n in got.values()) == 30_000
    assert codes_of(v, "c.d") == {"hot": (0, 10_000), "é": (1, 10_000)}


@pytest.mark.parametrize("share", [2, 10_000_000])
def test_encode_hot_and_cold_values(spark, monkeypatch, share):
    monkeypatch.setattr(VO, "HOT", share)  # nothing but the largest values, or all of them, are broadcast
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 40}", None if i % 5 else "x", 1) for i in range(600)], "id long, a string, b string, __code0 int")
    v = VO.fit_vocabulary(df, ["a", "b"])
    other = df.unionByName(spark.createDataFrame([(900, "unseen", "x", 1)] * 3, df.schema))
    got = VO.encode(other, v, ["ka", "kb"]).collect()
    codes = {x: i for i, x in enumerate(sorted({r["a"] for r in df.collect()}))}
    assert len(got) == 603 and all(r["ka"] == codes.get(r["a"]) and r["kb"] == (0 if r["b"] else None) for r in got)


def test_typed_labels_keep_their_order(spark):
    df = spark.createDataFrame([(10,), (9,), (None,), (-3,), (100,), (9,)], "t int")
    v = VO.fit_vocabulary(df, ["t"], as_string=False)
    assert codes_of(v, "t") == {-3: (0, 1), 9: (1, 2), 10: (2, 1), 100: (3, 1)}
    days = spark.createDataFrame([(datetime.date(2020, 1, i),) for i in (3, 1, 2)], "d date")
    assert [r["label"] for r in VO.encode(days, VO.fit_vocabulary(days, ["d"], as_string=False), ["label"], as_string=False).orderBy("d").collect()] == [0, 1, 2]


def test_one_hot_vectors(spark):
    df = spark.createDataFrame([(1, "b", 0.5, "p"), (2, None, None, "q"), (3, "a", 0.0, None)], "id int, `c.s` string, x double, __k0 string")
    v = VO.fit_vocabulary(df, ["c.s", "__k0"])
    got = {r["id"]: r for r in VO.one_hot(df, v, [F.col("x")]).collect()}
    assert {i: dict(zip(r["features"].indices.tolist(), r["features"].values.tolist())) for i, r in got.items()} == {1: {0: 0.5, 2: 1.0, 3: 1.0}, 2: {4: 1.0}, 3: {1: 1.0}}
    assert got[1]["c.s"] == "b" and got[1]["features"].size == 5
    assert {r["slot"]: r["name"] for r in v.names(1).collect()} == {1: "c.s_a", 2: "c.s_b", 3: "__k0_p", 4: "__k0_q"}
    unseen = VO.one_hot(spark.createDataFrame([(9, "zz", 2.0, "p")], df.schema), v).first()["features"]
    assert unseen.indices.tolist() == [2] and unseen.size == 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, x double")
    v = VO.fit_vocabulary(df, ["a"])
    assert v.sizes == [0] and VO.one_hot(df, v, [F.col("x")]).count() == 0
