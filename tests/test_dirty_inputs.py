"""Long ids, null keys, empty columns, quoted CSV fields and numeric constants."""

import os

from pyspark.sql import functions as F

from tablewise import session as SS
from tablewise.operators import clean as C
from tablewise.operators import eda as E
from tablewise.operators import prep as PR
from tablewise.operators import profile as P
from tablewise.plans import cleaning as CP
from tablewise.sources import io


def test_integers_stay_exact(spark):
    big = 2 ** 53 + 1
    df = spark.createDataFrame([(big, str(big)), (None, "12.7"), (3, "x")], "i long, s string")
    got = df.select(C.convert_expr(df, "i", "int").alias("i"), C.convert_expr(df, "s", "int").alias("s")).collect()
    assert [tuple(r) for r in got] == [(big, big), (0, 12), (3, 0)]


def test_numeric_constant_keeps_the_type(spark):
    df = spark.createDataFrame([(1,), (None,)], "i int")
    assert dict(df.select(C.fill_expr(df, "i", "0").alias("i")).dtypes) == {"i": "int"}
    assert dict(df.select(C.fill_expr(df, "i", "0.5").alias("i")).dtypes) == {"i": "double"}
    assert dict(df.select(C.fill_expr(df, "i", "none").alias("i")).dtypes) == {"i": "string"}


def test_empty_text_column_has_cardinality_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "x string, y string")
    assert {r.column: r.cardinality for r in E.cardinality(df).collect()} == {"x": 2, "y": 0}


def test_split_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (None,)], "k long")
    train, test = PR.hash_split(df, "k")
    assert train.count() + test.count() == 4


def test_csv_quotes_lines_and_long_numbers(spark):
    folder = SS.scratch_path(spark, "csv-quotes")
    os.makedirs(folder.removeprefix("file:"), exist_ok=True)
    with open(os.path.join(folder.removeprefix("file:"), "t.csv"), "w") as f:
        f.write('id,t,n\n1,"say ""hi"" now",12345678901234567890\n2,"two\nlines",1\n')
    got = io.read_csv(spark, folder, multi_line=True)
    assert [r.t for r in got.orderBy("id").collect()] == ['say "hi" now', "two\nlines"]
    assert dict(got.dtypes)["n"] == "double" and got.where("n is null").count() == 0


def test_long_ids_in_mode_profile_and_samples(spark):
    b = 2 ** 53
    df = spark.createDataFrame([(x,) for x in (b, b + 1, b + 1, b + 2, 2 ** 63 - 1, 1, -b - 1, -b - 2, None)], "i long")
    assert C.modes(df, ["i"]) == {"i": b + 1}
    assert P.nunique(df) == {"i": 7}
    assert P.sample_values(df, 7)["i"] == [str(x) for x in (-b - 2, -b - 1, 1, b, b + 1, b + 2, 2 ** 63 - 1)]


def test_every_category_is_encoded_and_odd_names_pass(spark):
    df = spark.range(1500).select(F.concat(F.lit("c"), "id").alias("a.b"), F.lit(None).cast("string").alias("nothing"),
                                  F.lit("x").alias("one `q`"), F.col("id").cast("double").alias("Customer ID"))
    pre = PR.fit_preprocessor(df, ["Customer ID"], ["a.b", "nothing", "one `q`"])
    assert pre.excluded == ["nothing"]
    assert len(pre.feature_names) == 1 + 1500 + 1
    got = pre.transform(df).select("features").first()[0]
    assert got.size == 1502


def test_labels_have_no_class_limit(spark):
    df = spark.range(1200).select(F.when(F.col("id") > 0, F.col("id")).alias("t.x"))
    out, labels = PR.label_encode(df, "t.x")
    assert labels == list(range(1, 1200))
    assert out.where("label = `t.x` - 1").count() == 1199 and out.where("label is null").count() == 1
    assert PR.drop_null_target(df, "t.x").count() == C.drop_nulls(df, "t.x").count() == 1199


def test_second_step_on_a_column_finds_nothing_to_fill(spark):
    df = spark.createDataFrame([(1.0,), (None,), (5.0,), (6.0,)], "v double")
    plan = CP.CleaningPlan(columns=[CP.ColumnStrategy("v", missing_value_action=a) for a in ("impute_mean", "impute_median")])
    got = CP.apply_plan(df, plan)
    assert [x["action"] for x in got.log] == ["impute_mean"]
