import pytest

from tablewise.operators import profile as P
from tablewise.operators import schema as S
from tablewise.queries import QUERIES
from conftest import SF001


def nulls_in_numeric(spark):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in [1, 2, 2, 3, 3, 9, 50, None]],
                                 "x double")


def test_iqr_bounds_and_outliers(spark):
    df = nulls_in_numeric(spark)
    q1, q3, lo, hi = P.iqr_bounds(df, ["x"])["x"]
    assert (q1, q3) == (2.0, 6.0)
    assert (lo, hi) == (-4.0, 12.0)
    rows = {r["column"]: r for r in P.profile_columns(df)}
    assert rows["x"]["missing_count"] == 1
    assert rows["x"]["unique_count"] == 5
    assert rows["x"]["outlier_count"] == 0  # 5 distinct values: outliers are only counted above 5


def test_outliers_need_more_than_five_distinct(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100, 100]], "x double")
    assert {r["column"]: r for r in P.profile_columns(df)}["x"]["outlier_count"] == 0


def test_duplicates_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a")], "a int, b string")
    assert P.duplicate_rows(df).first()["duplicate_rows"] == 3


def test_missing_on_empty_table(spark):
    df = spark.createDataFrame([], "a double")
    r = P.missing(df).first()
    assert r["missing_count"] == 0 and r["missing_pct"] is None


def test_schema_roles_and_target():
    assert S.guess_target(["CustomerID", "Monthly_Charge", "Churn"]) == "Churn"
    assert S.guess_target(["HouseID", "House_Price"]) == "House_Price"
    assert S.guess_target(["a", "b"]) is None


def test_problem_type(spark):
    df = spark.createDataFrame([(1, 0.5, "a", True), (2, 1.5, "b", None), (None, 2.5, None, False)],
                               "i long, d double, s string, b boolean")
    assert S.detect_problem_type(df, None) == "clustering"
    assert S.detect_problem_type(df, "i") == "classification"  # int target with nulls stays classification
    assert S.detect_problem_type(df, "d") == "regression"
    assert S.detect_problem_type(df, "s") == "classification"
    assert S.detect_problem_type(df, "b") == "classification"


def test_profile_query_smoke(spark):
    df = QUERIES["profile_lineitem"](spark, SF001)
    assert df.count() == 11
