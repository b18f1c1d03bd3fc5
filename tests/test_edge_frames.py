"""FIXTURES.md F6 edge frames not covered elsewhere."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablewise.functions.exprs import nan_to_null
from tablewise.operators import clean as C
from tablewise.operators import eda as E
from tablewise.operators import models as M
from tablewise.operators import schema as S


def test_nan_column_normalised(spark):
    df = nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"))
    assert df.where(F.col("x").isNull()).count() == 2
    assert df.agg(F.avg("x")).first()[0] == 1.0


def test_all_null_median_and_mode_untouched(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    assert C.medians(df, ["x"])["x"] is None
    assert C.impute_median(df, "x").where(F.col("x").isNull()).count() == 2
    assert C.impute_mode(df, "s").where(F.col("s").isNull()).count() == 2


def test_bool_column_roles_and_target(spark):
    df = spark.createDataFrame([(True, 1.0), (False, 2.0), (None, 3.0), (True, 4.0)], "b boolean, x double")
    num, cat = S.column_roles(df)
    assert num == ["x"] and cat == ["b"]
    assert S.detect_problem_type(df, "b") == "classification"
    info = E.target_info(df, "b").first()  # booleans count as numeric here: mean of 1/0
    assert info["mean"] == pytest.approx(2 / 3)


def test_tiny_frames(spark):
    import numpy as np
    for n in range(4):
        df = spark.createDataFrame([(float(i),) for i in range(n)], "x double")
        r = E.skewness(df, ["x"]).first()
        assert (r["skewness"] is None) if n < 3 else r["skewness"] == pytest.approx(0.0)
        med = C.medians(df, ["x"])["x"]
        assert med == (None if n == 0 else float(np.median(np.arange(n))))
    empty = spark.createDataFrame([], "x double")
    from tablewise.operators.profile import missing
    assert missing(empty).first()["missing_pct"] is None


def test_kmeans_too_few_rows(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([2.0, 1.0],)], "e array<double>").select(
        array_to_vector("e").alias("features"))
    with pytest.raises(ValueError):
        M.kmeans_search(df, restarts=1)
