"""Column roles, target guess, schema table, problem type, constants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.exprs import q

# Target keywords, tried in this order (keyword order dominates column order).
TARGET_KEYWORDS = ["churn", "price", "house_price", "target", "label"]

# Literal meaning "no target" in the user interface.
NO_TARGET = "None (Clustering)"


def column_role(dt: T.DataType) -> str:
    if isinstance(dt, T.NumericType):
        return "numeric"
    if isinstance(dt, (T.StringType, T.BooleanType, T.DateType, T.TimestampType,
                       T.TimestampNTZType, T.CharType, T.VarcharType)):
        return "categorical"
    return "other"


def column_roles(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) column names in schema order. No data scan."""
    num, cat = [], []
    for f in df.schema.fields:
        r = column_role(f.dataType)
        if r == "numeric":
            num.append(f.name)
        elif r == "categorical":
            cat.append(f.name)
    return num, cat


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def target_rank(name: str) -> int | None:
    low = name.lower()
    for i, k in enumerate(TARGET_KEYWORDS):
        if k in low:
            return i + 1
    return None


def guess_target(columns: list[str]) -> str | None:
    """First keyword that any column contains; the first such column wins."""
    for k in TARGET_KEYWORDS:
        for c in columns:
            if k in c.lower():
                return c
    return None


def schema_table(df: DataFrame) -> DataFrame:
    """Column, dtype, role, target_rank, missing_count, missing_pct (2 dp).

    One aggregate pass; the result has one row per column.
    """
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__n")] + [
        F.count_if(q(f.name).isNull()).alias(f"m{i}") for i, f in enumerate(fields)]
    counts = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).cast("int").alias("position"), F.lit(f.name).alias("column"),
                              F.lit(f.dataType.simpleString()).alias("dtype"),
                              F.lit(column_role(f.dataType)).alias("role"),
                              F.lit(target_rank(f.name)).cast("int").alias("target_rank"),
                              F.col(f"m{i}").cast("bigint").alias("missing_count"))
                     for i, f in enumerate(fields)])
    out = counts.select(F.col("__n"), F.inline(rows))
    return out.select("position", "column", "dtype", "role", "target_rank", "missing_count",
                      F.round(F.try_divide(F.col("missing_count") * F.lit(100.0), F.col("__n")), 2)
                      .alias("missing_pct"))


def detect_problem_type(df: DataFrame, target: str | None) -> str:
    """T4: clustering / classification / regression."""
    if not target or target == NO_TARGET or target not in df.columns:
        return "clustering"
    dt = df.schema[target].dataType
    if isinstance(dt, (T.StringType, T.BooleanType, T.CharType, T.VarcharType)):
        return "classification"
    if is_integral(dt):
        # Exact distinct count, partial-aggregated; only ≤11 rows are needed.
        n = df.select(q(target)).where(q(target).isNotNull()).distinct().limit(11).count()
        return "classification" if n <= 10 else "regression"
    if isinstance(dt, T.NumericType):
        return "regression"
    return "classification"


def non_constant_numeric(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """T5: numeric columns with more than one distinct non-null value."""
    if cols is None:
        cols, _ = column_roles(df)
    if not cols:
        return []
    r = df.agg(*[(F.min(q(c)) != F.max(q(c))).alias(f"k{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if r[f"k{i}"]]
