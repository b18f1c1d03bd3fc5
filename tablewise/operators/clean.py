"""Single cleaning actions.

Each action is a lazy column expression once its statistic is known; the
statistics are computed by the batch helpers at the bottom (one aggregate per
kind for any number of columns), so a whole cleaning plan costs a handful of
jobs (see :mod:`tablewise.plans.cleaning`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.exprs import DATETIME_FORMATS, numeric_text, q
from tablewise.functions.quantiles import quantiles
from tablewise.functions.ranking import top_k
from tablewise.operators.profile import IQR_K
from tablewise.operators.schema import column_role

MISSING_ACTIONS = ["impute_mean", "impute_median", "impute_mode", "impute_constant", "drop", "none"]
OUTLIER_ACTIONS = ["cap_iqr", "remove", "none"]
TYPE_CONVERSIONS = ["int", "float", "str", "category", "datetime", "none"]
DEFAULT_CONSTANT = "Unknown"


def _replace(df: DataFrame, col: str, expr: Column) -> DataFrame:
    return df.select(*[expr.alias(c) if c == col else q(c) for c in df.columns])


# --- C1 ----------------------------------------------------------------------
def drop_duplicates(df: DataFrame) -> DataFrame:
    """Full-row duplicates removed (nulls group as equal). Partial-aggregated."""
    return df.dropDuplicates()


# --- C2–C6 conversions ----------------------------------------------------------
def _as_double(df: DataFrame, col: str) -> Column:
    dt = df.schema[col].dataType
    if isinstance(dt, T.NumericType):
        return q(col).cast("double")
    if isinstance(dt, T.BooleanType):
        return q(col).cast("int").cast("double")
    return numeric_text(q(col))


def convert_expr(df: DataFrame, col: str, to: str) -> Column:
    dt = df.schema[col].dataType
    if to == "int":
        # Non-numeric → NULL → 0, truncating cast (via double so '12.7' → 12).
        # Whole numbers never pass through double, so long ids stay exact.
        if isinstance(dt, T.IntegralType):
            whole = q(col).cast("bigint")
        elif isinstance(dt, T.StringType):
            whole = F.coalesce(F.when(q(col).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(q(col)).try_cast("bigint")), _as_double(df, col).try_cast("bigint"))
        else:
            whole = _as_double(df, col).try_cast("bigint")
        return F.coalesce(whole, F.lit(0).cast("bigint"))
    if to == "float":
        return _as_double(df, col)  # C3
    if to in ("str", "category"):
        return q(col).cast("string")  # C4, C5 (encoding happens in prep)
    if to == "datetime":  # C6
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            return q(col)
        if isinstance(dt, T.DateType):
            return q(col).cast("timestamp")
        s = q(col).cast("string")
        return F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt in DATETIME_FORMATS])
    if to == "none":
        return q(col)
    raise ValueError(f"unknown type conversion {to!r}")


def convert(df: DataFrame, col: str, to: str) -> DataFrame:
    return _replace(df, col, convert_expr(df, col, to))


# --- statistics (batched) -------------------------------------------------------
def null_counts(df: DataFrame, cols: list[str], extra: list[Column] | None = None):
    r = df.agg(F.count(F.lit(1)).alias("__n"),
               *[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)],
               *(extra or [])).first()
    return r


def means(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    if not cols:
        return {}
    r = df.agg(*[F.avg(q(c)).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    return {c: r[f"a{i}"] for i, c in enumerate(cols)}


def medians(df: DataFrame, cols: list[str], stats: dict | None = None) -> dict[str, float | None]:
    if not cols:
        return {}
    qs = quantiles(df, cols, [0.5], stats=stats)
    return {c: qs[("", c)][0] for c in cols}


def modes(df: DataFrame, cols: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column; ties → smallest value.

    One frequency table for all columns, then a group-limited top-1 per column
    (partial limit before the shuffle), so no column's distinct values are
    gathered in one task.
    """
    if not cols:
        return {}
    items = []
    for c in cols:
        whole = isinstance(df.schema[c].dataType, T.IntegralType)  # kept exact beyond 2^53
        numeric = isinstance(df.schema[c].dataType, T.NumericType) and not whole
        items.append(F.struct(F.lit(c).alias("column"),
                              (q(c).cast("bigint") if whole else F.lit(None).cast("bigint")).alias("iv"),
                              (q(c).cast("double") if numeric else F.lit(None).cast("double")).alias("nv"),
                              (F.lit(None).cast("string") if whole or numeric else q(c).cast("string")).alias("sv")))
    long = df.select(F.inline(F.array(*items))).where(F.col("iv").isNotNull() | F.col("nv").isNotNull() | F.col("sv").isNotNull())
    freq = long.groupBy("column", "iv", "nv", "sv").agg(F.count(F.lit(1)).alias("cnt"))
    best = top_k(freq, ["column"], [F.desc("cnt"), F.asc_nulls_last("iv"), F.asc_nulls_last("nv"), F.asc_nulls_last("sv")], 1)
    out: dict = {c: None for c in cols}
    for r in best.collect():  # ≤ one row per column
        out[r["column"]] = next((r[k] for k in ("iv", "nv", "sv") if r[k] is not None), None)
    return out


def bounds(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """(lower, upper) IQR fences per column, exact quartiles."""
    if not cols:
        return {}
    qs = quantiles(df, cols, [0.25, 0.75])
    out = {}
    for c in cols:
        q1, q3 = qs[("", c)]
        out[c] = (None, None) if q1 is None else (q1 - IQR_K * (q3 - q1), q3 + IQR_K * (q3 - q1))
    return out


# --- C7–C11 imputation ------------------------------------------------------------
def fill_expr(df: DataFrame, col: str, value) -> Column:
    """Null → value, keeping a numeric column numeric when the value is a number."""
    dt = df.schema[col].dataType
    if value is None:
        return q(col)
    if isinstance(dt, T.NumericType):
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            lit = F.lit(value)
            if isinstance(value, float) and isinstance(dt, T.IntegralType):
                return F.coalesce(q(col).cast("double"), lit)  # mean of ints is a float
            return F.coalesce(q(col), lit.cast(dt))
        # A constant that is a number keeps the column numeric; other text widens it.
        try:
            int(str(value))
            return F.coalesce(q(col), F.lit(str(value)).try_cast(dt))
        except ValueError:
            pass
        try:
            number = float(str(value))
            return F.coalesce(q(col).cast("double") if isinstance(dt, T.IntegralType) else q(col), F.lit(number))
        except ValueError:
            return F.coalesce(q(col).cast("string"), F.lit(str(value)))
    if isinstance(dt, T.BooleanType):
        return F.coalesce(q(col), F.lit(value).cast("boolean"))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.coalesce(q(col), F.lit(value).cast(dt))
    return F.coalesce(q(col), F.lit(str(value)))


def _require_numeric(df: DataFrame, col: str, action: str):
    if column_role(df.schema[col].dataType) != "numeric":
        raise TypeError(f"{action} needs a numeric column; '{col}' is {df.schema[col].dataType.simpleString()}")


def impute_mean(df: DataFrame, col: str) -> DataFrame:
    """C7."""
    _require_numeric(df, col, "impute_mean")
    m = means(df, [col])[col]
    return _replace(df, col, fill_expr(df, col, float(m)) if m is not None else q(col))


def impute_median(df: DataFrame, col: str) -> DataFrame:
    """Exact interpolated median."""
    _require_numeric(df, col, "impute_median")
    m = medians(df, [col])[col]
    return _replace(df, col, fill_expr(df, col, float(m)) if m is not None else q(col))


def impute_mode(df: DataFrame, col: str) -> DataFrame:
    """Most frequent value, smallest on ties; an all-null column is left alone."""
    m = modes(df, [col])[col]
    return _replace(df, col, fill_expr(df, col, m))


def impute_constant(df: DataFrame, col: str, value: str | None = None) -> DataFrame:
    """Given constant, or "Unknown" when absent or empty."""
    return _replace(df, col, fill_expr(df, col, value or DEFAULT_CONSTANT))


def drop_nulls(df: DataFrame, col: str) -> DataFrame:
    """C11."""
    return df.where(q(col).isNotNull())


# --- C12, C13 outliers ------------------------------------------------------------
def cap_expr(col: str, lo: float, hi: float) -> Column:
    """C12 as an expression: NULL stays NULL (``greatest`` alone would return lo)."""
    c = q(col).cast("double")
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def outside(col: str, lo: float, hi: float) -> Column:
    return (q(col) < F.lit(lo)) | (q(col) > F.lit(hi))


def cap_iqr(df: DataFrame, col: str) -> DataFrame:
    """Clip to the IQR fences; applies to any numeric column; result is double."""
    _require_numeric(df, col, "cap_iqr")
    lo, hi = bounds(df, [col])[col]
    if lo is None:
        return df
    return _replace(df, col, cap_expr(col, lo, hi))


def remove_outliers(df: DataFrame, col: str) -> DataFrame:
    """Drop rows outside the fences; rows with NULL stay."""
    _require_numeric(df, col, "remove")
    lo, hi = bounds(df, [col])[col]
    if lo is None:
        return df
    return df.where(~F.coalesce(outside(col, lo, hi), F.lit(False)))
