"""Reusable column expressions (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: text accepted as a number. Same pattern is used by the DuckDB
# oracle so both engines agree ('5d' is not a number, '1_000' is not either).
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Text read as missing by the CSV loader (pandas default tokens).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]

# Timestamp formats tried, in order, by the datetime conversion.
DATETIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd",
                    "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy"]


def q(name: str) -> Column:
    """Column reference safe for names with dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DoubleType, T.FloatType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas treats NaN as missing; Spark does not. Normalise once at load."""
    cols = []
    for f in df.schema.fields:
        if is_floating(f.dataType):
            cols.append(F.when(F.isnan(q(f.name)), F.lit(None)).otherwise(q(f.name)).alias(f.name))
        else:
            cols.append(q(f.name))
    return df.select(*cols)


def numeric_text(c: Column) -> Column:
    """Text → double where the text is a plain number, else NULL."""
    s = c.cast("string")
    return F.when(s.rlike(NUMERIC_PATTERN), F.trim(s).try_cast("double"))


def to_double(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.NumericType):
        return c.cast("double")
    if isinstance(dt, T.BooleanType):
        return c.cast("int").cast("double")
    return numeric_text(c)


def safe_corr(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson r; NULL on constant input instead of an error."""
    sxy = F.regr_sxy(b, a)
    sxx = F.regr_sxx(b, a)
    syy = F.regr_syy(b, a)
    return F.try_divide(sxy, F.sqrt(sxx * syy))


def skew_g1(c: Column) -> Column:
    """Bias-corrected sample skewness (pandas .skew(), DuckDB skewness)."""
    n = F.count(c).cast("double")
    g = F.skewness(c)
    return F.when(n >= 3, g * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_excess(c: Column) -> Column:
    """Bias-corrected excess kurtosis (pandas .kurt())."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)  # population excess kurtosis
    return F.when(n >= 4, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


def hash_percent(key: Column) -> Column:
    """Repeatable 0..99 bucket of a key; same value in DuckDB via md5."""
    h = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(100))


def chunks(seq, size):
    seq = list(seq)
    for i in range(0, len(seq), size):
        yield seq[i:i + size]
