"""Table and column profiling.

Plan shape (three data-dependent jobs, everything else bounded):

1. one wide aggregate: row count, null count per column;
2. one long frequency table ``(column, value) → count`` built by unpivoting
   every column (numbers stay doubles, other values become text). It is
   partial-aggregated before its shuffle, so a hot value costs one row per map
   task. From it: distinct counts, sample values (3 smallest, via a
   group-limited window), modes and top values;
3. quartiles of the numeric columns with more than 5 distinct values
   (:mod:`tablewise.functions.quantiles`), then one aggregate counting values
   outside the fences, the fences being literals.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.exprs import q
from tablewise.functions.quantiles import quantiles
from tablewise.functions.ranking import top_k
from tablewise.operators.schema import column_role, is_integral

OUTLIER_MIN_DISTINCT = 5
IQR_K = 1.5
EXACT = 2 ** 53  # below this, doubles hold all whole numbers
LEAST = Decimal(-2 ** 63)


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns)."""
    return df.count(), len(df.columns)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each full-row group (nulls compare equal).

    One partial-aggregated shuffle on all columns; a group holding a third of
    the table is pre-counted map-side and arrives as one row per task.
    """
    g = df.groupBy(*[q(c) for c in df.columns]).count()
    return g.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def missing(df: DataFrame) -> DataFrame:
    """Per column null count and 100·nulls/rows (NULL on an empty table)."""
    fields = df.schema.fields
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(q(f.name).isNull()).alias(f"m{i}") for i, f in enumerate(fields)])
    arr = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"m{i}").cast("bigint").alias("missing_count"))
                    for i, f in enumerate(fields)])
    return agg.select("__n", F.inline(arr)).select(
        "column", "missing_count",
        F.try_divide(F.col("missing_count") * F.lit(100.0), F.col("__n")).alias("missing_pct"))


def frequency_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Long frequency table: (column, num_value, str_value, count), nulls dropped.

    Numeric columns keep a double value (numeric order, no text formatting);
    other columns are carried as text. Whole numbers that a double may not hold
    exactly also carry their distance from the least bigint as 20 digits, which
    tells them apart and sorts like them.
    """
    cols = cols if cols is not None else [f.name for f in df.schema.fields
                                          if column_role(f.dataType) != "other"]
    if not cols:
        schema = "column string, num_value double, str_value string, count bigint"
        return df.sparkSession.createDataFrame([], schema)
    items = []
    for c in cols:
        dt = df.schema[c].dataType
        if column_role(dt) == "numeric":
            digits = F.lit(None).cast("string")
            if is_integral(dt):
                v = q(c).cast("bigint")
                digits = F.when((v >= EXACT) | (v <= -EXACT), F.lpad((v.cast("decimal(20,0)") - F.lit(LEAST)).cast("string"), 20, "0"))
            items.append(F.struct(F.lit(c).alias("column"), q(c).cast("double").alias("num_value"),
                                  digits.alias("str_value")))
        else:
            items.append(F.struct(F.lit(c).alias("column"), F.lit(None).cast("double").alias("num_value"),
                                  q(c).cast("string").alias("str_value")))
    long = df.select(F.inline(F.array(*items)))
    long = long.where(F.col("num_value").isNotNull() | F.col("str_value").isNotNull())
    return long.groupBy("column", "num_value", "str_value").agg(F.count(F.lit(1)).alias("count"))


def nunique(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> dict[str, int]:
    """Distinct non-null values per column (bounded dict)."""
    cols = cols if cols is not None else df.columns
    if approx:
        r = df.agg(*[F.approx_count_distinct(q(c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
        return {c: r[f"d{i}"] for i, c in enumerate(cols)}
    return distinct_and_samples(df, cols, 0)[0]


def sample_values(df: DataFrame, k: int = 3, cols: list[str] | None = None) -> dict[str, list[str]]:
    """P5: k smallest distinct non-null values per column, as text.

    Row order is not part of the data model, so "first k" becomes "smallest k".
    """
    cols = cols if cols is not None else df.columns
    return distinct_and_samples(df, cols, k)[1]


def distinct_and_samples(df: DataFrame, cols: list[str], k: int = 3, ft: DataFrame | None = None,
                         non_null: dict | None = None) -> tuple[dict, dict]:
    """P4 + P5 from one frequency table in one job (its exchange is reused)."""
    if not cols:
        return {}, {}
    ft = ft if ft is not None else frequency_table(df, cols)
    # Both branches keep ``count`` alive so their plans match and the
    # frequency-table exchange is computed once (ReusedExchange).
    counts = ft.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"),
                                      F.sum("count").alias("non_null"))
    integral = [c for c in cols if is_integral(df.schema[c].dataType)]
    text = (F.when(F.col("num_value").isNull(), F.col("str_value"))
            .when(F.col("column").isin(integral) if integral else F.lit(False),
                  F.coalesce((F.col("str_value").try_cast("decimal(20,0)") + F.lit(LEAST)).cast("decimal(20,0)").cast("string"),
                             F.col("num_value").cast("bigint").cast("string")))
            .otherwise(F.col("num_value").cast("string")))
    if k > 0:
        picked = top_k(ft, ["column"], [F.col("num_value").asc_nulls_last(),
                                        F.col("str_value").asc_nulls_last()], k)
        picked = picked.groupBy("column").agg(
            F.sort_array(F.collect_list(F.struct("rank", text.alias("t"), "count"))).alias("s"))
        res = [r.asDict() for r in counts.join(picked, "column", "left").collect()]  # one row per column
    else:
        res = [r.asDict() for r in counts.select("column", "unique_count", "non_null",
                                                 F.lit(None).alias("s")).collect()]
    uniq = {c: 0 for c in cols}
    samples: dict[str, list[str]] = {c: [] for c in cols}
    for r in res:
        uniq[r["column"]] = int(r["unique_count"])
        samples[r["column"]] = [x["t"] for x in (r["s"] or [])]
        if non_null is not None and "non_null" in r:
            non_null[r["column"]] = int(r["non_null"] or 0)
    return uniq, samples


def iqr_bounds(df: DataFrame, cols: list[str], method: str = "auto") -> dict[str, tuple]:
    """{col: (q1, q3, lower, upper)} with linear-interpolated quartiles."""
    if not cols:
        return {}
    qs = quantiles(df, cols, [0.25, 0.75], method=method)
    out = {}
    for c in cols:
        q1, q3 = qs[("", c)]
        if q1 is None:
            out[c] = (None, None, None, None)
            continue
        iqr = q3 - q1
        out[c] = (q1, q3, q1 - IQR_K * iqr, q3 + IQR_K * iqr)
    return out


def outlier_counts(df: DataFrame, bounds: dict[str, tuple]) -> dict[str, int]:
    """P7 (second half): values strictly outside the fences, one aggregate."""
    usable = [(c, b) for c, b in bounds.items() if b[2] is not None]
    if not usable:
        return {c: 0 for c in bounds}
    r = df.agg(*[F.count_if((q(c) < F.lit(b[2])) | (q(c) > F.lit(b[3]))).alias(f"o{i}")
                 for i, (c, b) in enumerate(usable)]).first()
    out = {c: 0 for c in bounds}
    for i, (c, _) in enumerate(usable):
        out[c] = int(r[f"o{i}"])
    return out


PROFILE_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("missing_count", T.LongType()),
    T.StructField("missing_pct", T.DoubleType()),
    T.StructField("unique_count", T.LongType()),
    T.StructField("sample_values", T.StringType()),
    T.StructField("outlier_count", T.LongType()),
    T.StructField("q1", T.DoubleType()),
    T.StructField("q3", T.DoubleType()),
    T.StructField("lower_bound", T.DoubleType()),
    T.StructField("upper_bound", T.DoubleType()),
])


def profile_columns(df: DataFrame, approx: bool = False) -> list[dict]:
    """P8 as bounded driver data: one dict per column.

    Exact mode builds the frequency table once (persisted) and derives every
    statistic from it: null counts (rows − Σcount), distinct counts and
    samples (one job) and outlier counts (one aggregate). The raw rows are scanned
    for a count, the frequency table itself and the wide aggregates of the
    quartiles (no shuffle of rows).
    """
    if approx:
        return _profile_columns_approx(df)
    from pyspark import StorageLevel
    fields = list(df.schema.fields)
    prof_cols = [f.name for f in fields if column_role(f.dataType) != "other"]
    other = [f.name for f in fields if column_role(f.dataType) == "other"]
    n = df.count()
    nulls = {}
    if other:
        r = df.agg(*[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(other)]).first()
        nulls.update({c: r[f"m{i}"] for i, c in enumerate(other)})
    ft = frequency_table(df, prof_cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        non_null: dict = {}
        uniq, samples = distinct_and_samples(df, prof_cols, 3, ft=ft, non_null=non_null)
        nulls.update({c: n - non_null.get(c, 0) for c in prof_cols})
        numeric = [f.name for f in fields if column_role(f.dataType) == "numeric"
                   and uniq.get(f.name, 0) > OUTLIER_MIN_DISTINCT]
        qs = quantiles(df, numeric, [0.25, 0.75], stats={c: (non_null.get(c, 0), None, None) for c in numeric})
        bounds = {}
        for c in numeric:
            q1, q3 = qs[("", c)]
            bounds[c] = (q1, q3, q1 - IQR_K * (q3 - q1), q3 + IQR_K * (q3 - q1))
        outl = {}
        if numeric:
            v = F.col("num_value")
            r = ft.agg(*[F.sum(F.when((F.col("column") == c) & ((v < F.lit(b[2])) | (v > F.lit(b[3]))),
                                      F.col("count")).otherwise(0)).alias(f"o{i}")
                         for i, (c, b) in enumerate(bounds.items())]).first()
            outl = {c: int(r[f"o{i}"] or 0) for i, c in enumerate(bounds)}
    finally:
        ft.unpersist()
    return _rows(fields, n, nulls, uniq, samples, outl, bounds)


def _rows(fields, n, nulls, uniq, samples, outl, bounds):
    rows = []
    for i, f in enumerate(fields):
        m = nulls.get(f.name, 0)
        b = bounds.get(f.name, (None, None, None, None))
        rows.append(dict(position=i, column=f.name, dtype=f.dataType.simpleString(),
                         role=column_role(f.dataType), missing_count=int(m),
                         missing_pct=(100.0 * m / n) if n else None,
                         unique_count=int(uniq.get(f.name, 0)),
                         sample_values=", ".join(samples.get(f.name, [])),
                         outlier_count=int(outl.get(f.name, 0)),
                         q1=b[0], q3=b[1], lower_bound=b[2], upper_bound=b[3]))
    return rows


def _profile_columns_approx(df: DataFrame) -> list[dict]:
    """Sketch-based profile: approximate distinct counts and quartiles."""
    fields = list(df.schema.fields)
    cols = [f.name for f in fields]
    r1 = df.agg(F.count(F.lit(1)).alias("__n"),
                *[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    prof_cols = [f.name for f in fields if column_role(f.dataType) != "other"]
    uniq = nunique(df, prof_cols, approx=True)
    samples = sample_values(df, 3, prof_cols)
    numeric = [f.name for f in fields if column_role(f.dataType) == "numeric"
               and uniq.get(f.name, 0) > OUTLIER_MIN_DISTINCT]
    bounds = _approx_bounds(df, numeric)
    outl = outlier_counts(df, bounds) if numeric else {}
    nulls = {c: r1[f"m{i}"] for i, c in enumerate(cols)}
    return _rows(fields, r1["__n"], nulls, uniq, samples, outl, bounds)


def _approx_bounds(df: DataFrame, cols: list[str], accuracy: int = 10_000) -> dict[str, tuple]:
    if not cols:
        return {}
    r = df.agg(*[F.percentile_approx(q(c).cast("double"), [0.25, 0.75], accuracy).alias(f"p{i}")
                 for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        q1, q3 = r[f"p{i}"]
        out[c] = (q1, q3, q1 - IQR_K * (q3 - q1), q3 + IQR_K * (q3 - q1))
    return out


def profile(df: DataFrame, approx: bool = False, rows: list[dict] | None = None) -> DataFrame:
    """One row per column (bounded), as a DataFrame (from ``rows`` if given)."""
    rows = rows if rows is not None else profile_columns(df, approx)
    return df.sparkSession.createDataFrame([tuple(r[f.name] for f in PROFILE_SCHEMA.fields) for r in rows],
                                           PROFILE_SCHEMA)


def profile_summary(df: DataFrame) -> DataFrame:
    """P1 + P2 as one row: total_rows, total_cols, duplicate_rows."""
    g = df.groupBy(*[q(c) for c in df.columns]).count()
    return g.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total_rows"),
                 F.lit(len(df.columns)).cast("bigint").alias("total_cols"),
                 F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))
