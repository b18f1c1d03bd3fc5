"""Descriptive statistics, correlations, target information and the
rule-based re-aims of the narrative fields (labels, findings, feature ideas).

Moments for every numeric column come from one aggregate; quartiles from one
distributed quantile call; correlations from one aggregate per chunk of
column pairs (≈200 aggregate expressions per job to stay inside codegen).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.exprs import chunks, kurt_excess, q, safe_corr, skew_g1
from tablewise.functions.quantiles import quantiles
from tablewise.functions.ranking import top_k
from tablewise.operators.schema import column_roles, detect_problem_type

PAIRS_PER_JOB = 64  # 3 aggregates per pair → ≈200 expressions per job


# --- E1, E2 ----------------------------------------------------------------------
DESCRIBE_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()), T.StructField("column", T.StringType()),
    T.StructField("count", T.LongType()), T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()), T.StructField("min", T.DoubleType()),
    T.StructField("q25", T.DoubleType()), T.StructField("q50", T.DoubleType()),
    T.StructField("q75", T.DoubleType()), T.StructField("max", T.DoubleType()),
    T.StructField("skewness", T.DoubleType()), T.StructField("kurtosis", T.DoubleType())])


def moments(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """count, mean, sample std, min, max, G1 skewness, excess kurtosis — one job."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        v = q(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), skew_g1(v).alias(f"g{i}"),
                 kurt_excess(v).alias(f"k{i}")]
    r = df.agg(*aggs).first()
    return {c: dict(count=r[f"n{i}"], mean=r[f"m{i}"], std=r[f"s{i}"], min=r[f"lo{i}"], max=r[f"hi{i}"],
                    skewness=r[f"g{i}"], kurtosis=r[f"k{i}"]) for i, c in enumerate(cols)}


def describe_rows(df: DataFrame, cols: list[str] | None = None) -> list[dict]:
    if cols is None:
        cols, _ = column_roles(df)
    m = moments(df, cols)
    known = {c: (m[c]["count"], m[c]["min"], m[c]["max"]) for c in cols}
    qs = quantiles(df, cols, [0.25, 0.5, 0.75], stats=known) if cols else {}
    out = []
    for i, c in enumerate(cols):
        q25, q50, q75 = qs.get(("", c), [None] * 3)
        out.append(dict(position=i, column=c, **{k: m[c][k] for k in ("count", "mean", "std", "min")},
                        q25=q25, q50=q50, q75=q75, max=m[c]["max"], skewness=m[c]["skewness"],
                        kurtosis=m[c]["kurtosis"]))
    return out


def describe(df: DataFrame, cols: list[str] | None = None, rows: list[dict] | None = None) -> DataFrame:
    """E1 + E2: one row per numeric column (bounded; from ``rows`` if given)."""
    rows = rows if rows is not None else describe_rows(df, cols)
    return df.sparkSession.createDataFrame(
        [tuple(r[f.name] for f in DESCRIBE_SCHEMA.fields) for r in rows], DESCRIBE_SCHEMA)


def skewness(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """E2 as a lazy one-row-per-column DataFrame (NULL for n < 3 or a constant)."""
    if cols is None:
        cols, _ = column_roles(df)
    agg = df.agg(*[skew_g1(q(c).cast("double")).alias(f"g{i}") for i, c in enumerate(cols)])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"g{i}").alias("skewness")) for i, c in enumerate(cols)])
    return agg.select(F.inline(arr))


# --- E3, E4 ----------------------------------------------------------------------
def value_counts(df: DataFrame, cols: list[str], dropna: bool = False) -> DataFrame:
    """(column, value, count) for the given columns; NULL is a value unless dropna."""
    arr = F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in cols])
    long = df.select(F.inline(arr))
    if dropna:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, k: int = 5, cols: list[str] | None = None, dropna: bool = False) -> DataFrame:
    """Top k values per categorical column, NULL counted; ties → value asc."""
    if cols is None:
        _, cols = column_roles(df)
    vc = value_counts(df, cols, dropna)
    return top_k(vc, ["column"], [F.desc("count"), F.asc_nulls_last("value")], k).select(
        "column", "rank", "value", "count")


def cardinality(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Distinct non-null values per categorical column; 0 for a column of nulls."""
    if cols is None:
        _, cols = column_roles(df)
    vc = value_counts(df, cols, dropna=True)
    found = vc.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return every.join(found, "column", "left").select("column", F.coalesce("n", F.lit(0)).cast("bigint").alias("cardinality"))


# --- E5, E6 ----------------------------------------------------------------------
def correlation_pairs(df: DataFrame, cols: list[str] | None = None) -> list[tuple]:
    """(i, j, col_i, col_j, r) for i < j; r is NULL for constant or empty pairs.

    Pass 1 (one aggregate) takes null counts and means. Pairs of columns with
    no nulls use the two-pass form: Σ(x−x̄)(y−ȳ) and Σ(x−x̄)² as plain sums in
    pass 2 (numerically stable, cheap). Pairs touching a column with nulls use
    pairwise-complete ``regr_*`` aggregates, chunked to ≈200 expressions.
    """
    if cols is None:
        cols, _ = column_roles(df)
    if len(cols) < 2:
        return []
    x = [q(c).cast("double") for c in cols]
    r1 = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(v.isNull()).alias(f"m{i}") for i, v in enumerate(x)],
                *[F.avg(v).alias(f"a{i}") for i, v in enumerate(x)]).first()
    full = [i for i in range(len(cols)) if r1[f"m{i}"] == 0 and r1[f"a{i}"] is not None]
    fullset = set(full)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    res: dict = {}
    if len(full) >= 2:
        d = {i: x[i] - F.lit(float(r1[f"a{i}"])) for i in full}
        fp = [(i, j) for i, j in pairs if i in fullset and j in fullset]
        for chunk in chunks(fp, 3 * PAIRS_PER_JOB):
            need = sorted({i for p in chunk for i in p})
            r2 = df.agg(*[F.sum(d[i] * d[i]).alias(f"s{i}") for i in need],
                        *[F.sum(d[i] * d[j]).alias(f"c{i}_{j}") for i, j in chunk]).first()
            for i, j in chunk:
                den = math.sqrt(r2[f"s{i}"] * r2[f"s{j}"]) if r2[f"s{i}"] and r2[f"s{j}"] else 0.0
                res[(i, j)] = r2[f"c{i}_{j}"] / den if den > 0 else None
    rest = [(i, j) for i, j in pairs if (i, j) not in res and not (i in fullset and j in fullset)]
    for chunk in chunks(rest, PAIRS_PER_JOB):
        r = df.agg(*[safe_corr(x[i], x[j]).alias(f"r{i}_{j}") for i, j in chunk]).first()
        for i, j in chunk:
            v = r[f"r{i}_{j}"]
            res[(i, j)] = None if v is None or math.isnan(v) else float(v)
    return [(i, j, cols[i], cols[j], res.get((i, j))) for i, j in pairs]


CORR_SCHEMA = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
                            T.StructField("feature_1", T.StringType()), T.StructField("feature_2", T.StringType()),
                            T.StructField("correlation", T.DoubleType())])


def correlation_matrix(df: DataFrame, cols: list[str] | None = None, pairs: list | None = None) -> DataFrame:
    """E5: full k×k long form (both orders and the diagonal), only for k ≥ 2."""
    if cols is None:
        cols, _ = column_roles(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], CORR_SCHEMA)
    pairs = pairs if pairs is not None else correlation_pairs(df, cols)
    constant = {c: True for c in cols}
    for i, j, a, b, r in pairs:
        if r is not None:
            constant[a] = constant[b] = False
    rows = []
    for i, j, a, b, r in pairs:
        rows += [(i, j, a, b, r), (j, i, b, a, r)]
    for i, c in enumerate(cols):
        rows.append((i, i, c, c, None if constant[c] else 1.0))
    return df.sparkSession.createDataFrame(rows, CORR_SCHEMA)


def top_correlations(df: DataFrame, threshold: float = 0.4, k: int = 10, cols: list[str] | None = None,
                     pairs: list | None = None) -> DataFrame:
    """Pairs i<j with |r| ≥ threshold, r rounded to 4, strongest first, top k."""
    if cols is None:
        cols, _ = column_roles(df)
    pairs = pairs if pairs is not None else correlation_pairs(df, cols)
    kept = [(i, j, a, b, round(r, 4)) for i, j, a, b, r in pairs if r is not None and abs(r) >= threshold]
    kept.sort(key=lambda t: (-abs(t[4]), t[0], t[1]))  # stable order of the pair loop on ties
    schema = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("feature_1", T.StringType()),
                           T.StructField("feature_2", T.StringType()), T.StructField("correlation", T.DoubleType())])
    return df.sparkSession.createDataFrame([(n + 1, a, b, r) for n, (i, j, a, b, r) in enumerate(kept[:k])], schema)


# --- E7, E8, E12 -------------------------------------------------------------------
def target_info(df: DataFrame, target: str) -> DataFrame:
    """One row; numeric → mean and sample std; categorical → top 3 categories."""
    dt = df.schema[target].dataType
    t = q(target)
    numeric = isinstance(dt, (T.NumericType, T.BooleanType))
    if numeric:
        v = t.cast("int").cast("double") if isinstance(dt, T.BooleanType) else t.cast("double")
        return df.agg(F.lit(target).alias("name"), F.lit(dt.simpleString()).alias("dtype"),
                      F.count_distinct(t).cast("bigint").alias("unique_count"),
                      F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    vc = value_counts(df, [target], dropna=True)
    card = vc.count()
    top = top_k(vc, ["column"], [F.desc("count"), F.asc_nulls_last("value")], 3).orderBy("rank").collect()
    schema = ("name string, dtype string, unique_count bigint, top_categories array<string>, "
              "top_counts array<bigint>")
    return df.sparkSession.createDataFrame(
        [(target, dt.simpleString(), card, [r["value"] for r in top], [r["count"] for r in top])], schema)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Share of each class (nulls excluded) and the majority/minority ratio."""
    counts = df.where(q(target).isNotNull()).groupBy(q(target).cast("string").alias("class")).agg(
        F.count(F.lit(1)).alias("count"))
    tot = counts.agg(F.sum("count").alias("n"), F.max("count").alias("hi"), F.min("count").alias("lo")).first()
    if not tot["n"]:
        return counts.select("class", "count", F.lit(None).cast("double").alias("share"),
                             F.lit(None).cast("double").alias("imbalance_ratio"))
    return counts.select("class", "count", (F.col("count") / F.lit(float(tot["n"]))).alias("share"),
                         F.lit(tot["hi"] / tot["lo"]).cast("double").alias("imbalance_ratio"))


# --- E10, E11, E13, E14 ---------------------------------------------------------------
SKEW_LIMIT = 0.5
UNIFORM_KURTOSIS = -1.0
STRONG_SKEW = 1.0
STRONG_CORR = 0.7
IMBALANCE_SHARE = 0.7
BIN_MIN_DISTINCT = 50
BINS = 10


def distribution_labels(df: DataFrame, describe_rows_: list[dict] | None = None,
                        nunique_: dict | None = None) -> DataFrame:
    """Binary / Categorical / Uniform / Skewed-Right / Skewed-Left / Normal."""
    from tablewise.operators.profile import nunique
    num, cat = column_roles(df)
    stats = {r["column"]: r for r in (describe_rows_ if describe_rows_ is not None else
                                      [dict(column=c, **m) for c, m in moments(df, num).items()])}
    nu = nunique_ if nunique_ is not None else nunique(df, num + cat)
    rows = []
    for c in df.columns:
        if c not in num and c not in cat:
            continue
        n = nu.get(c, 0)
        if n == 2:
            label = "Binary"
        elif c in cat:
            label = "Categorical"
        else:
            g, k = stats[c]["skewness"], stats[c]["kurtosis"]
            if g is None:
                label = "Normal"
            elif abs(g) < SKEW_LIMIT and k is not None and k < UNIFORM_KURTOSIS:
                label = "Uniform"
            elif g > SKEW_LIMIT:
                label = "Skewed-Right"
            elif g < -SKEW_LIMIT:
                label = "Skewed-Left"
            else:
                label = "Normal"
        rows.append((c, label))
    return df.sparkSession.createDataFrame(rows, "column string, distribution string")


def key_findings(df: DataFrame, target: str | None = None, pairs: list | None = None,
                 skews: dict | None = None) -> DataFrame:
    """(kind, column, evidence) rows — strong correlations, skew, imbalance."""
    num, _ = column_roles(df)
    rows = []
    pairs = pairs if pairs is not None else correlation_pairs(df, num)
    for i, j, a, b, r in pairs:
        if r is not None and abs(r) >= STRONG_CORR:
            rows.append(("high_correlation", f"{a},{b}", round(r, 4)))
    skews = skews if skews is not None else {c: m["skewness"] for c, m in moments(df, num).items()}
    for c in num:
        g = skews.get(c)
        if g is not None and abs(g) > STRONG_SKEW:
            rows.append(("skewed_distribution", c, round(g, 4)))
    if target and target in df.columns and detect_problem_type(df, target) == "classification":
        top = class_balance(df, target).orderBy(F.desc("share")).first()
        if top is not None and top["share"] >= IMBALANCE_SHARE:
            rows.append(("class_imbalance", target, round(top["share"], 4)))
    return df.sparkSession.createDataFrame(rows, "kind string, column string, evidence double")


def suggest_features(df: DataFrame, target: str | None = None, pairs: list | None = None) -> DataFrame:
    """(feature, kind, source_1, source_2) rule rows.

    skew > 1 and min ≥ 0 → log1p; > 50 distinct values → decile bins;
    |r| ≥ 0.7 between two features → ratio; every other numeric → z-score.
    """
    from tablewise.operators.profile import nunique
    num, _ = column_roles(df)
    num = [c for c in num if c != target]
    m = moments(df, num)
    nu = nunique(df, num)
    rows = []
    for c in num:
        g, lo = m[c]["skewness"], m[c]["min"]
        if g is not None and g > STRONG_SKEW and lo is not None and lo >= 0:
            rows.append((f"{c}_log1p", "log1p", c, None))
        elif nu.get(c, 0) > BIN_MIN_DISTINCT:
            rows.append((f"{c}_bin", "quantile_bin", c, None))
        elif nu.get(c, 0) > 2:
            rows.append((f"{c}_z", "zscore", c, None))
    pairs = pairs if pairs is not None else correlation_pairs(df, num)
    for i, j, a, b, r in pairs:
        if r is not None and abs(r) >= STRONG_CORR:
            rows.append((f"{a}_per_{b}", "ratio", a, b))
    return df.sparkSession.createDataFrame(rows, "feature string, kind string, source_1 string, source_2 string")


def apply_features(df: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Materialise the suggestions as new columns (all JVM expressions)."""
    sug = suggestions.collect()  # bounded: a few rows per column
    bin_cols = [r["source_1"] for r in sug if r["kind"] == "quantile_bin"]
    z_cols = [r["source_1"] for r in sug if r["kind"] == "zscore"]
    edges = quantiles(df, bin_cols, [i / BINS for i in range(1, BINS)]) if bin_cols else {}
    zs = {}
    if z_cols:
        r = df.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(z_cols)],
                   *[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(z_cols)]).first()
        zs = {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(z_cols)}
    new = []
    for s in sug:
        a = q(s["source_1"]).cast("double")
        if s["kind"] == "log1p":
            new.append(F.log1p(a).alias(s["feature"]))
        elif s["kind"] == "ratio":
            new.append(F.try_divide(a, q(s["source_2"]).cast("double")).alias(s["feature"]))
        elif s["kind"] == "quantile_bin":
            cuts = sorted(set(v for v in edges[("", s["source_1"])] if v is not None))
            b = F.lit(0)
            for cut in cuts:
                b = b + F.when(a > F.lit(cut), 1).otherwise(0)
            new.append(F.when(a.isNull(), F.lit(None)).otherwise(b).cast("int").alias(s["feature"]))
        elif s["kind"] == "zscore":
            mu, sd = zs[s["source_1"]]
            new.append((F.try_divide(a - F.lit(mu), F.lit(sd)) if sd else F.lit(0.0)).alias(s["feature"]))
    return df.select("*", *new)


def eda_summary(df: DataFrame, target: str | None = None, limit_cols: int | None = None) -> dict:
    """Compact profile: shape, role counts, target info, summaries of every
    numeric column and top values of every categorical one (``limit_cols`` asks
    for the first of each kind only), top correlations (a few rows a column)."""
    num, cat = column_roles(df)
    n = df.count()
    desc = describe_rows(df, num[:limit_cols])
    pairs = correlation_pairs(df, num)
    out = dict(shape=(n, len(df.columns)), numeric_columns_count=len(num), categorical_columns_count=len(cat),
               numeric_columns_summary={r["column"]: {k: r[k] for k in ("mean", "std", "min", "max", "skewness")}
                                        for r in desc},
               categorical_columns_summary=[r.asDict() for r in top_values(df, 5, cat[:limit_cols]).collect()]
               if cat else [],
               top_correlations=[r.asDict() for r in top_correlations(df, pairs=pairs, cols=num).collect()])
    if target and target in df.columns:
        out["target"] = target_info(df, target).first().asDict()
    return out
