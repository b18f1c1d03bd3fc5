"""Reading, previewing, writing and row-set helpers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.ml import PipelineModel

from tablewise.functions.exprs import NA_TOKENS, NUMERIC_PATTERN, nan_to_null, q

_INT_PATTERN = r"^\s*[+-]?\d+\s*$"
_BOOL_VALUES = ["True", "False", "true", "false", "TRUE", "FALSE"]


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Columnar table with NaN normalised to NULL.

    The scan is left to Spark, so projections and filters reach it; split sizes
    follow ``spark.sql.files.maxPartitionBytes``.
    """
    return nan_to_null(spark.read.format(fmt).load(path))


def load_tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: read_table(spark, os.path.join(sf_dir, f"{n}.parquet")) for n in names}


def read_csv(spark: SparkSession, path: str, na_tokens: list[str] | None = None,
             sep: str = ",", multi_line: bool = False) -> DataFrame:
    """Headered CSV, NA tokens → NULL, then per-column inference
    int → float → bool → string decided by one coverage aggregate.

    Quotes inside quoted fields are doubled. ``multi_line`` allows line ends in
    quotes, at the price of one task per file. Whole numbers beyond 64 bits
    make a float column."""
    tokens = list(NA_TOKENS if na_tokens is None else na_tokens)
    raw = (spark.read.option("header", True).option("sep", sep)
           .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
           .option("inferSchema", False).option("mode", "PERMISSIVE")
           .option("nullValue", "\u0000").option("emptyValue", "")
           .csv(path))
    cleaned = raw.select(*[F.when(q(c).isin(tokens) | q(c).isNull(), F.lit(None)).otherwise(q(c)).alias(c)
                           for c in raw.columns])
    aggs = []
    for i, c in enumerate(cleaned.columns):
        v = q(c)
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count_if(v.rlike(_INT_PATTERN) & F.trim(v).try_cast("bigint").isNotNull()).alias(f"i{i}"),
                 F.count_if(v.rlike(NUMERIC_PATTERN) | F.lower(F.trim(v)).isin("inf", "-inf", "+inf")).alias(f"f{i}"),
                 F.count_if(v.isin(_BOOL_VALUES)).alias(f"b{i}")]
    cov = cleaned.agg(*aggs).first()
    out = []
    for i, c in enumerate(cleaned.columns):
        n = cov[f"n{i}"]
        v = F.trim(q(c))
        if n > 0 and cov[f"i{i}"] == n:
            out.append(v.try_cast("bigint").alias(c))
        elif n > 0 and cov[f"f{i}"] == n:
            out.append(v.try_cast("double").alias(c))
        elif n > 0 and cov[f"b{i}"] == n:
            out.append(F.lower(v).try_cast("boolean").alias(c))
        else:
            out.append(q(c))
    return nan_to_null(cleaned.select(*out))


def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """S3: first n rows; ordered by a key when determinism matters (top-n sort)."""
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(n)


def write_cleaned(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write the cleaned table (overwrite)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    return path


def write_clusters(df: DataFrame, path: str, source_path: str | None = None,
                   fmt: str = "parquet") -> str:
    """Write rows with their ``Cluster`` label to a new dataset path.
    Never overwrites the dataset it was read from."""
    if source_path and os.path.abspath(source_path) == os.path.abspath(path):
        raise ValueError("write_clusters: refusing to overwrite the source dataset")
    return write_cleaned(df, path, fmt)


def save_model(model: PipelineModel, path: str) -> str:
    """One fitted PipelineModel (preprocessing + estimator) saved together."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def append_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return df.unionByName(other)


def sample_rows(df: DataFrame, fraction: float, seed: int = 42, key: str | None = None) -> DataFrame:
    """Row sample; with a key it is a repeatable hash predicate."""
    if key:
        h = F.pmod(F.xxhash64(q(key), F.lit(seed)), F.lit(1_000_000))
        return df.where(h < F.lit(int(round(fraction * 1_000_000))))
    return df.sample(fraction=fraction, seed=seed)
