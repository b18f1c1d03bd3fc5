"""The two synthetic demo tables, generated on the executors.

Distributions and schema follow the demo generators; values cannot be
bit-identical to numpy's generator and are not meant to be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform_int(lo: int, hi: int, seed: int) -> Column:
    """Integer uniform on [lo, hi)."""
    return (F.floor(F.rand(seed) * (hi - lo)) + lo).cast("bigint")


def _choice(values: list, probs: list[float], seed: int) -> Column:
    u = F.rand(seed)
    expr = None
    acc = 0.0
    for v, p in zip(values[:-1], probs[:-1]):
        acc += p
        expr = (F.when(u < acc, F.lit(v)) if expr is None else expr.when(u < acc, F.lit(v)))
    return expr.otherwise(F.lit(values[-1]))


def _poisson(lam: float, seed: int, kmax: int = 30) -> Column:
    """Inverse-CDF Poisson draw as one CASE expression."""
    import math
    u = F.rand(seed)
    expr = None
    cdf = 0.0
    for k in range(kmax):
        cdf += math.exp(-lam) * lam ** k / math.factorial(k)
        expr = F.when(u < cdf, F.lit(k)) if expr is None else expr.when(u < cdf, F.lit(k))
    return expr.otherwise(F.lit(kmax)).cast("bigint")


def synth_churn(spark: SparkSession, n: int = 150, seed: int = 42, duplicates: int = 3,
                null_fraction: float = 0.1) -> DataFrame:
    """9-column churn table: 10% nulls in Total_Spend and ``duplicates`` repeated rows."""
    base = spark.range(n).select(
        (F.col("id") + 1001).alias("CustomerID"),
        _uniform_int(18, 70, seed + 1).alias("Age"),
        _uniform_int(1, 72, seed + 2).alias("Tenure_Months"),
        F.round(F.rand(seed + 3) * 100 + 20, 2).alias("Monthly_Charge"),
        _poisson(1.5, seed + 4).alias("Support_Calls"),
        _choice(["Month-to-Month", "One Year", "Two Year"], [0.5, 0.3, 0.2], seed + 5).alias("Contract_Type"),
        _choice(["Yes", "No"], [0.5, 0.5], seed + 6).alias("Paperless_Billing"),
        F.rand(seed + 7).alias("__u"),
        _choice([0, 1], [0.7, 0.3], seed + 8).cast("bigint").alias("Churn"),
    )
    df = base.select(
        "CustomerID", "Age", "Tenure_Months", "Monthly_Charge", "Support_Calls", "Contract_Type",
        "Paperless_Billing",
        F.when(F.col("__u") < null_fraction, F.lit(None).cast("double"))
         .otherwise(F.col("Tenure_Months") * F.col("Monthly_Charge")).alias("Total_Spend"),
        "Churn")
    return df.unionByName(df.where(F.col("CustomerID") < 1001 + duplicates))


def synth_housing(spark: SparkSession, n: int = 150, seed: int = 42) -> DataFrame:
    """8-column housing table; price is a linear formula plus N(0, 15000) noise,
    with one square-footage outlier (row 5) and one missing neighbourhood (row 12)."""
    b = spark.range(n).select(
        (F.col("id") + 1).alias("HouseID"),
        _uniform_int(800, 4000, seed + 1).alias("Square_Footage"),
        _choice([1, 2, 3, 4, 5], [0.1, 0.3, 0.4, 0.15, 0.05], seed + 2).cast("bigint").alias("Bedrooms"),
        _choice([1.0, 1.5, 2.0, 2.5, 3.0], [0.2] * 5, seed + 3).cast("double").alias("Bathrooms"),
        _choice(["Downtown", "Suburbs", "Rural"], [0.4, 0.4, 0.2], seed + 4).alias("Neighborhood"),
        _uniform_int(1950, 2024, seed + 5).alias("Year_Built"),
        _choice(["Yes", "No"], [0.15, 0.85], seed + 6).alias("Has_Pool"),
        F.randn(seed + 7).alias("__e"),
    )
    price = (F.col("Square_Footage") * 150 + F.col("Bedrooms") * 10000 + F.col("Bathrooms") * 15000
             + F.when(F.col("Neighborhood") == "Downtown", 50000).otherwise(0)
             + (F.col("Year_Built") - 1950) * 500
             + F.when(F.col("Has_Pool") == "Yes", 30000).otherwise(0)
             + F.col("__e") * 15000)
    return b.select(
        "HouseID",
        F.when(F.col("HouseID") == 6, F.lit(12000).cast("bigint")).otherwise(F.col("Square_Footage")).alias("Square_Footage"),
        "Bedrooms", "Bathrooms",
        F.when(F.col("HouseID") == 13, F.lit(None)).otherwise(F.col("Neighborhood")).alias("Neighborhood"),
        "Year_Built", "Has_Pool",
        price.cast("bigint").alias("House_Price"))
