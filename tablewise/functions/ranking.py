"""Top-k per group and distributed running sums.

``top_k`` is ``row_number() over (partition by g order by …) <= k``. Spark
plans this with a partial ``WindowGroupLimit`` before the shuffle, so every map
task forwards at most k rows per group: a high-cardinality group never lands
whole in one task.

``running_sum`` computes, for rows ordered by a key, the sum of a column over
all strictly earlier keys — without a single-partition window. Rows are cut
into ordered ranges by approximate quantiles of the key; per-range totals
(bounded by the number of ranges) are prefix-summed and broadcast; the exact
running sum inside a range is a window partitioned by the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, partition: list[str], order: list[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 20_000


def running_sum(df: DataFrame, key: str, values: list[str], partition: list[str] | None = None,
                ranges: int | None = None, accuracy: int | None = None) -> DataFrame:
    """Adds ``<v>_before`` = Σ v over rows with a smaller ``key`` (same partition).

    ``key`` must be unique within a partition (group by it first). Ranges only
    split work; the result is exact whatever the range boundaries are. By
    default there is one range per ≈1M rows (at least 64), so a range window
    stays small however many distinct keys there are.
    """
    partition = list(partition or [])

    def _cuts(r: int):
        acc = accuracy or max(10_000, 10 * r)
        row = df.agg(F.count(F.lit(1)).alias("n"),
                     F.percentile_approx(key, [i / r for i in range(1, r)], acc).alias("c")).first()
        return row["n"], row["c"] or []

    if ranges is None:
        # One job for the row count and 64 cuts; a second only past 64 M keys.
        n, cuts = _cuts(64)
        need = int(min(MAX_RANGES, max(64, -(-n // ROWS_PER_RANGE))))
        if need > 64:
            n, cuts = _cuts(need)
    else:
        n, cuts = _cuts(ranges)
    cuts = sorted(set(float(c) for c in cuts))
    # Range index: any order-preserving cut works (exactness does not depend
    # on it). Few cuts: count the cuts below the key (JVM array expression);
    # many cuts: Spark ML's Bucketizer, a binary search per row.
    if len(cuts) <= 256:
        arr = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else None
        bucket = F.size(F.filter(arr, lambda c: c < F.col(key).cast("double"))) if cuts else F.lit(0)
        ranged = df.withColumn("__r", bucket.cast("int"))
    else:
        from pyspark.ml.feature import Bucketizer
        tmp = df.withColumn("__k", F.col(key).cast("double"))
        splits = [float("-inf")] + cuts + [float("inf")]
        ranged = (Bucketizer(splits=splits, inputCol="__k", outputCol="__rb", handleInvalid="keep")
                  .transform(tmp).withColumn("__r", F.col("__rb").cast("int")).drop("__k", "__rb"))
    totals = ranged.groupBy(*partition, "__r").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    # totals has ≤ (partitions × ranges) rows; prefix over ranges is a tiny window.
    wt = Window.partitionBy(*partition).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*partition, "__r", *[F.coalesce(F.sum(f"__t_{v}").over(wt), F.lit(0)).alias(f"__o_{v}")
                                                   for v in values])
    w = Window.partitionBy(*partition, "__r").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"__i_{v}") for v in values])
    # Without a partition key the offsets table has ≤ MAX_RANGES rows: broadcast.
    # With one it has (partition values × ranges) rows, not bounded up front, so
    # AQE decides from its measured size (and broadcasts it when small).
    joined = inner.join(offsets if partition else F.broadcast(offsets), partition + ["__r"])
    out = joined.select(*[c for c in df.columns],
                        *[(F.col(f"__o_{v}") + F.col(f"__i_{v}")).alias(f"{v}_before") for v in values])
    return out

