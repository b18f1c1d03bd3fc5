"""Parallelism and memory rules of the session helpers and the loader."""

import os

from tablewise import session as SS
from tablewise.sources import io


def test_read_table_leaves_the_scan_to_spark(spark):
    path = os.path.join(SS.scratch_path(spark, "scan-test"), "t")
    spark.range(1000).selectExpr("id", "id * 2 AS b").coalesce(1).write.mode("overwrite").parquet(path)
    table = io.read_table(spark, path)
    plan = table.select("id").where("id > 5")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "b:" not in plan.split("ReadSchema")[1]
    assert table.count() == 1000


def test_spread_for_cpu_keeps_rows(spark):
    df = spark.range(500).coalesce(1)
    out = SS.spread_for_cpu(df, "id")
    assert out.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert out.count() == 500


def test_fit_settings_follow_local_heap(spark):
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
    p = SS.fit_parallelism(spark, 3)
    assert p == (1 if heap < 4 * (1 << 30) else 3)
    mb = SS.tree_memory_mb(spark)
    assert 16 <= mb <= 256


def test_checkpoint_dir_is_reused(spark):
    assert SS.checkpoint_dir(spark) == SS.checkpoint_dir(spark)
