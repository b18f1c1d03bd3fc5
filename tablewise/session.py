"""Session construction and lineage cutting.

The library never creates a global session; callers pass one in. This module
only offers a convenience builder (used by tests, bench and examples) and the
checkpoint helpers that every multi-stage operator uses.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "tablewise",
              shuffle_partitions: int | None = None,
              conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE, UTC time and Arrow enabled."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of this session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when it is unset and the master is local a scratch folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tablewise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's checkpoint dir.

    Survives executor loss (unlike caching or local checkpoints): a lost
    partition is re-read from the checkpoint files, not recomputed from the
    source.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", name)


def settled(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back, for several jobs that each read a few columns of it."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table of this session that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread_for_cpu(df: DataFrame, *keys, factor: int = 2) -> DataFrame:
    """Hash-repartition rows before CPU-heavy per-row work (fan-out or numpy).

    AQE sizes shuffle partitions by bytes, so a few megabytes of distinct
    values that each expand 200× (or run a TreeSHAP evaluation) would land in
    one or two tasks. This keeps at least ``factor`` × default parallelism
    partitions, and never fewer than the input already has. Hash partitioning
    keeps retries deterministic.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism * factor, 1)
    cols = [df[k] for k in keys] if keys else [df[c] for c in df.columns]
    from pyspark.sql import functions as F
    return df.repartition(n, F.xxhash64(*cols))


def persist_spread(df: DataFrame, key: str | None = None, factor: int = 2) -> DataFrame:
    """Persisted rows, dealt anew if they lie in fewer than ``factor`` × default parallelism partitions.

    For rows that many CPU-heavy passes read: AQE merges a few megabytes into one
    or two partitions, which would leave all passes to one or two tasks. With a
    key, rows go by the hash of all their columns (rows whose key is null are dealt
    too), else in turn (Spark sorts them first, so that retries agree). An input
    that has partitions enough stays as it is.
    """
    from pyspark import StorageLevel
    from pyspark.sql import functions as F
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    held.count()
    n = max(df.sparkSession.sparkContext.defaultParallelism * factor, 1)
    if held.rdd.getNumPartitions() >= n:
        return held
    hashed = [F.col("`" + f.name.replace("`", "``") + "`") for f in held.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    spread = (held.repartition(n, F.xxhash64(*hashed)) if key else held.repartition(n)).persist(StorageLevel.MEMORY_AND_DISK)
    spread.count()
    held.unpersist()
    return spread


def fit_parallelism(spark: SparkSession, wanted: int, min_heap_gib: float = 4.0) -> int:
    """How many model fits to run concurrently.

    On a cluster the fits' working memory (tree histograms, k-means sums) lives
    on the executors, so ``wanted`` is used. In local mode everything shares
    one JVM heap; below ``min_heap_gib`` the fits run one at a time.
    """
    try:
        master = spark.sparkContext.master or ""
        if master.startswith("local"):
            heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
            if heap < min_heap_gib * (1 << 30):
                return 1
    except Exception:  # noqa: BLE001 - unknown: be conservative
        return 1
    return max(1, wanted)


def tree_memory_mb(spark: SparkSession, default: int = 256) -> int:
    """``maxMemoryInMB`` for tree learners.

    Every concurrent task allocates split statistics up to this size. On a
    cluster each task has its executor's share of memory and the default is
    kept; in local mode all tasks share one heap, so the budget is
    heap / (4 × cores), between 16 and ``default`` MB. Smaller budgets mean more
    node groups (passes) per tree level; the split search is the same, though
    with per-node feature subsampling the random draws may differ.
    """
    try:
        sc = spark.sparkContext
        if (sc.master or "").startswith("local"):
            heap_mb = sc._jvm.java.lang.Runtime.getRuntime().maxMemory() // (1 << 20)
            return int(max(16, min(default, heap_mb // (4 * max(sc.defaultParallelism, 1)))))
    except Exception:  # noqa: BLE001
        return 64
    return default
