"""Shared helpers: intermediate tables in the session's shared folder."""

from __future__ import annotations

import gc
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.session import checkpoint_dir

#: Words are maximal runs of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name of its own below the session's shared folder."""
    return f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back.

    Cuts lineage like a checkpoint does, in a columnar and compressed form; a
    lost executor costs no recomputation of what is already written.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete intermediate tables that nothing reads any more, and let Spark drop
    the shuffle files of finished queries (it does so when their plans are collected)."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        for file in t.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("llm-"):
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def literal(value, kind: str):
    """A nested constant as one literal of the plan, however many members it has."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def row_hash(*cols):
    """64 hash bits of a row; a null is told from every value."""
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), c)])
