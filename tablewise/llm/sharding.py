"""Jump consistent hashing (operator 8), DataFrame and SQL only.

A row's shard follows from its key and the shard count alone. The jump walk
goes from shard to the next shard number at which the key would move; each step
draws fresh hash bits of (key, step). With one more shard a row either stays or
goes to the new shard. No ring table, no shuffle for the shard itself; only the
slot numbers need one, on rows of a few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_hash, save


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 .. shards - 1 of a key; a null key is a key like any other."""
    if shards < 1:
        raise ValueError("shards: at least 1")

    def step(s, i):
        # a uniform number in (0, 1] of 31 bits
        draw = (F.shiftrightunsigned(F.xxhash64(key.isNull(), key, s["next"], i), 33) + 1).cast("double") / float(1 << 31)
        ahead = F.floor((s["next"] + 1).cast("double") / draw).cast("long")
        return F.when(s["next"] < shards, F.struct(s["next"].alias("at"), ahead.alias("next"))).otherwise(s)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    # each step moves on by one shard at least
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["at"].cast("int"))


def assign(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", parts: int = 1024) -> DataFrame:
    """Shard, slot and grown shard of each row of ``docs``.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law ('key'), shard,
    slot (gapless from 0 in each shard) and grown_shard (the shard if there
    were one more). Null texts have size 8 and the CRC of no bytes; null ids
    hash like one more key. Equal rows get slots of their own. Other columns
    are not looked at. Slots: rows are numbered inside ``parts`` hash parts of
    each shard, on top of the counts of the parts before; equal rows are first
    counted, so that repeated rows meet as one row with a count.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("b"))
    rows = d.select("doc_id", (F.octet_length("b") + 8).cast("long").alias("size"), F.crc32("b").alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("m"))
    rows = rows.withColumn("shard", jump_hash(F.col("doc_id"), shards)).withColumn("grown_shard", jump_hash(F.col("doc_id"), shards + 1))
    rows = rows.withColumn("part", F.pmod(row_hash(F.col("doc_id"), F.col("size"), F.col("text_crc32")), F.lit(parts)).cast("int"))
    rows = save(rows, "shard-rows")
    upto = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.sum("m").alias("n"))
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(counts, ["shard", "part"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                       F.explode(F.expr("sequence(before + ahead, before + ahead + m - 1)")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24, doc_id: str = "doc_id") -> None:
    """Write the rows themselves, one folder ``shard=i`` a shard."""
    docs.withColumn("shard", jump_hash(F.col(doc_id), shards)).write.partitionBy("shard").parquet(path)
