"""M3, M7: category vocabularies held as tables, of any size.

A vocabulary is a table (column, value, code, n): the distinct values of each
column with codes 0, 1, ... in value order. Values are counted map-side, dealt
into ranges of (column, value) and written; a value's code is the number of
values in the ranges before its own plus its place inside it. The driver sees
the number of values of each column and nothing else.

Codes reach rows by joins: values with over 1 / HOT of the rows (fewer than HOT a
column, whatever the data) are broadcast; the other rows join by value, where no
value has more than that share, and rows already coded are spread by a hash, so
a value that a third of the rows hold does not meet in one task.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.exprs import q
from tablewise.session import scratch_path

HOT = 1_000
SPREAD = 1_024


@dataclass
class Vocabulary:
    """``table`` is (column index, value, code, n); ``sizes`` the number of values of each column."""
    table: DataFrame
    columns: list[str]
    sizes: list[int]
    rows: int

    def values(self, column: str) -> DataFrame:
        """(value, code, n) of one column."""
        return self.table.where(F.col("column") == self.columns.index(column)).select("value", "code", "n")

    def offsets(self, first: int = 0) -> list[int]:
        """First slot of each column when their one-hot slots follow each other from ``first``."""
        return [first + sum(self.sizes[:i]) for i in range(len(self.sizes))]

    def names(self, first: int = 0) -> DataFrame:
        """(slot, name) of all one-hot slots: ``<column>_<value>``."""
        cols, starts = F.array(*[F.lit(c) for c in self.columns]), F.array(*[F.lit(o).cast("long") for o in self.offsets(first)])
        return self.table.select((F.get(starts, F.col("column")) + F.col("code")).alias("slot"), F.concat(F.get(cols, F.col("column")), F.lit("_"), F.col("value").cast("string")).alias("name"))


def fit_vocabulary(df: DataFrame, columns: list[str], as_string: bool = True) -> Vocabulary:
    """The vocabulary of ``columns``; null is no value. ``as_string`` takes the string
    form of every column (needed for several); else the one column keeps its type and its order."""
    if not as_string and len(columns) != 1:
        raise ValueError("as_string=False: one column")
    spark = df.sparkSession
    values = F.array(*[q(c).cast("string") if as_string else q(c) for c in columns])
    long = df.select(F.posexplode(values).alias("column", "value")).where(F.col("value").isNotNull())
    counted = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, f"vocabulary-{uuid.uuid4().hex}")
    counted.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("column", "part").agg(F.count(F.lit(1)).alias("k"))
    parts = parts.select("column", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("column", "part").orderBy("value")
    coded = ranged.withColumn("at", F.row_number().over(inside) - 1).join(parts, ["column", "part"])
    out = path + "-codes"
    coded.select("column", "value", (F.col("before") + F.col("at")).cast("long").alias("code"), "n").write.parquet(out)
    table = spark.read.parquet(out)
    found = {r["column"]: r for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()}
    return Vocabulary(table, list(columns), [found[i]["k"] if i in found else 0 for i in range(len(columns))], max((r["n"] for r in found.values()), default=0))


def encode(df: DataFrame, vocabulary: Vocabulary, outputs: list[str], as_string: bool = True) -> DataFrame:
    """``df`` with a long column of codes for each column of the vocabulary; null and unknown values have none."""
    out = df
    for i, (c, name) in enumerate(zip(vocabulary.columns, outputs)):
        table = vocabulary.table.where(F.col("column") == i)
        hot = table.where(F.col("n") * HOT > vocabulary.rows).select(F.col("value").alias("__hv"), F.col("code").alias("__hc"))
        cold = table.where(F.col("n") * HOT <= vocabulary.rows).select(F.col("value").alias("__cv"), F.lit(0).alias("__cs"), F.col("code").alias("__cc"))
        kept = [F.col(f"`{x}`") for x in out.columns]
        out = out.withColumn("__v", q(c).cast("string") if as_string else q(c))
        out = out.join(F.broadcast(hot), F.col("__v") == F.col("__hv"), "left")  # fewer than HOT rows
        # rows that need no further code go anywhere but to salt 0
        open_ = F.col("__v").isNotNull() & F.col("__hc").isNull()
        salt = F.when(open_, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*[x for x in kept]), F.lit(SPREAD)).cast("int"))
        out = out.withColumn("__salt", salt)
        out = out.join(cold, (F.col("__v") == F.col("__cv")) & (F.col("__salt") == F.col("__cs")), "left")
        out = out.select(*kept, F.coalesce("__hc", "__cc").alias(name))
    return out


def _vectors(numeric: int, coded: int, size: int):
    """mapInArrow body: the last numeric + coded columns become one sparse ML vector."""
    def run(batches):
        for b in batches:
            n, first = b.num_rows, b.num_columns - numeric - coded
            at, values = [], []
            for j in range(numeric):
                at.append(np.full(n, j, np.int64))
                values.append(b.column(first + j).to_numpy(zero_copy_only=False).astype(float))
            for j in range(coded):  # a slot number, or -1 for none
                at.append(b.column(first + numeric + j).to_numpy(zero_copy_only=False).astype(np.int64))
                values.append(np.where(at[-1] >= 0, 1.0, 0.0))
            at = np.stack(at, axis=1) if at else np.zeros((n, 0), np.int64)
            values = np.stack(values, axis=1) if values else np.zeros((n, 0))
            keep = (values != 0).ravel()
            ends = np.concatenate(([0], np.cumsum((values != 0).sum(axis=1)))).astype(np.int32)
            indices = pa.ListArray.from_arrays(pa.array(ends), pa.array(at.ravel()[keep].astype(np.int32)))
            numbers = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()[keep]))
            vector = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), indices, numbers], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*b.columns[:first], vector], [*b.schema.names[:first], "__vector"])

    return run


def one_hot(df: DataFrame, vocabulary: Vocabulary, numeric: list[Column] | None = None, output: str = "features") -> DataFrame:
    """``df`` with a sparse vector: the numeric expressions (null as 0), then one slot for each value of each column.

    Unknown and null values leave their column's slots zero. Vectors are built
    from (row, code) in Arrow batches; the vocabulary stays a table.
    """
    numeric = list(numeric or [])
    codes = [f"__code{i}" for i in range(len(vocabulary.columns))]
    coded = encode(df, vocabulary, codes)
    starts = vocabulary.offsets(len(numeric))
    size = len(numeric) + sum(vocabulary.sizes)
    names = [f"__k{i}" for i in range(len(df.columns))]  # any column name will do
    flat = coded.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(df.columns, names)],
                        *[F.coalesce(x.cast("double"), F.lit(0.0)).alias(f"__x{j}") for j, x in enumerate(numeric)],
                        *[F.coalesce(F.col(c) + F.lit(s), F.lit(-1)).cast("long").alias(f"__s{j}") for j, (c, s) in enumerate(zip(codes, starts))])
    schema = T.StructType([*flat.schema.fields[:len(names)], T.StructField("__vector", VectorUDT())])
    _ship_by_value()
    out = flat.mapInArrow(_vectors(len(numeric), len(codes), size), schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(df.columns, names)], F.col("__vector").alias(output))


def _ship_by_value() -> None:
    """Send this module's functions by value, so executors need not have the package."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
