"""Test inputs derived from the supplied tables (FIXTURES.md F3, F4).

Each fixture exists twice: as DataFrame code for Spark and as SQL text that
DuckDB runs for the oracle. Both inject the same defects, so the two engines
see the same rows. The modulo predicates below choose which rows get a
defect; they never remove rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.sources.io import read_table

DIRTY_ORDERS_SQL = """
with base as (
  select o_orderkey, o_custkey,
    case when o_orderkey % 13 = 0 then null else o_orderstatus end as o_orderstatus,
    case when o_orderkey % 11 = 0 then null
         when o_orderkey % 97 = 0 then o_totalprice * 10
         else o_totalprice end as o_totalprice,
    o_orderpriority,
    case when o_orderkey % 17 = 0 then 'n/a'
         when o_orderkey % 19 = 0 then '5d'
         else cast(cast(floor(o_totalprice) as bigint) as varchar(20)) end as price_text,
    case when o_orderkey % 23 = 0 then 'bad-date'
         else substr(cast(o_orderdate as varchar(30)), 1, 10) end as date_text
  from orders)
select * from base union all select * from base where o_orderkey < 3
"""

ORDER_FEATURES_SQL = """
select o.o_orderkey, o.o_orderpriority, o.o_orderstatus, c.c_mktsegment, c.c_acctbal, o.o_totalprice,
       l.n_lines, l.sum_qty, l.avg_disc, l.returned
from orders o
join customer c on o.o_custkey = c.c_custkey
join (select l_orderkey, cast(count(*) as bigint) as n_lines, sum(l_quantity) as sum_qty,
             round(avg(l_discount), 6) as avg_disc,
             max(case when l_returnflag = 'R' then 1 else 0 end) as returned
      from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey
"""


def with_fixtures(sql: str) -> str:
    """Prefix an oracle query with the fixture CTEs it may reference."""
    head = f"with dirty_orders as ({DIRTY_ORDERS_SQL}), order_features as ({ORDER_FEATURES_SQL})"
    body = sql.lstrip()
    if body[:4].lower() == "with":
        return head + ",\n" + body[4:]
    return head + "\n" + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, os.path.join(sf_dir, f"{name}.parquet"))


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    base = o.select(
        "o_orderkey", "o_custkey",
        F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 11 == 0, F.lit(None).cast("double"))
         .when(k % 97 == 0, F.col("o_totalprice") * 10)
         .otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderpriority",
        F.when(k % 17 == 0, F.lit("n/a")).when(k % 19 == 0, F.lit("5d"))
         .otherwise(F.floor("o_totalprice").cast("bigint").cast("string")).alias("price_text"),
        F.when(k % 23 == 0, F.lit("bad-date"))
         .otherwise(F.substring(F.col("o_orderdate").cast("string"), 1, 10)).alias("date_text"),
    )
    return base.unionByName(base.where(k < 3))


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    li = (table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).cast("bigint").alias("n_lines"),
               F.sum("l_quantity").alias("sum_qty"),
               F.round(F.avg("l_discount"), 6).alias("avg_disc"),
               F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned")))
    j = (o.join(c, o.o_custkey == c.c_custkey)
          .join(li, o.o_orderkey == li.l_orderkey))
    return j.select("o_orderkey", "o_orderpriority", "o_orderstatus", "c_mktsegment", "c_acctbal",
                    "o_totalprice", "n_lines", "sum_qty", "avg_disc", "returned")
