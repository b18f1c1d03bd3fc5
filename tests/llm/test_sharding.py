import zlib
from collections import Counter

from pyspark.sql import functions as F

from tablewise.llm import sharding

from .conftest import rows_of_documents


def test_assign(docs, no_docs):
    got = sharding.assign(docs, parts=4).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows_of_documents())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert sharding.assign(no_docs).count() == 0


def test_even_and_monotone(spark):
    keys = spark.range(40000)
    n = [keys.select(sharding.jump_hash(F.col("id"), s).alias("s")).groupBy("s").count().collect() for s in (1, 7, 24)]
    assert [len(x) for x in n] == [1, 7, 24]
    assert max(r["count"] for r in n[2]) < 1.15 * 40000 / 24
    moved = keys.select(sharding.jump_hash(F.col("id"), 7).alias("a"), sharding.jump_hash(F.col("id"), 8).alias("b")).where("a <> b")
    assert moved.where("b <> 7").count() == 0 and abs(moved.count() - 5000) < 500
