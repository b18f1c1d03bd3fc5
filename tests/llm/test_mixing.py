import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tablewise.llm import mixing

from .conftest import collect, rows_of_documents


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_takes(docs):
    got = mixing.mix(docs).collect()
    rows = rows_of_documents()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    want = brute_targets(dict(sizes))
    by_size = defaultdict(int)
    for r in got:
        by_size[round(r.target, 6)] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size + r.part and len(r.shards) == r.copies + (r.part > 0)
        assert None not in r.shards
    assert {round(t, 6) for t in want.values()} == set(by_size)
    for t, taken in by_size.items():
        n = sum(1 for x in want.values() if round(x, 6) == t)
        assert abs(taken - n * t) <= n
    assert collect(mixing.mix(docs), "doc_id", "size", "copies") == collect(mixing.mix(docs.repartition(5)), "doc_id", "size", "copies")


def test_rows_and_empty(docs, no_docs):
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += r.copies + (r.part > 0 and 2 * r.part >= r.size)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +copies
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_rows(no_docs).count() == 0


def test_splitting_tree_is_exact_and_fair(spark):
    q = spark.createDataFrame([(0, 90), (1, 30), (2, 8)], "src int, q int")
    mean = defaultdict(float)
    for seed in range(6):
        dealt = mixing.split_quotas(q, 4, seed).collect()
        by_source, by_shard = Counter(), Counter()
        for r in dealt:
            by_source[r.src] += r.q
            by_shard[r.shard] += r.q
            mean[r.src] += r.q / 24
        assert by_source == {0: 90, 1: 30, 2: 8} and set(by_shard.values()) == {32}
    assert abs(mean[0] - 22.5) < 1e-9


def test_refined_blocks_reach_the_target(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 50 + 1).alias("size"),
                                    F.xxhash64("id").alias("h"), F.lit(1).cast("long").alias("m"))
    targets = mixing.source_targets(rows)
    taken = mixing.take_rows(rows, targets, few=20)
    got = taken.agg(F.sum(F.expr("size * (passes * m + extra) + part"))).first()[0]
    assert abs(got - 1.5 * 127500) <= 1
