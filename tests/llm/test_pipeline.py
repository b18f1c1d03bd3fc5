"""Each stage of the pipeline against the brute-force versions of its operator."""

from collections import Counter, defaultdict

import corpus_pipeline as cp

from . import test_jaccard, test_mixing, test_quality, test_suffix

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = dict(cp.STAGES)
    rows = docs.collect()
    kept = stages["quality_rules"](spark, docs, SF)
    assert kept.columns == names
    rows = [r for r in rows if test_quality.brute(r.text)["kept"]]
    assert Counter(kept.collect()) == Counter(rows)
    docs = spark.createDataFrame(rows, docs.schema)
    one = stages["near_duplicates"](spark, docs, SF)
    part = {d: c for d, _, c in test_jaccard.brute([(r.doc_id, r.text) for r in rows], 5, 80)}
    rows = [r for r in rows if part[r.doc_id] == r.doc_id]
    assert one.columns == names and Counter(one.collect()) == Counter(rows)
    docs = spark.createDataFrame(rows, docs.schema)
    cut = stages["repeated_passages"](spark, docs, SF)
    want = {r.doc_id: x for r, x in zip(rows, test_suffix.brute([r.text for r in rows], 200))}
    got = cut.collect()
    assert cut.columns == names and {r.doc_id for r in got} == {i for i, x in want.items() if x[0] > x[1]}
    assert all(len(r.text.encode()) <= want[r.doc_id][0] - want[r.doc_id][1] and r.n_chars == len(r.text) for r in got)
    docs = spark.createDataFrame(got, docs.schema)
    mixed = stages["mix"](spark, docs, SF)
    copies, sizes, taken = Counter(r.doc_id for r in mixed.collect()), defaultdict(int), defaultdict(int)
    assert mixed.columns == names and max(copies.values()) <= 2
    for r in got:
        sizes[r.source] += test_mixing.words(r.text)
        taken[r.source] += copies[r.doc_id] * test_mixing.words(r.text)
    longest = max(test_mixing.words(r.text) for r in got)
    assert all(abs(taken[s] - t) <= longest for s, t in test_mixing.brute_targets(dict(sizes)).items())
    packed = stages["pack"](spark, mixed, SF).collect()
    assert {r.doc_id for r in packed} == set(copies)


def test_run(spark):
    assert cp.run(spark, SF).count() > 0
