import random
import re
from collections import defaultdict

import pytest

from tablewise.llm import jaccard
from tablewise.llm.components import components

from .conftest import rows_of_documents


def shingle_set(text, words):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute(rows, words, percent):
    """(doc_id, size, component) of (doc_id, text) rows, by all pairs."""
    sets = [shingle_set(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return sorted(((d, len(sets[i]), min([x for x in low[find(i)] if x is not None], default=None)) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(seed, families=12, members=14):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    passage = [rnd.choice(vocabulary) for _ in range(25)]
    texts = []
    for _ in range(families):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(4, 150))] + passage * rnd.randint(0, 1)
        for _ in range(members):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 25))):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            texts.append(" ".join(t if rnd.random() < 0.8 else [x.upper() for x in t]))
    return texts


@pytest.mark.parametrize("words,percent,seed", [(4, 85, 1), (5, 80, 2)])
def test_against_all_pairs(spark, words, percent, seed):
    rows = [((i * 37) % 1009, t) for i, t in enumerate(near_copies(seed))]
    df = spark.createDataFrame([(i, t, 3, 4) for i, t in rows], "doc_id long, text string, n_shingles int, h int").repartition(4)
    got = jaccard.classes(df, words, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, words, percent)


def test_edge_rows_and_keep_one(docs, no_docs):
    rows = [r[:2] for r in rows_of_documents()]
    got = jaccard.classes(docs).select("doc_id", "n_shingles", "component_id").collect()
    want = brute(rows, 4, 85)
    assert sorted(map(tuple, got), key=str) == want
    kept = jaccard.keep_one(docs, 4, 85)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([d for d, n, _ in want if not n] + list({c for _, n, c in want if n}), key=str)
    assert jaccard.classes(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("parts,miss", [(2, 1), (3, 1), (1, 0), (4, 2)])
def test_signatures_meet(parts, miss):
    import numpy as np

    rnd = np.random.default_rng(3)
    for n in [6, 7, 9, 20, 33, 64, 150, 400, 1000]:
        for _ in range(20):
            s = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
            drop = int(rnd.integers(0, n * 15 // 100 + 1))
            add = int(rnd.integers(0, n * 15 // 100 + 1))
            t = np.concatenate((s[drop:], rnd.integers(0, 1 << 63, add, dtype=np.uint64)))
            both, union = n - drop, n + add
            if 100 * both >= 85 * union and (drop or add):
                assert len(np.intersect1d(jaccard.signatures(s, 85, parts, miss), jaccard.signatures(t, 85, parts, miss)))


def test_strangers_share_no_signatures():
    import numpy as np

    rnd = np.random.default_rng(4)
    for percent, share in [(85, 0.4), (80, 0.55)]:
        for n in [7, 8, 12, 13, 20, 60, 300, 1000]:
            signs = [set(jaccard.signatures(rnd.integers(0, 1 << 63, n, dtype=np.uint64), percent).tolist()) for _ in range(300)]
            assert len(set.union(*signs)) == sum(map(len, signs))
            assert max(map(len, signs)) <= share * n + 2


def test_spoiled_is_the_most():
    from itertools import combinations, combinations_with_replacement

    for groups, parts, miss in [(3, 2, 1), (2, 3, 1), (4, 1, 0), (2, 4, 2)]:
        subsets = [{(g, p) for p in c} for g in range(groups) for c in combinations(range(parts), parts - miss)]
        places = [(g, p) for g in range(groups) for p in range(parts)]
        for k in range(groups * (miss + 1)):
            most = max(sum(bool(s & set(hit)) for s in subsets) for hit in combinations_with_replacement(places, k))
            assert most == jaccard.spoiled(k, groups, parts, miss) < len(subsets)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(500, x) for x in range(501, 560)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b}
    assert all(got.get(x, x) == find(x) for x in root) and set(root) - loops <= set(got)
