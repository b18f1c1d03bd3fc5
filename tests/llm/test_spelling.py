import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tablewise.llm import spelling

from .conftest import collect, rows_of_documents


def brute_words(rows, least=5, n=3, one_in=97):
    c = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % one_in == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            c[w] += 1
    return {w: k for w, k in c.items() if len(w) >= least and k >= n}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    out = []
    forms = {}
    for w in words:
        near = [x for x in words if is_near(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = (best if best is not None and words[best] >= 2 * words[w] else None, len(near))
    for w in words:
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        f = forms[w][0]
        out.append((w, f, root, words[w], forms[w][1], words[f] if f else None))
    return sorted(out)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def noisy_rows():
    rng = np.random.default_rng(5)
    parts = ["ab", "an", "çà", "then", "oré", "ti", "ing", "ba", "ÿa", "aa", "lo", "zz"]
    stems = ["".join(rng.choice(parts, rng.integers(2, 5))) for _ in range(50)] + ["aaaaaa", "abababab", "Àlphabet", "àlphabet", "hyphen×word"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = list(stems[int(rng.zipf(1.4)) % len(stems)])
            if rng.random() < 0.4:
                k = int(rng.integers(0, len(w)))
                kind = int(rng.integers(0, 3))
                w = w[:k] + ([] if kind == 0 else ["x"] if kind == 1 else [w[k], "y"]) + w[k + 1:]
            words.append("".join(w).upper() if rng.random() < 0.2 else "".join(w))
        rows.append((i, ", ".join(words)))
    return rows


def test_against_all_pairs(spark):
    rows = noisy_rows()
    words = brute_words(rows)
    assert len(words) > 150
    got = spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute(words)
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == want
    assert any(r[2] not in (r[0], r[1]) for r in want), "no chain of forms in the fixture"


def test_edge_rows(docs, no_docs):
    rows = [(r[0], r[1]) for r in rows_of_documents()]
    got = spelling.group_variants(docs)
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == brute(brute_words(rows))
    assert spelling.group_variants(no_docs).count() == 0


def test_misspelling(spark):
    rows = [(i, "Straßen Überall" if i % 2 else "straßen") for i in range(400)]
    got = spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string"), least_n=1)
    assert dict(collect(got)) == brute_words(rows, n=1)
    assert len(brute_words(rows, n=1)) > 4


def test_long_words(spark):
    long = "ab" * 3000
    rows = [(1, " ".join([long] * 6 + [long[:-1] + "c"] * 3 + [long + "d"] * 3 + [long[:50]] * 3))]
    got = spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string"), one_in=1 << 40)
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == brute(brute_words(rows, one_in=1 << 40))


def test_pivots_are_disjoint_and_cheapest():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 6, (40, 9))
    cost = rng.integers(1, 50, spelling.LETTERS ** 2).astype(float)
    rank = np.argsort(np.argsort(cost, kind="stable"), kind="stable").astype(np.int32)
    last, prefix, pair = spelling.choose(codes, rank, cost)
    for k in range(40):
        grams = codes[k, :-1] * spelling.LETTERS + codes[k, 1:]
        places = np.flatnonzero(rank[grams] <= np.sort(rank[grams])[2])
        assert list(np.flatnonzero(prefix[k])) == list(places) and last[k] == np.sort(rank[grams])[2]
        best = min(cost[grams[i]] + cost[grams[j]] for i in places for j in places if j >= i + 2)
        assert pair[k, 1] >= pair[k, 0] + 2 and cost[grams[pair[k]]].sum() == best


def test_roots_follow_to_the_last(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "d"), ("p", "q")], "word string, form string")
    assert dict(collect(spelling.roots(edges))) == {"a": "d", "b": "d", "c": "d", "x": "d", "p": "q"}
    assert spelling.roots(edges.where(F.lit(False))).count() == 0
