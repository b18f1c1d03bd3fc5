import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablewise.llm import suffix

from .conftest import rows_of_documents


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha256, rest) of each text, by all windows."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        gone[-1] = False
        rest = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        runs = int(np.sum(gone[:-1] & ~np.concatenate(([False], gone[:-1][:-1])))) if len(b) else 0
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def made(n=90, seed=4):
    rnd = random.Random(seed)

    def words(k):
        return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(k))

    shared = [words(k) for k in (45, 60, 80, 300)]
    texts = []
    for i in range(n):
        t = words(rnd.randint(0, 200))
        for s in rnd.sample(shared, rnd.randint(0, 2)):
            if rnd.random() < 0.7:
                lo = rnd.randint(0, 60)
                s = s[lo:lo + rnd.randint(150, 500)]
            at = rnd.randint(0, len(t))
            t = t[:at] + s + t[at:]
        texts.append(t)
    for i in range(20):  # near copies, copies, periodic and inner repeats
        t = texts[i]
        at = rnd.randint(0, len(t))
        texts.append(t[:at] + "#" + t[at:])
        if i % 4 == 0:
            texts.append(t)
    return texts + ["x" * 199, "x" * 200, "y" * 199, "z" * 201, "ab" * 150, shared[3] * 3, None, "", words(30000)]


@pytest.mark.parametrize("length,batches", [(200, 4), (200, 3)])
def test_against_all_windows(spark, length, batches):
    texts = made()
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, h int, n_bytes string").repartition(4)
    want = brute(texts, length)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.digest(df, length, batches).collect()}
    assert len(got) == len(texts)
    assert {i: got[i] for i in got} == dict(enumerate(want))


def test_repeated_rows_and_removal(docs, no_docs):
    rows = rows_of_documents()
    want = Counter((r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows], 200)))
    assert Counter(map(tuple, suffix.digest(docs).collect())) == want
    out = suffix.remove(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    sizes = {r[0]: None if r[1] is None else len(r[1].encode()) for r in rows}
    lost = defaultdict(int)
    for (i, n, gone, *_), k in want.items():
        lost[i] = gone
    for r in out.collect():
        assert (r.text is None) == (sizes[r.doc_id] is None)
        if r.text is not None:
            assert len(r.text.encode()) == sizes[r.doc_id] - lost[r.doc_id]
    assert suffix.digest(no_docs).count() == 0


def test_anchors_follow_the_window():
    rnd = np.random.default_rng(0)
    h = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64)
    got = suffix.anchor_of(h, 169)
    assert len(got) == 3000 - 168
    assert all(got[i] == i + np.argmin(h[i:i + 169]) for i in range(len(got)))
