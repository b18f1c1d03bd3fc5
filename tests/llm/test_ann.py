import math

import numpy as np
import pytest

from tablewise.llm import ann


def brute(rows, k=10, every=100):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and not any(x is None or not math.isfinite(x) for x in v) and any(v)]
    good = [(i, np.array(v)) for i, v in sorted({(i, tuple(v)) for i, v in good})]
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = near[:k]
    return out


def test_small_table_is_exact(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(500)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(600, [0.0] * 8), (700, None), (800, [1.0, None] + [0.0] * 6), (900, [float("nan")] * 8), (None, rows[0][1]), (200, rows[200][1])]
    rows += [(2000, [1.0, 2.0]), (2001, [1.0, 3.0]), (2100, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, score int")
    got = {}
    for r in ann.nearest(df, shard_rows=150).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = brute(rows)
    assert set(got) == {q for q, near in want.items() if near}
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1))
        assert [f[1:] for f in found] == sorted(f[1:] for f in found)
        hits += len({f[2] for f in found} & {j for _, j in want[q]})
        total += len(want[q])
        dist = dict((j, s) for s, j in want[q])
        assert all(abs(dist[f[2]] - f[1]) < 1e-12 for f in found if f[2] in dist)
    assert hits >= 0.99 * total
    assert ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["spread", "clusters"])
def test_recall(kind):
    rnd = np.random.default_rng(1)
    n, d = 4000, 32
    x = rnd.normal(size=(n, d)) if kind == "spread" else rnd.normal(size=(40, d))[rnd.integers(0, 40, n)] * 5 + rnd.normal(size=(n, d)) * 0.3
    layers, links = ann.build(x, rnd.integers(0, 1 << 63, n), 16)
    q = x[:200]
    rows, dist = ann.search(q, x, layers, links, 96)
    true = np.argsort(((q[:, None] - x[None]) ** 2).sum(2), axis=1)[:, :11]
    assert np.mean([len(set(a[:11]) & set(b)) / 11 for a, b in zip(rows, true)]) >= (0.9 if kind == "spread" else 0.95)
