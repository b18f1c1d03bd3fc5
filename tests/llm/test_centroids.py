import hashlib
import math

import numpy as np
import pytest

from tablewise.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, q string"
COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def brute(rows, k=8, rounds=10, dims=64):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            kept.append((vec_id, [math.floor(1024 * float(np.float32(x))) for x in e]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [q for _, q in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, m)), i) for i, m in enumerate(c)) for _, q in kept]

    for _ in range(rounds):
        near = assign()
        for i in range(len(c)):
            members = [q for (_, q), (_, j) in zip(kept, near) if j == i]
            if members:
                c[i] = [sum(col) // len(members) for col in zip(*members)]
    near = assign()
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((v, j, d, sum(x for x, y in near if y == j), sum(x for x, _ in near), sha[j]) for (v, _), (d, j) in zip(kept, near)), key=str)


def vectors(n, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(0, spread, 64).astype(np.float32)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(v, e, 1, 2, "x") for v, e in rows], SCHEMA).repartition(3)


def rows_of(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=str)


def test_against_brute_force(spark):
    odd = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.1] * 63), (905, [float("nan")] + [0.1] * 63),
           (906, [float("inf")] + [0.1] * 63), (907, [0.0] * 64), (None, [0.25] * 64), (908, [-0.0004882] * 64)]
    rows = vectors(150, 2) + odd + vectors(3, 2) * 4
    assert rows_of(centroids.cluster(frame(spark, rows))) == brute(rows)


def test_ties_and_empty_clusters(spark):
    # equal vectors: equal centroids, of which the later ones stay empty
    rows = [(i, [1.0] * 64) for i in range(20)] + [(50 + i, [float(i % 2)] * 64) for i in range(9)]
    assert rows_of(centroids.cluster(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_clusters(spark, n):
    rows = vectors(n, 4)
    assert rows_of(centroids.cluster(frame(spark, rows))) == brute(rows)


def test_large_components(spark):
    rows = vectors(30, 6, spread=20000.0)
    assert rows_of(centroids.cluster(frame(spark, rows))) == brute(rows)
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(frame(spark, rows + [(99, [1e30] * 64)])).collect()


def test_general_form(spark):
    rows = [(i, [float(i % 5), float(i)]) for i in range(12)]
    got = centroids.cluster(frame(spark, rows), k=3, rounds=4, dims=2)
    assert rows_of(got) == brute(rows, k=3, rounds=4, dims=2)
