import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tablewise.operators import kmeans as KM
from tablewise.operators import models as M


def lloyd(x, centers, tol=1e-4, max_iter=300):
    for i in range(max_iter):
        near = np.array([min(range(len(centers)), key=lambda j: ((r - centers[j]) ** 2).sum()) for r in x])
        new = np.array([x[near == j].mean(axis=0) if (near == j).any() else centers[j] for j in range(len(centers))])
        done = ((new - centers) ** 2).sum(axis=1).max() <= tol * tol
        centers = new
        if done:
            break
    return centers, sum(min(((r - c) ** 2).sum() for c in centers) for r in x)


def points(spark, seed=1, n=200):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.4, (n // 4, 3)) for c in (0, 3, 6, 9)])
    return x, spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["id", "features"]).repartition(3)


@pytest.mark.parametrize("gather", [0, 1 << 21])
def test_shared_scans_equal_plain_lloyd(spark, monkeypatch, gather):
    monkeypatch.setattr(KM, "GATHER", gather)
    x, df = points(spark)
    wanted = [(k, s) for k in (2, 4) for s in (5, 6)]
    models = KM.fit_many(df, wanted)
    start = np.array(sorted(x.tolist()))
    for (k, s), m in zip(wanted, models):
        centers, cost = lloyd(x, KM.plus_plus(start, k, s))
        assert np.allclose(m.centers, centers, atol=1e-9) and m.cost == pytest.approx(cost, rel=1e-9)
    got = {r["id"]: r["prediction"] for r in models[2].transform(df).collect()}
    assert all(got[i] == ((models[2].centers - r) ** 2).sum(axis=1).argmin() for i, r in enumerate(x))


def test_one_scan_an_iteration(spark, monkeypatch):
    _, df = points(spark, 3)
    scans = []
    scan = KM._scan
    monkeypatch.setattr(KM, "_scan", lambda *a: scans.append(1) or scan(*a))
    run = M.kmeans_search(df, ks=(2, 3, 4), restarts=5)
    assert run.best_k == 4 and len(scans) <= 1 + max(m.iterations for m in KM.fit_many(df, [(k, 42 + r) for k in (2, 3, 4) for r in range(5)]))


def test_equal_rows_and_empty_clusters(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 1.0]),)] * 30 + [(Vectors.dense([5.0, 1.0]),)], ["features"])
    m, = KM.fit_many(df, [(3, 1)])
    assert m.cost == 0.0 and len(m.clusterCenters()) == 3


def test_nearest_by_products_is_that_by_differences():
    """Far from zero the products lose all digits that tell the centres apart; ties go to the smaller number."""
    rng = np.random.default_rng(4)
    for shift in (0.0, 1e9):
        x = rng.integers(-3, 4, (500, 3)) + shift
        c = rng.integers(-3, 4, (6, 3)) + shift
        c[4] = c[1]
        want = np.array([((r - c) ** 2).sum(axis=1).argmin() for r in x])
        product = (c * c).sum(axis=1) - 2 * (x @ c.T)
        assert (KM._nearest(x, (x * x).sum(axis=1), product, c) == want).all()
    assert (product.argmin(axis=1) != want).any()


def test_costs_are_added_up_once(spark, monkeypatch):
    _, df = points(spark, 5)
    asked, kernel = [], KM._kernel
    monkeypatch.setattr(KM, "_kernel", lambda models, with_cost: asked.append(with_cost) or kernel(models, with_cost))
    KM.fit_many(df, [(3, 1), (4, 2)])
    assert asked[-1] and not any(asked[:-1]) and len(asked) > 2
