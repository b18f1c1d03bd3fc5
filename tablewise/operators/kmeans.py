"""K-means for many (k, restart) pairs in shared scans.

All models advance together: one job an iteration reads each row once, finds its
nearest centre in every model that still moves, and adds up sums and counts per
centre in numpy over Arrow batches, with a matrix product for all models at once
(rows that its rounding leaves open are compared by their differences); the last
scan adds up the costs. Partial sums meet by model in a
shuffle (on the driver while they are at most GATHER numbers, with the same
result); the driver holds the centres. Starting centres are drawn by k-means++
from a sample of at most ``sample`` rows, the rows of least hash; everything
after that reads all rows. An empty cluster keeps its centre.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GATHER = 1 << 21
ROWS = 1 << 12  # rows of a matrix product
_SUMS = "model int, part int, sums array<double>, counts array<long>, cost double"
_MERGED = "model int, sums array<double>, counts array<long>, cost double"


@dataclass
class CentroidModel:
    """Centres of one model; ``transform`` adds the nearest one's number as ``prediction`` (ties: the smaller number)."""
    centers: np.ndarray
    cost: float
    iterations: int
    features_col: str = "features"

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centers)

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(F.col(self.features_col))
        near = F.array_min(F.array(*[F.struct(F.aggregate(F.zip_with(x, F.lit([float(v) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b).alias("d"), F.lit(i).alias("i"))
                                     for i, c in enumerate(self.centers)]))
        return df.withColumn("prediction", near["i"])


def plus_plus(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ on a sample: each next centre with probability in proportion to its squared distance from the nearest one."""
    rng = np.random.default_rng(seed)
    centers = [x[rng.integers(len(x))]]
    near = ((x - centers[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = near.sum()
        at = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
        centers.append(x[at])
        near = np.minimum(near, ((x - x[at]) ** 2).sum(axis=1))
    return np.array(centers)


def _nearest(x: np.ndarray, size: np.ndarray, near: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centre of each row (ties: the smaller number). ``near``: |c|^2 - 2xc from a matrix product;
    rows whose first two come closer than its rounding are settled by their differences."""
    best = near.argmin(axis=1)
    slack = 16 * (c.shape[1] + 4) * np.finfo(float).eps * (size + (c * c).sum(axis=1).max())
    close = np.flatnonzero((near <= (near[np.arange(len(x)), best] + slack)[:, None]).sum(axis=1) != 1)  # or not a number
    if len(close):
        best[close] = np.stack([((x[close] - m) ** 2).sum(axis=1) for m in c], axis=1).argmin(axis=1)
    return best


def _kernel(models: dict[int, np.ndarray], with_cost: bool):
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        every = np.concatenate(list(models.values()))
        ends = np.cumsum([len(c) for c in models.values()])
        own = {j: slice(z - len(c), z) for (j, c), z in zip(models.items(), ends)}
        added, number = np.zeros(every.shape), np.zeros(len(every), np.int64)
        cost = dict.fromkeys(models, 0.0)
        for b in batches:
            if not b.num_rows:
                continue
            whole = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for a in range(0, len(whole), ROWS):
                x = whole[a:a + ROWS]
                size, at = (x * x).sum(axis=1), np.arange(len(x))
                product = (every * every).sum(axis=1) - 2 * (x @ every.T)
                hot = np.zeros((len(every), len(x)))
                for j, c in models.items():
                    near = _nearest(x, size, product[:, own[j]], c)
                    hot[own[j].start + near, at] = 1
                    if with_cost:
                        cost[j] += ((x - c[near]) ** 2).sum(axis=1).sum()
                added += hot @ x
                number += hot.sum(axis=1).astype(np.int64)
        sums, counts = {j: added[s] for j, s in own.items()}, {j: number[s] for j, s in own.items()}
        names = sorted(models)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([part] * len(names), pa.int32()), pa.array([sums[j].ravel() for j in names], pa.list_(pa.float64())),
                                          pa.array([counts[j] for j in names], pa.list_(pa.int64())), pa.array([cost[j] for j in names])], ["model", "part", "sums", "counts", "cost"])

    return run


def _merge(key, pdf):
    pdf = pdf.sort_values("part")  # the same order of additions whatever came first
    return pd.DataFrame([(int(key[0]), np.sum(np.stack(pdf["sums"].to_numpy()), axis=0), np.sum(np.stack(pdf["counts"].to_numpy()), axis=0), float(pdf["cost"].sum()))],
                        columns=["model", "sums", "counts", "cost"])


def _scan(data: DataFrame, tasks: int, models: dict[int, np.ndarray], with_cost: bool = False) -> dict:
    """{model: (sums, counts, cost)} of one scan for all models; costs are 0 unless asked for."""
    sums = data.mapInArrow(_kernel(models, with_cost), _SUMS)
    if tasks * sum(c.size + len(c) + 1 for c in models.values()) <= GATHER:
        rows = [_merge((k,), part).iloc[0] for k, part in sums.toArrow().to_pandas().groupby("model")]
    else:
        rows = sums.groupBy("model").applyInPandas(_merge, _MERGED).collect()
    return {int(r["model"]): (np.array(r["sums"]).reshape(models[int(r["model"])].shape), np.array(r["counts"]), float(r["cost"])) for r in rows}


def fit_many(features: DataFrame, wanted: list[tuple[int, int]], features_col: str = "features", max_iter: int = 300, tol: float = 1e-4, sample: int = 4096) -> list[CentroidModel]:
    """A model for each (k, seed) of ``wanted``, all fitted in shared scans."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package
    data = features.select(vector_to_array(F.col(features_col)).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tasks = data.rdd.getNumPartitions()
        first = data.select("x", F.xxhash64("x", F.monotonically_increasing_id()).alias("h")).orderBy("h").limit(sample).collect()
        x = np.array(sorted([list(r["x"]) for r in first]))
        centers = [plus_plus(x, k, seed) for k, seed in wanted]
        moving, iterations = set(range(len(wanted))), [0] * len(wanted)
        for _ in range(max_iter):
            if not moving:
                break
            for j, (sums, counts, _cost) in _scan(data, tasks, {j: centers[j] for j in moving}).items():
                new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers[j])
                shift = ((new - centers[j]) ** 2).sum(axis=1).max()
                centers[j], iterations[j] = new, iterations[j] + 1
                if shift <= tol * tol:
                    moving.discard(j)
        last = _scan(data, tasks, dict(enumerate(centers)), True)
        return [CentroidModel(c, last[j][2], iterations[j], features_col) for j, c in enumerate(centers)]
    finally:
        data.unpersist()
