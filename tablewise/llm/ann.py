"""Approximate nearest neighbours (operator 5): one navigable small-world
hierarchy per shard, stored as flat neighbour arrays; shard results merged.

Equal vectors are one node that carries its smallest ids, so copies neither
bend the graph nor crowd a shard. Nodes are dealt to shards of about
``shard_rows`` by hash. A node's top layer follows a geometric law of its hash;
each layer links its nodes to near ones, thinned so that links point apart
(a neighbour that is nearer to a kept neighbour than to the node is passed
over), and back. Searches run for a block of queries at once: a beam descends
the layers, each step expanding the best open node of every query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

INDEX = "shard int, dim int, members array<array<long>>, vectors binary, nodes array<binary>, links array<binary>"
BLOCKS = "dim int, block int, ids binary, vectors binary"
FOUND = "query_id long, vec_id array<long>, score double"


def usable(vector: Column) -> Column:
    """Neither null, empty or zero, nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _near(x: np.ndarray, among: np.ndarray, k: int, step: int = 1024) -> np.ndarray:
    """Rows of ``among`` nearest to each row of x, nearest first."""
    norms = (among ** 2).sum(1)
    out = np.empty((len(x), k), np.int32)
    for i in range(0, len(x), step):
        d = norms - 2 * (x[i:i + step] @ among.T)
        part = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(among) else np.tile(np.arange(len(among)), (len(d), 1))
        order = np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable")
        out[i:i + step] = np.take_along_axis(part, order, 1)
    return out


def link(x: np.ndarray, degree: int, wide: int = 3) -> np.ndarray:
    """Neighbour array (n x 2 degree, -1 where empty) of one layer's vectors."""
    n = len(x)
    out = np.full((n, 2 * degree), -1, np.int32)
    if n < 2:
        return out
    near = _near(x, x, min(n, degree * wide + 1))
    chosen = np.full((n, degree), -1, np.int32)
    for i in range(n):
        c = near[i][near[i] != i]
        v = x[c]
        own = ((v - x[i]) ** 2).sum(1)
        norms = (v ** 2).sum(1)
        between = norms[:, None] + norms[None] - 2 * (v @ v.T)
        kept: list[int] = []
        for j in range(len(c)):
            if len(kept) == degree:
                break
            if not kept or between[j, kept].min() > own[j]:
                kept.append(j)
        rest = [j for j in range(len(c)) if j not in set(kept)][:max(0, degree // 2 - len(kept))]
        take = c[kept + rest]
        chosen[i, :len(take)] = take
    # links back, own links first, each once, while there is room
    i, j = np.repeat(np.arange(n), degree), chosen.ravel().astype(np.int64)
    i, j = i[j >= 0], j[j >= 0]
    src, dst = np.concatenate((i, j)), np.concatenate((j, i))
    once = np.sort(np.unique(src * n + dst, return_index=True)[1])
    src, dst = src[once], dst[once]
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    col = np.arange(len(src)) - np.searchsorted(src, src)
    room = col < 2 * degree
    out[src[room], col[room]] = dst[room]
    return out


def build(x: np.ndarray, keys: np.ndarray, degree: int = 16) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(nodes, links) of each layer, lowest first; links name rows of x."""
    u = (keys.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    top = np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(degree)).astype(int)
    layers, links = [], []
    for level in range(top.max() + 1):
        nodes = np.flatnonzero(top >= level)
        if level and len(nodes) < 2:
            break
        own = link(x[nodes], degree)
        layers.append(nodes.astype(np.int32))
        links.append(np.where(own >= 0, nodes[own], -1).astype(np.int32))
        if len(nodes) <= 2 * degree:
            break
    return layers, links


def search(q: np.ndarray, x: np.ndarray, layers: list[np.ndarray], links: list[np.ndarray], beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of a beam per query, nearest first; -1 where fewer are found."""
    start = layers[-1][:beam]
    rows = np.tile(start, (len(q), 1))
    dist = np.sqrt(((q[:, None] - x[start][None]) ** 2).sum(2))
    for nodes, near in zip(layers[::-1], links[::-1]):
        place = np.full(len(x), -1, np.int32)
        place[nodes] = np.arange(len(nodes))
        seen = np.zeros((len(q), len(x) + 1), bool)  # the last column stands for "none"
        seen[:, -1] = True
        seen[np.arange(len(q))[:, None], rows] = True
        opened = rows >= 0
        while True:
            best = np.where(opened, dist, np.inf)
            at = best.argmin(1)
            go = np.flatnonzero(np.isfinite(best[np.arange(len(q)), at]))
            if not len(go):
                break
            opened[go, at[go]] = False
            new = near[place[rows[go, at[go]]]]
            new = np.where(seen[go[:, None], new], -1, new)
            seen[go[:, None], new] = True
            d = np.sqrt(((q[go][:, None] - x[new]) ** 2).sum(2))
            d[new < 0] = np.inf
            all_rows, all_dist = np.concatenate((rows[go], new), 1), np.concatenate((dist[go], d), 1)
            all_open = np.concatenate((opened[go], new >= 0), 1)
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            width = order.shape[1]
            if rows.shape[1] < width:
                grow = width - rows.shape[1]
                rows = np.pad(rows, ((0, 0), (0, grow)), constant_values=-1)
                dist = np.pad(dist, ((0, 0), (0, grow)), constant_values=np.inf)
                opened = np.pad(opened, ((0, 0), (0, grow)))
            rows[go], dist[go], opened[go] = np.take_along_axis(all_rows, order, 1), np.take_along_axis(all_dist, order, 1), np.take_along_axis(all_open, order, 1)
            rows = np.where(np.isfinite(dist), rows, -1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(rows, order, 1), np.take_along_axis(dist, order, 1)


def _build_shard(degree: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        layers, links = build(x, pdf["key"].to_numpy(), degree)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "dim": [x.shape[1]], "members": [[list(m) for m in pdf["members"]]], "vectors": [x.tobytes()],
                             "nodes": [[a.tobytes() for a in layers]], "links": [[a.tobytes() for a in links]]})

    return run


def build_index(vectors: DataFrame, k: int = 10, shard_rows: int = 8192, degree: int = 16) -> DataFrame:
    """The index table, one row a shard, of ``vectors`` (vec_id, embedding).

    Every usable row is indexed; a node carries its k + 1 smallest ids, more
    than any list of k can show.
    """
    v = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    v = v.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).distinct()
    by = Window.partitionBy("vector").orderBy("vec_id")
    v = v.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
    nodes = v.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    nodes = save(nodes.withColumn("key", F.xxhash64("vector")).withColumn("dim", F.size("vector")), "ann-nodes")
    shards = {r["dim"]: -(-r["n"] // shard_rows) for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row a dimension
    if not shards:
        return nodes.sparkSession.createDataFrame([], INDEX)
    of = F.element_at(F.create_map(*[F.lit(x) for kv in shards.items() for x in kv]), F.col("dim"))
    first, base = [], 0
    for dim, n in shards.items():
        first += [F.lit(dim), F.lit(base)]
        base += n
    nodes = nodes.withColumn("shard", (F.element_at(F.create_map(*first), F.col("dim")) + F.pmod(F.xxhash64("key"), of)).cast("int"))
    return save(nodes.groupBy("shard").applyInPandas(_build_shard(degree), INDEX), "ann-index")


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
    return pd.DataFrame({"dim": [x.shape[1]], "block": [pdf["block"].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()]})


def _search(k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                x = np.frombuffer(r["vectors"]).reshape(-1, r["dim"])
                ids, q = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q"]).reshape(-1, r["dim"])
                layers = [np.frombuffer(b, np.int32) for b in r["nodes"]]
                links = [np.frombuffer(b, np.int32).reshape(len(n), -1) for b, n in zip(r["links"], layers)]
                low = np.array([m[0] for m in r["members"]])
                for s in range(0, len(q), 256):
                    rows, dist = search(q[s:s + 256], x, layers, links, beam)
                    order = np.lexsort((np.where(rows >= 0, low[rows], 0), dist), axis=1)[:, :k + 1]
                    rows, dist = np.take_along_axis(rows, order, 1), np.take_along_axis(dist, order, 1)
                    at, col = np.nonzero(rows >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s:s + 256][at], pa.int64()), pa.array([r["members"][j] for j in rows[at, col]], pa.list_(pa.int64())),
                                                      pa.array(dist[at, col])], ["query_id", "vec_id", "score"])

    return run


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = 96, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (vec_id, embedding).

    Blocks of queries meet every shard of their dimension; ``index`` is stored.
    """
    q = queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).distinct()
    q = save(q, "ann-queries")
    blocks = max(1, -(-q.count() // block_rows))
    packed = q.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")).withColumn("d", F.size("vector"))
    packed = save(packed.groupBy("d", "block").applyInPandas(lambda pdf: _pack_block(pdf), BLOCKS), "ann-blocks")
    meet = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed.withColumnRenamed("vectors", "q"), ["dim", "block"])
    found = meet.select("dim", "members", "vectors", "nodes", "links", "ids", "q").mapInArrow(_search(k, beam), FOUND)
    found = found.select("query_id", F.explode("vec_id").alias("vec_id"), "score").where("vec_id <> query_id")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, shard_rows: int = 8192, degree: int = 16, beam: int = 96,
            vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest rows to each row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score (Euclidean, double), nearest
    first, ties to the smaller id. A row whose vector is null, empty, zero, or
    holds null or non-finite components, or whose id is null, takes no part.
    Rows that repeat id and vector count once; rows with a query's id are never
    its neighbours; vectors meet only those of their own length; an id with
    several vectors has one list over all of them. Other columns are not looked at.
    """
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    index = build_index(v, k, shard_rows, degree)
    return search_index(index, v.where(F.col("vec_id") % every == 0), k, beam)
