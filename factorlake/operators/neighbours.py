"""Exact nearest neighbours. A reference side of bounded size is broadcast. Beyond that both sides are dealt into blocks of bounded
size, each pair of blocks meets in a task of its own, and the best of each block are merged. No product of the two sides is ever
rows of a DataFrame.

Euclidean distances are sorted out by matrix products, whose error has a bound; what may be among the nearest is computed again by
differences, so that near ties and equal vectors come out as if all pairs had been."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REF_VALUES = 4_000_000  # numbers of one side held at once
BLOCK_VALUES = 1_000_000  # x-rows * y-rows * width of the differences held at once
TILE = 256, 8192  # rows of x and y whose products are held at once
TASK_ROWS = 1024  # queries of a task
NEAR = "id long, other long, dist double"


def knn(queries: DataFrame, refs: DataFrame, k: int, metric: str = "euclidean", exclude_self: bool = True, ref_values: int = REF_VALUES) -> DataFrame:
    """(id, other, dist, rank) from (id, x) and (id, x): the k smallest distances, ties by other; cosine is 1 - similarity."""
    if metric not in ("euclidean", "cosine"):
        raise ValueError("metric must be euclidean or cosine")
    spark = queries.sparkSession
    queries, refs = (d.select(F.col("id").alias("id"), F.col("x").alias("x")) for d in (queries, refs))  # fresh columns, as both may come from one frame
    one = refs.agg(F.count("*"), F.max(F.size("x"))).first()
    if not one[0]:
        return spark.createDataFrame([], "id long, other long, dist double, rank int")
    n, width = one
    blocks = max(1, -(-n * width // ref_values))
    if blocks == 1:
        shared = spark.sparkContext.broadcast(by_id(refs.toArrow()))
        return dealt(queries).mapInArrow(_near(shared, k, metric, exclude_self), NEAR + ", rank int")
    own = query_blocks(queries, width, blocks, ref_values)
    q = queries.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(own)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb"))
    r = refs.select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(own - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("rb"))
    keys = [F.col("qb").cast("int"), F.col("rb").cast("int")]
    out = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(_meet(k, metric, exclude_self), NEAR)
    w = Window.partitionBy("id").orderBy("dist", "other")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over so many tasks that each compares a bounded number of them."""
    n = rows.count()
    return rows.repartition(max(1, min(-(-n // 64), max(-(-n // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism))))


def query_blocks(queries: DataFrame, width: int, blocks: int, ref_values: int) -> int:
    """Blocks of the queries: of bounded size, and so many that all cores have pairs of blocks."""
    n, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n * width // ref_values), min(-(-3 * cores // blocks), n // TASK_ROWS))


def matrix(x: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long arrays."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    if not len(x):
        return np.empty((0, 0))
    return np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), float)


def by_id(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, x = t["id"].to_numpy().astype(np.int64), matrix(t["x"])
    o = np.argsort(ids, kind="stable")
    return ids[o], x[o]


def distances(x: np.ndarray, y: np.ndarray, metric: str, block_values: int = BLOCK_VALUES) -> np.ndarray:
    if metric == "cosine":
        return 1 - _unit(x) @ _unit(y).T
    out = np.empty((len(x), len(y)))
    width = max(1, x.shape[1])
    rows = max(1, block_values // width)
    for b in range(0, len(y), rows):  # by differences at every size: the expanded square loses near ties and equal vectors
        part = y[None, b : b + rows, :]
        step = max(1, block_values // (part.shape[1] * width))
        for a in range(0, len(x), step):
            d = x[a : a + step, None, :] - part
            d *= d
            out[a : a + step, b : b + rows] = np.sqrt(d.sum(axis=2))
    return out


def pairs(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, block_values: int = BLOCK_VALUES) -> np.ndarray:
    """Distances of x[a] and y[b] by differences."""
    out, step = np.empty(len(a)), max(1, block_values // max(1, x.shape[1]))
    for s in range(0, len(a), step):
        d = x[a[s : s + step]] - y[b[s : s + step]]
        d *= d
        out[s : s + step] = np.sqrt(d.sum(axis=1))
    return out


def inner(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, block_values: int = BLOCK_VALUES) -> np.ndarray:
    """Products of x[a] and y[b], the same for equal vectors wherever they stand."""
    step = max(1, block_values // max(1, x.shape[1]))
    return np.concatenate([np.empty(0), *((x[a[s : s + step]] * y[b[s : s + step]]).sum(axis=1) for s in range(0, len(a), step))])


def products(x: np.ndarray, y: np.ndarray, xx: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product, near ones inexact."""
    d = x @ y.T
    d *= -2
    d += yy
    d += xx[:, None]
    return d


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", x, x)


def too_large(xx: np.ndarray, yy: np.ndarray) -> bool:
    """Whether products of these squared lengths may not be finite."""
    return not (np.isfinite(xx).all() and np.isfinite(yy).all() and max(xx.max(initial=0), yy.max(initial=0)) < 1e300)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-15)


def _best(own: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int, metric: str, exclude_self: bool) -> tuple[np.ndarray, ...]:
    """(row of x, row of y, distance, rank) of the k nearest of y, whose ids rise, to each row; what is not finite is left out."""
    cosine = metric == "cosine"
    if cosine:
        x, y = _unit(x), _unit(y)
    xx, yy = squares(x), squares(y)
    plain = not cosine and too_large(xx, yy)
    # twice what the product's sum and the sum of squares can be off by
    scale = 1.0 if cosine else 0.0 if plain else xx + yy.max(initial=0)
    slack = np.broadcast_to(4 * (x.shape[1] + 4) * np.finfo(float).eps * scale, len(x))
    found = []
    for a in range(0, len(x), TILE[0]):
        s = slice(a, a + TILE[0])
        top = np.full(len(xx[s]), np.inf)  # the k-th so far
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        for b in range(0, len(y), TILE[1]):
            t = slice(b, b + TILE[1])
            if plain:
                d = distances(x[s], y[t], metric)
            else:
                d = products(x[s], y[t], xx[s], yy[t]) if not cosine else 1 - x[s] @ y[t].T
            if exclude_self:
                low, high = np.searchsorted(ids[t], own[s]), np.searchsorted(ids[t], own[s], "right")
                for r in np.flatnonzero(high > low):  # ids may repeat
                    d[r, low[r] : high[r]] = np.inf
            d[np.isnan(d)] = np.inf
            bound = top
            if d.shape[1] > k and not np.isfinite(top).all():
                bound = np.minimum(top, np.partition(d, k - 1, axis=1)[:, k - 1])
            r, c = np.nonzero(d <= (bound + slack[s])[:, None])
            ok = np.isfinite(d[r, c])
            r, c = r[ok], c[ok] + b
            d = 1 - inner(x[s], y, r, c) if cosine else pairs(x[s], y, r, c)
            r, c, d = (np.concatenate(z) for z in zip(best[:3], (r, c, d)))
            o = np.lexsort((ids[c], d, r))
            r, c, d = r[o], c[o], d[o]
            rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
            ok = rank <= k
            best = r[ok], c[ok], d[ok], rank[ok]
            last = best[3] == k
            top[best[0][last]] = best[2][last] if cosine or plain else best[2][last] ** 2
        found.append((best[0] + a, *best[1:]))
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))


def _near(shared, k: int, metric: str, exclude_self: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y = shared.value
        for batch in it:
            own = batch.column("id").to_numpy().astype(np.int64)
            r, c, d, rank = _best(own, matrix(batch.column("x")), ids, y, k, metric, exclude_self)
            yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(ids[c]), pa.array(d), pa.array(rank.astype(np.int32))], ["id", "other", "dist", "rank"])

    return run


def _meet(k: int, metric: str, exclude_self: bool):
    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        own, x = by_id(q)
        ids, y = by_id(r)
        if not len(own) or not len(ids):
            own, ids, a, b, d = own[:0], ids[:0], *(np.empty(0, t) for t in (np.int64, np.int64, float))
        else:
            a, b, d, _ = _best(own, x, ids, y, k, metric, exclude_self)
        return pa.table({"id": pa.array(own[a]), "other": pa.array(ids[b]), "dist": pa.array(d, pa.float64())})

    return run
