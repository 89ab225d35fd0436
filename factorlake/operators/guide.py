"""Guided factorisation: targets from labels, and refinement of embeddings towards or away from them."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.matrix import MatrixFrame
from .models import NMF
from .nmf import project
from .passes import adverse
from .solve import nnls


def centroids(h: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(label, n, c0..ck-1): class means of h; null labels are left out."""
    e = h.join(labels.where("label is not null"), "j")
    return e.groupBy("label").agg(F.count("*").alias("n"), *[F.avg(F.col("h")[r]).alias(f"c{r}") for r in range(k)])


def _whitener(c: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """ZCA of the centroids' covariance, shrunk towards a multiple of the identity (oracle-approximating shrinkage)."""
    n, k = c.shape
    s = np.cov(c.T, bias=True).reshape(k, k)
    mu = np.trace(s) / k
    alpha = float((s**2).mean())
    den = (n + 1) * (alpha - mu**2 / k)
    rho = 1.0 if den == 0 else min(1.0, (alpha + mu**2) / den)
    val, vec = np.linalg.eigh((1 - rho) * s + rho * mu * np.eye(k))
    return (vec / np.sqrt(np.maximum(val, 1e-10))) @ vec.T


def target(h: DataFrame, labels: DataFrame, k: int, whiten: bool = False) -> DataFrame:
    """(j, t): the centred centroid of each sample's class; zeros for a null label."""
    rows = centroids(h, labels, k).orderBy("label").collect()  # a row a class
    if not rows:
        return h.select("j", F.array(*[F.lit(0.0)] * k).alias("t"))
    c = np.array([[r[f"c{x}"] for x in range(k)] for r in rows])
    c = c - c.mean(axis=0)
    if whiten and len(c) > 1:
        c = c @ _whitener(c, np.array([r["n"] for r in rows]))
    table = h.sparkSession.createDataFrame([(r["label"], x.tolist()) for r, x in zip(rows, c)], labels.select("label").schema.add("t", T.ArrayType(T.DoubleType())))
    joined = h.select("j").join(labels, "j", "left").join(F.broadcast(table), "label", "left")
    return joined.select("j", F.coalesce("t", F.array(*[F.lit(0.0)] * k)).alias("t"))


def refine(model: NMF, a: MatrixFrame, labels: DataFrame, batch: DataFrame | None = None, weight: float = 0.8, cycles: int = 1, nonneg: bool = True, whiten: bool = False, batch_weight: float = 0.5) -> NMF:
    """h + weight * t * |h| / |t|; batch directions are taken out; further cycles refit w and h by ridge steps."""
    k, out = model.k, model
    for cycle in range(max(1, cycles)):
        t = target(out.h, labels, k, whiten)
        e = out.h.join(t, "j")
        sq = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x * x)
        r = e.agg(F.sum(sq("h")), F.sum(sq("t"))).first()
        by = weight * float(np.sqrt((r[0] or 0.0) / r[1])) if r[1] else 0.0
        moved = F.zip_with("h", "t", lambda x, y: F.greatest(x + y * by, F.lit(0.0)) if nonneg else x + y * by)
        h = e.select("j", moved.alias("h"))
        if batch is not None:
            tb = centroids(h, batch.withColumnRenamed("batch", "label") if "batch" in batch.columns else batch, k).collect()
            c = np.array([[x[f"c{q}"] for q in range(k)] for x in tb])
            if len(c) > 1:
                c = c - c.mean(axis=0)
                g = adverse(np.eye(k), c, batch_weight)
                h = h.select("j", F.array(*[sum((F.col("h")[q] * float(g[q, p]) for q in range(k)), F.lit(0.0)) for p in range(k)]).alias("h"))
                if nonneg:
                    h = h.select("j", F.transform("h", lambda x: F.greatest(x, F.lit(0.0))).alias("h"))
        out = replace(out, h=h)
        if cycle + 1 < cycles:
            from .linalg import gram, rhs_transposed

            b = rhs_transposed(a, h, k).toPandas()
            x = np.zeros((a.m, k))
            x[b["i"].to_numpy()] = b[[f"b{q}" for q in range(k)]].to_numpy()
            w = nnls(gram(h, k) + 1e-8 * np.eye(k), x.T, nonneg=nonneg).T
            d = np.abs(w).sum(axis=0) + 1e-15
            out = replace(out, w=w / d, d=d, h=project(a, w / d, l2=1e-8, nonneg=nonneg))
    return out
