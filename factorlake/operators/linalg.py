"""Aggregates of factors and matrices as DataFrame plans: Gram, right-hand sides, cosine, losses, projections.

A factor is a DataFrame of an index and an array of length k. Sums are partial before any shuffle; a factor side is
broadcast only when its size in rows and k is given and under `BROADCAST_VALUES`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.losses import Loss, column
from ..sources.matrix import MatrixFrame

BROADCAST_VALUES = 12_000_000
RIDGE = 1e-15


def side(df: DataFrame, rows: int | None, k: int) -> DataFrame:
    """The factor, marked for broadcast while it is small enough."""
    return F.broadcast(df) if rows is not None and rows * k <= BROADCAST_VALUES else df


def gram(h: DataFrame, k: int, col: str = "h", ridge: float = RIDGE) -> np.ndarray:
    """H H' from one aggregation of k(k+1)/2 sums."""
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    r = h.agg(*[F.sum(F.col(col)[a] * F.col(col)[b]).alias(f"s{a}_{b}") for a, b in pairs]).first()
    out = np.zeros((k, k))
    for (a, b), x in zip(pairs, r):
        out[a, b] = out[b, a] = x or 0.0
    return out + ridge * np.eye(k)


def gram_frame(h: DataFrame, k: int, col: str = "h") -> DataFrame:
    """The same as rows (a, b, g), a <= b."""
    p = h.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(col)[a] * F.col(col)[b]).alias("x")) for a in range(k) for b in range(a, k)])).alias("p"))
    return p.groupBy("p.a", "p.b").agg(F.sum("p.x").alias("g"))


def rhs(a: MatrixFrame, w: DataFrame, k: int, rows: int | None = None) -> DataFrame:
    """(j, b0..bk-1) = W'A over the columns that have entries. w: (i, w)."""
    e = a.entries.join(side(w, rows, k), "i")
    return e.groupBy("j").agg(*[F.sum(F.col("v") * F.col("w")[r]).alias(f"b{r}") for r in range(k)])


def rhs_transposed(a: MatrixFrame, h: DataFrame, k: int, cols: int | None = None) -> DataFrame:
    """(i, b0..bk-1) = A H' with h: (j, h)."""
    e = a.entries.join(side(h, cols, k), "j")
    return e.groupBy("i").agg(*[F.sum(F.col("v") * F.col("h")[r]).alias(f"b{r}") for r in range(k)])


def sum_of_squares(a: MatrixFrame) -> float:
    return float(a.entries.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0)


def dot(x: Column, y: Column, k: int) -> Column:
    out = x[0] * y[0]
    for r in range(1, k):
        out = out + x[r] * y[r]
    return out


def fitted(a: MatrixFrame, w: DataFrame, d: np.ndarray, h: DataFrame, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """(i, j, v, mu) at the stored entries."""
    k = len(d)
    scaled = w.select("i", F.array(*[F.col("w")[r] * float(d[r]) for r in range(k)]).alias("w"))
    return a.entries.join(side(scaled, rows, k), "i").join(side(h, cols, k), "j").select("i", "j", "v", dot(F.col("w"), F.col("h"), k).alias("mu"))


def stored_loss(fit: DataFrame, loss: Loss) -> DataFrame:
    """Mean and total loss over stored entries, one row."""
    x = column(F.col("v"), F.col("mu"), loss)
    return fit.agg(F.sum(x).alias("total"), F.avg(x).alias("mean"), F.count("*").alias("n"))


def all_entries_sse(a: MatrixFrame, w: DataFrame, d: np.ndarray, h: DataFrame, rows: int | None = None) -> float:
    """Sum of squared errors over all m n entries, without forming the fitted matrix."""
    k = len(d)
    b = rhs(a, w, k, rows).join(h, "j")
    cross = b.agg(*[F.sum(F.col(f"b{r}") * F.col("h")[r]).alias(f"c{r}") for r in range(k)]).first()
    gw, gh = gram(w.withColumnRenamed("w", "h"), k, ridge=0), gram(h, k, ridge=0)
    return sum_of_squares(a) - 2 * float(np.dot(d, [x or 0.0 for x in cross])) + float(d @ (gw * gh) @ d)


def cosine(x: MatrixFrame, y: MatrixFrame | None = None) -> DataFrame:
    """(j, j2, cosine) of the columns of x with those of y (or of x); pairs without a common row are zero and left out.

    The join is on the row index; with y None each pair appears once, j <= j2."""
    e, f = x.entries, (y or x).entries
    nx = e.groupBy("j").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n1"))
    ny = f.groupBy("j").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n2")).withColumnRenamed("j", "j2")
    p = e.join(f.select("i", F.col("j").alias("j2"), F.col("v").alias("v2")), "i")
    p = p.where("j <= j2") if y is None else p
    p = p.groupBy("j", "j2").agg(F.sum(F.col("v") * F.col("v2")).alias("s")).join(nx, "j").join(ny, "j2")
    return p.select("j", "j2", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("s") / (F.col("n1") * F.col("n2"))).otherwise(0.0).alias("cosine"))


def projective_h(a: MatrixFrame, w: DataFrame, d: np.ndarray, rows: int | None = None) -> DataFrame:
    """(j, h) = (W diag(d))' A, the projective update."""
    k = len(d)
    return rhs(a, w, k, rows).select("j", F.array(*[F.col(f"b{r}") * float(d[r]) for r in range(k)]).alias("h"))


def spmv(a: MatrixFrame, x: DataFrame, center: DataFrame | None = None) -> DataFrame:
    """(i, y) = A x with x: (j, x); rows centred by `center` (i, mean) as a rank-one correction, never densified."""
    y = a.entries.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    if center is None:
        return y
    total = x.agg(F.sum("x")).first()[0] or 0.0
    return center.join(y, "i", "left").select("i", (F.coalesce("y", F.lit(0.0)) - F.col("mean") * float(total)).alias("y"))


def nnls2(a: MatrixFrame, w: DataFrame, rows: int | None = None) -> DataFrame:
    """Closed-form two-factor solution, each coordinate clipped at zero: (j, h0, h1)."""
    g = gram(w.withColumnRenamed("w", "h"), 2, ridge=0.0)
    det = g[0, 0] * g[1, 1] - g[0, 1] ** 2
    b = rhs(a, w, 2, rows)
    x0 = (F.col("b0") * float(g[1, 1]) - F.col("b1") * float(g[0, 1])) / float(det)
    x1 = (F.col("b1") * float(g[0, 0]) - F.col("b0") * float(g[0, 1])) / float(det)
    return b.select("j", F.greatest(x0, F.lit(0.0)).alias("h0"), F.greatest(x1, F.lit(0.0)).alias("h1"))
