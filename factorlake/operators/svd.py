"""Truncated SVD and PCA by passes that return m x l sums: A (A'Q) for any thin Q, rows centred and scaled implicitly.

No pass returns anything of the samples' length; the right vectors stay a DataFrame, made by one last map.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import held_out, normal
from ..sources.matrix import MatrixFrame
from .models import SVD, frame
from .passes import LOCAL_NNZ, Block, Samples, products, sum_to

METHODS = ("auto", "lanczos", "irlba", "randomized", "deflation", "krylov")


@dataclass
class Operator:
    """A centred and scaled matrix, seen through passes."""

    data: Samples
    mean: np.ndarray | None = None
    inv_sd: np.ndarray | None = None

    @classmethod
    def of(cls, a: MatrixFrame, center: bool, scale: bool, local_nnz: int) -> tuple[Operator, float, np.ndarray | None, np.ndarray | None]:
        op = cls(Samples(a, local_nnz))
        m = a.m
        total = op.data.sweep(lambda b: _moments(b, m), m, 2)
        mean = total[:, 0] / a.n if center or scale else None
        var = total[:, 1] / a.n - (total[:, 0] / a.n) ** 2
        sd = np.sqrt(np.maximum(var, 0)) if scale else None
        op.mean = mean
        op.inv_sd = None if sd is None else np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 1.0)
        sq = a.n * np.maximum(var, 0) if mean is not None else total[:, 1]
        frob = float((sq * (op.inv_sd**2 if op.inv_sd is not None else 1)).sum())
        return op, frob, mean, sd

    def left(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
        """Q with the scale taken in, and what the means take from each sample's product."""
        x = q * self.inv_sd[:, None] if self.inv_sd is not None else q
        return x, (self.mean @ x if self.mean is not None else 0.0)

    def outer(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(A A' Q, Q' A A' Q) in one pass."""
        x, off = self.left(q)
        m, l = q.shape

        def one(b: Block, x: np.ndarray) -> np.ndarray:
            t = products(b, x) - off
            out = np.zeros((m + l + 1, l))
            for c in range(l):
                out[:m, c] = np.bincount(b.idx, b.val * t[b.col, c], m)
            out[m : m + l] = t.T @ t
            out[m + l] = t.sum(axis=0)
            return out

        s = self.data.sweep(one, m + l + 1, l, x)
        y = s[:m]
        if self.mean is not None:
            y = y - np.outer(self.mean, s[m + l])
        return (y * self.inv_sd[:, None] if self.inv_sd is not None else y), s[m : m + l]

    def sketch(self, l: int, seed: int) -> np.ndarray:
        """A Omega with Omega (n x l) normal, made of each sample's number."""
        m = self.data.m

        def one(b: Block) -> np.ndarray:
            t = normal(seed, b.keys[:, None] + np.zeros((1, l), np.int64), np.arange(l)[None, :] + np.zeros((len(b.keys), 1), np.int64))
            return np.concatenate([sum_to(b.idx, b.val[:, None] * t[b.col], m), t.sum(axis=0)[None, :]])

        s = self.data.sweep(one, m + 1, l)
        y = s[:m] - (np.outer(self.mean, s[m]) if self.mean is not None else 0)
        return y * self.inv_sd[:, None] if self.inv_sd is not None else y

    def right(self, u: np.ndarray, d: np.ndarray) -> DataFrame:
        """(j, v) = A'U / d."""
        x, off = self.left(u)
        by = np.where(d > 0, d, 1.0)

        def one(b: Block) -> np.ndarray:
            return (products(b, x) - off) / by

        return self.data.each(one, "j", "v")


def _moments(b: Block, m: int) -> np.ndarray:
    return sum_to(b.idx, np.stack([b.val, b.val**2], axis=1), m)


def pick_method(m: int, n: int, k: int, robust: bool = False, constrained: bool = False, cv: bool = False) -> str:
    if robust:
        return "deflation"
    if constrained:
        return "krylov" if k >= 8 else "deflation"
    if cv:
        return "deflation"
    return "irlba" if k >= 64 or min(m, n) < 4 * k else "lanczos"


def svd(a: MatrixFrame, k: int | str = 10, method: str = "auto", center: bool = False, scale: bool = False, tol: float = 1e-7, maxit: int = 100, seed: int = 1, l1: tuple[float, float] | float = 0.0, l2: tuple[float, float] | float = 0.0, nonneg: tuple[bool, bool] | bool = False, upper: tuple[float, float] | float = 0.0, robust: bool = False, test_fraction: float = 0.0, cv_seed: int = 1, patience: int = 3, k_max: int = 50, power: int = 3, local_nnz: int = LOCAL_NNZ) -> SVD:
    """k: a rank or "auto" (by held-out entries); power: steps of the randomized method."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    pair = lambda x: tuple(x) if isinstance(x, (tuple, list)) else (x, x)
    l1, l2, nonneg, upper = pair(l1), pair(l2), pair(nonneg), pair(upper)
    if min(*l1, *l2, *upper) < 0:
        raise ValueError("penalties must not be negative")
    auto = k == "auto"
    if auto:
        k, test_fraction = min(k_max, a.m, a.n), test_fraction or 0.05
    if not 1 <= k <= min(a.m, a.n):
        raise ValueError(f"k must be between 1 and {min(a.m, a.n)}")
    constrained = max(*l1, *l2, *upper) > 0 or any(nonneg)
    cv = test_fraction > 0
    picked = pick_method(a.m, a.n, k, robust, constrained, cv) if method == "auto" else method
    if robust and picked != "deflation":
        raise ValueError("robust needs the deflation method")
    if (constrained or cv) and picked not in ("deflation", "krylov"):
        raise ValueError("penalties, constraints and cross-validation need the deflation or krylov method")
    if cv and picked == "krylov":
        picked = "deflation"
    op, frob, mean, sd = Operator.of(a, center or scale, scale, local_nnz)
    misc = {"method": picked, "centered": mean is not None, "row_means": mean, "row_sds": sd, "frobenius_sq": frob}
    if picked == "deflation":
        u, d, v, more = _deflation(a, op, k, tol, maxit, seed, l1, l2, nonneg, upper, robust, test_fraction, cv_seed, patience if auto else 0, local_nnz)
        return SVD(u, d, frame(a.entries.sparkSession, v, "j", "v"), a.n, misc | more)
    if picked == "randomized":
        u, d = _randomized(op, k, seed, power)
    elif picked == "krylov" and constrained:
        u, d, v, more = _deflation(a, op, k, tol, maxit, seed, l1, l2, nonneg, upper, False, 0.0, 1, 0, local_nnz, start=_krylov(op, k, tol, seed)[0])
        return SVD(u, d, frame(a.entries.sparkSession, v, "j", "v"), a.n, misc | more)
    elif picked == "krylov":
        u, d = _krylov(op, k, tol, seed)
    else:
        u, d = _lanczos(op, k, tol, maxit, seed, restart=k + 15 if picked == "irlba" else None)
    u, d = _signed(u, d)
    return SVD(u, d, op.right(u, d), a.n, misc)


def pca(a: MatrixFrame, k: int = 10, **kw) -> SVD:
    return svd(a, k, **({"center": True} | kw))


def _signed(u: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest entry of each left vector is positive."""
    s = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return u * np.where(s == 0, 1, s), d


def _ritz(q: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    val, vec = np.linalg.eigh((t + t.T) / 2)
    o = np.argsort(-val)[:k]
    return q @ vec[:, o], np.sqrt(np.maximum(val[o], 0))


def _randomized(op: Operator, k: int, seed: int, power: int = 3) -> tuple[np.ndarray, np.ndarray]:
    l = min(k + max(10, k // 5), op.data.m)
    q, _ = np.linalg.qr(op.sketch(l, seed))
    for _ in range(power):
        q, _ = np.linalg.qr(op.outer(q)[0])
    return _ritz(q, op.outer(q)[1], k)


def _start(m: int, seed: int, l: int = 1) -> np.ndarray:
    x = normal(seed, np.arange(m)[:, None] + np.zeros((1, l), np.int64), np.arange(l)[None, :] + np.zeros((m, 1), np.int64))
    return np.linalg.qr(x)[0]


def _lanczos(op: Operator, k: int, tol: float, maxit: int, seed: int, restart: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric Lanczos on A A' with full reorthogonalisation; with `restart`, thick restarts at that many vectors."""
    m = op.data.m
    most = min(m, restart) if restart else min(m, max(3 * k, k + 50, maxit))
    q, aq = np.empty((m, 0)), np.empty((m, 0))
    x, passes = _start(m, seed), 0
    u, d = np.empty((m, 0)), np.empty(0)
    while passes < 10 * most + maxit:
        y, _ = op.outer(x)
        passes += 1
        q, aq = np.concatenate([q, x], axis=1), np.concatenate([aq, y], axis=1)
        t = q.T @ aq
        r = y
        for _ in range(2):
            r = r - q @ (q.T @ r)
        norm = np.linalg.norm(r)
        full = q.shape[1] >= most
        if q.shape[1] >= k and (full or q.shape[1] % 4 == 0 or norm < 1e-12):
            val, vec = np.linalg.eigh((t + t.T) / 2)
            o = np.argsort(-val)[: max(k, 1)]
            u, d = q @ vec[:, o], np.sqrt(np.maximum(val[o], 0))
            err = np.linalg.norm(aq @ vec[:, o] - u * val[o], axis=0)
            if (err <= tol * max(val[o].max(), 1e-300)).all() or q.shape[1] >= m:
                return u[:, :k], d[:k]
            if full:
                if not restart:
                    return u[:, :k], d[:k]
                keep = np.argsort(-val)[: min(len(val) - 1, k + (most - k) // 2)]
                q, aq = q @ vec[:, keep], aq @ vec[:, keep]
        if norm < 1e-12 * max(1.0, np.linalg.norm(y)):  # an invariant space: go on with a new direction
            r = _start(m, seed + passes)
            for _ in range(2):
                r = r - q @ (q.T @ r)
            norm = np.linalg.norm(r)
        x = r / norm
    return u[:, :k], d[:k]


def _krylov(op: Operator, k: int, tol: float, seed: int, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Block Krylov space of A A'."""
    m = op.data.m
    l = min(m, k + 4)
    x = np.linalg.qr(op.sketch(l, seed))[0]
    q, aq = np.empty((m, 0)), np.empty((m, 0))
    last = None
    for _ in range(steps):
        y, _ = op.outer(x)
        q, aq = np.concatenate([q, x], axis=1), np.concatenate([aq, y], axis=1)
        u, d = _ritz(q, q.T @ aq, k)
        if last is not None and np.abs(d - last).max() <= tol * max(d[0], 1e-300):
            break
        last = d
        r = y
        for _ in range(2):
            r = r - q @ (q.T @ r)
        x, s, _ = np.linalg.svd(r, full_matrices=False)
        x = x[:, s > 1e-10 * max(1.0, s[0])]
        if not x.shape[1] or q.shape[1] + x.shape[1] > m:
            break
    return u, d


def _shrunk(x: np.ndarray, l1: float, l2: float, nonneg: bool, upper: float, norm_sq: float) -> np.ndarray:
    x = np.sign(x) * np.maximum(np.abs(x) - l1 / (2 * norm_sq), 0) / (1 + l2 / norm_sq)
    x = np.maximum(x, 0) if nonneg else x
    return np.minimum(x, upper) if upper > 0 else x


def _upper_median(x: np.ndarray) -> float:
    return float(np.sort(x)[len(x) // 2]) if len(x) else 0.0


def _deflation(a: MatrixFrame, op: Operator, k: int, tol: float, maxit: int, seed: int, l1, l2, nonneg, upper, robust: bool, fraction: float, cv_seed: int, patience: int, local_nnz: int, start: np.ndarray | None = None) -> tuple:
    """Rank-one fits, one after the other, on the stored entries of a matrix that the driver can hold."""
    if not op.data.local:
        raise ValueError("constrained, robust and cross-validated SVD need a matrix that the driver can hold; raise local_nnz or use krylov without constraints")
    x = np.zeros((a.m, a.n))
    for b in op.data.blocks:
        x[b.idx, b.keys[b.col]] = b.val
    if op.mean is not None:
        x -= op.mean[:, None]
    if op.inv_sd is not None:
        x *= op.inv_sd[:, None]
    test = held_out(cv_seed, np.arange(a.m)[:, None] + np.zeros((1, a.n), np.int64), np.arange(a.n)[None, :] + np.zeros((a.m, 1), np.int64), fraction) if fraction else None
    rest = x.copy()
    us, ds, vs, losses, worse = [], [], [], [], 0
    for r in range(k):
        work = np.where(test, 0.0, rest) if test is not None else rest
        u = start[:, r] if start is not None and r < start.shape[1] else _start(a.m, seed + r)[:, 0]
        if nonneg[0]:
            u = np.abs(u)
        v, wt = np.zeros(a.n), np.ones_like(rest)
        for _ in range(maxit):
            old = u
            v = _shrunk((work * wt).T @ u / max(float(u @ u), 1e-300), l1[1], l2[1], nonneg[1], upper[1], max(float(u @ u), 1e-300))
            if not v.any():
                break
            u = _shrunk((work * wt) @ v / float(v @ v), l1[0], l2[0], nonneg[0], upper[0], float(v @ v))
            if us and not (nonneg[0] or l1[0] or upper[0]):
                q = np.stack(us, axis=1)
                u = u - q @ (q.T @ u)
            norm = np.linalg.norm(u)
            if norm == 0:
                break
            u = u / norm
            if robust:
                e = work - np.outer(u, work.T @ u)
                mad = 1.4826 * _upper_median(np.abs(e - _upper_median(e.ravel())).ravel()) + 1e-12
                wt = np.minimum(1.0, 1.345 * mad / np.maximum(np.abs(e), 1e-12))
            if 1 - abs(float(u @ old)) / max(np.linalg.norm(old), 1e-300) < tol * 1e-2:
                break
        v = _shrunk((work * wt).T @ u / max(float(u @ u), 1e-300), l1[1], l2[1], nonneg[1], upper[1], max(float(u @ u), 1e-300))
        d = float(np.linalg.norm(v))
        if d == 0 or np.linalg.norm(u) == 0:
            break
        v = v / d
        us.append(u)
        ds.append(d)
        vs.append(v)
        rest = rest - d * np.outer(u, v)
        if test is not None:
            losses.append(float((rest[test] ** 2).mean()) if test.any() else 0.0)
            if patience:
                worse = worse + 1 if len(losses) > 1 and losses[-1] >= min(losses[:-1]) else 0
                if worse >= patience:
                    break
    if patience and losses:
        keep = int(np.argmin(losses)) + 1
        us, ds, vs = us[:keep], ds[:keep], vs[:keep]
    u = np.stack(us, axis=1) if us else np.zeros((a.m, 0))
    v = np.stack(vs, axis=1) if vs else np.zeros((a.n, 0))
    return u, np.array(ds), v, {"test_loss": losses}


def scores(model: SVD) -> DataFrame:
    """(j, score) = d v, the samples in the space of the factors."""
    return model.v.select("j", F.array(*[F.col("v")[r] * float(model.d[r]) for r in range(model.k)]).alias("score"))
