"""Small dense solvers in numpy: non-negative least squares, assignment, average linkage. No Spark here."""

from __future__ import annotations

import numpy as np

EPS = 1e-15


def nnls_cd(g: np.ndarray, b: np.ndarray, x: np.ndarray | None = None, nonneg: bool = True, upper: float = 0.0, tol: float = 1e-8, sweeps: int = 100) -> np.ndarray:
    """Cyclic coordinate descent on min x'Gx/2 - b'x for every column of b (k x n), columns at once."""
    k, n = b.shape
    x = np.zeros((k, n)) if x is None else x.copy()
    r = b - g @ x
    for _ in range(sweeps):
        worst = 0.0
        for i in range(k):
            if g[i, i] <= 0:
                continue
            new = x[i] + r[i] / g[i, i]
            if nonneg:
                new = np.maximum(new, 0.0)
            if upper > 0:
                new = np.minimum(new, upper)
            step = new - x[i]
            if step.any():
                r -= np.outer(g[:, i], step)
                worst = max(worst, float(np.max(np.abs(step) / (np.abs(new) + EPS))))
                x[i] = new
        if worst < tol:
            break
    return x


def nnls_clip(g: np.ndarray, b: np.ndarray, nonneg: bool = True, upper: float = 0.0) -> np.ndarray:
    """Unconstrained solution, then clipped."""
    x = np.linalg.inv(g) @ b  # g is k x k; a threaded triangular solve would cost more than it saves
    if nonneg:
        x = np.maximum(x, 0.0)
    return np.minimum(x, upper) if upper > 0 else x


def nnls(g: np.ndarray, b: np.ndarray, solver: str = "cd", nonneg: bool = True, upper: float = 0.0, x: np.ndarray | None = None, **kw) -> np.ndarray:
    """x: where coordinate descent starts."""
    return nnls_clip(g, b, nonneg, upper) if solver == "cholesky" else nnls_cd(g, b, x, nonneg, upper, **kw)


def nnls_each(g: np.ndarray, b: np.ndarray, nonneg: bool = True, upper: float = 0.0, sweeps: int = 100, tol: float = 1e-8, solver: str = "cd") -> np.ndarray:
    """As nnls, with an own Gram matrix for each column: g (n, k, k), b (n, k) -> (n, k)."""
    n, k = b.shape
    if solver == "cholesky":
        x = np.linalg.solve(g + EPS * np.eye(k), b[:, :, None])[:, :, 0]
        x = np.maximum(x, 0.0) if nonneg else x
        return np.minimum(x, upper) if upper > 0 else x
    x, r = np.zeros((n, k)), b.copy()
    diag = np.einsum("nkk->nk", g)
    for _ in range(sweeps):
        worst = 0.0
        for i in range(k):
            ok = diag[:, i] > 0
            new = np.where(ok, x[:, i] + r[:, i] / np.where(ok, diag[:, i], 1.0), x[:, i])
            if nonneg:
                new = np.maximum(new, 0.0)
            if upper > 0:
                new = np.minimum(new, upper)
            step = new - x[:, i]
            r -= g[:, :, i] * step[:, None]
            worst = max(worst, float(np.max(np.abs(step) / (np.abs(new) + EPS), initial=0.0)))
            x[:, i] = new
        if worst < tol:
            break
    return x


def hungarian(cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Minimum-cost assignment: (column of each row, -1 if rows are more; total). Shortest augmenting paths, O(n^2 m)."""
    c = np.asarray(cost, float)
    flip = c.shape[0] > c.shape[1]
    a = c.T if flip else c
    n, m = a.shape
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, seen, prev = np.full(m, np.inf), np.zeros(m, bool), np.full(m, -1)
        i, last, col = row, -1, -1
        low = 0.0
        while True:
            alt = low + a[i] - u[i] - v
            better = ~seen & (alt < dist)
            dist[better], prev[better] = alt[better], last
            open_ = np.where(seen, np.inf, dist)
            col = int(np.argmin(open_))
            low = float(open_[col])
            seen[col] = True
            if match[col] < 0:
                break
            i, last = int(match[col]), col
        done = seen.copy()
        done[col] = False
        u[row] += low
        for j in np.flatnonzero(done):
            u[match[j]] += low - dist[j]
        v[seen] -= low - dist[seen]
        while col >= 0:
            p = int(prev[col])
            match[col] = row if p < 0 else match[p]
            col = p
    rows = np.full(n, -1)
    rows[match[match >= 0]] = np.flatnonzero(match >= 0)
    total = float(a[np.arange(n), rows].sum())
    if flip:
        out = np.full(c.shape[0], -1)
        out[rows] = np.arange(n)
        return out, total
    return rows, total


def bipartite_match(x: np.ndarray) -> dict:
    """Minimum-cost matching with negative costs as zero; 0-based."""
    rows, total = hungarian(np.maximum(np.asarray(x, float), 0.0))
    return {"cost": total, "assignment": rows}


def average_linkage(dist: np.ndarray) -> np.ndarray:
    """Merges of average-linkage clustering: rows (a, b, height, size), clusters numbered n, n+1, ..."""
    n = len(dist)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    name, size, out = np.arange(n), np.ones(n), []
    for step in range(n - 1):
        a, b = np.unravel_index(np.argmin(d), d.shape)
        a, b = min(a, b), max(a, b)
        out.append((min(name[a], name[b]), max(name[a], name[b]), d[a, b], size[a] + size[b]))
        row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = row, row
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        name[a] = n + step
    return np.array(out).reshape(-1, 4)


def cut_tree(merges: np.ndarray, k: int) -> np.ndarray:
    """Cluster (1..k, numbered by first member) of each item."""
    n = len(merges) + 1
    group = {i: [i] for i in range(n)}
    for step in range(n - max(1, k)):
        a, b = int(merges[step, 0]), int(merges[step, 1])
        group[n + step] = group.pop(a) + group.pop(b)
    out = np.zeros(n, np.int64)
    for c, members in enumerate(sorted(group.values(), key=min), 1):
        out[members] = c
    return out


def cophenetic(merges: np.ndarray) -> np.ndarray:
    n = len(merges) + 1
    group, out = {i: [i] for i in range(n)}, np.zeros((n, n))
    for step, (a, b, h, _) in enumerate(merges):
        x, y = group.pop(int(a)), group.pop(int(b))
        out[np.ix_(x, y)] = out[np.ix_(y, x)] = h
        group[n + step] = x + y
    return out


def cophenetic_correlation(merges: np.ndarray, dist: np.ndarray) -> float:
    at = np.triu_indices(len(dist), 1)
    x, y = cophenetic(merges)[at], dist[at]
    return float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 and y.std() > 0 else 0.0
