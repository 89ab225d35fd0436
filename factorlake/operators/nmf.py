"""Non-negative matrix factorisation: fits, projections, cross-validation and rank search.

The loop runs on the driver; each iteration is one pass over the samples (see passes). After the samples are solved, their
sums are scaled so that each factor of H has L1 norm one; W is solved against that, scaled the same way, and d keeps the scale.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.losses import ROBUST, Loss
from ..functions.rng import uniform
from ..sources.matrix import MatrixFrame
from .models import NMF
from .passes import LOCAL_NNZ, SPREAD, Plan, Rule, Samples, adverse, gp_parts, gp_thetas, nb_sizes, turned
from .solve import EPS, nnls, nnls_each

PATIENCE = 5
POWER = {"gamma": 2.0, "inverse_gaussian": 3.0, "tweedie": 0.0}  # of the variance; 0: the loss has it
CV_SCHEMA = "rep int, k int, train_mse double, test_mse double, best_iter int, total_iter int, mean_theta double, mean_dispersion double"


@dataclass(frozen=True)
class Config:
    """All settings of a fit; pairs are (W side, H side), and one value stands for both."""

    k: int = 10
    tol: float = 1e-4
    maxit: int = 100
    seed: int = 1
    l1: tuple[float, float] = (0.0, 0.0)
    l2: tuple[float, float] = (0.0, 0.0)
    l21: tuple[float, float] = (0.0, 0.0)
    angular: tuple[float, float] = (0.0, 0.0)
    upper: tuple[float, float] = (0.0, 0.0)
    nonneg: tuple[bool, bool] = (True, True)
    loss: str = "mse"
    loss_args: dict = field(default_factory=dict)
    robust: bool | str | float = False
    norm: str = "L1"
    solver: str = "auto"
    mask: str | DataFrame | tuple[str, DataFrame] | None = None
    projective: bool = False
    symmetric: bool = False
    zi: str = "none"
    dispersion: str = "global"
    test_fraction: float = 0.0
    cv_seed: int = 0
    patience: int = PATIENCE
    init: str | np.ndarray = "random"
    h_init: np.ndarray | None = None
    rounds: int = 5
    still: float = 1e-4
    target: tuple[np.ndarray | None, np.ndarray | None] = (None, None)
    target_weight: tuple[float, float] = (0.0, 0.0)
    graph_w: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    graph_weight: float = 0.0
    graph_h: DataFrame | None = None  # Laplacian entries (a, b, v) of the samples
    graph_h_weight: float = 0.0
    sort_model: bool = True
    local_nnz: int = LOCAL_NNZ
    on_iteration: Callable[[int, float, float], None] | None = None

    def __post_init__(self) -> None:
        for name in ("l1", "l2", "l21", "angular", "upper", "nonneg", "target_weight"):
            v = getattr(self, name)
            if not isinstance(v, (tuple, list)):
                object.__setattr__(self, name, (v, v))
        if self.k < 1:
            raise ValueError("k must be 1 or more")
        if any(not 0 <= x < 1 for x in self.l1):
            raise ValueError("L1 must be in [0, 1)")
        for name in ("l2", "l21", "angular", "upper"):
            if any(x < 0 for x in getattr(self, name)):
                raise ValueError(f"{name} must not be negative")
        if not 0 <= self.test_fraction < 1:
            raise ValueError("test_fraction must be in [0, 1)")
        if self.norm not in ("L1", "L2", "none"):
            raise ValueError("norm must be L1, L2 or none")
        if self.solver not in ("auto", "cd", "cholesky"):
            raise ValueError("solver must be auto, cd or cholesky")
        if self.solver == "cholesky" and self.full_loss().reweighted:
            raise ValueError("the cholesky solver cannot be used with reweighted losses")
        if self.zi not in ("none", "row", "col"):
            raise ValueError("zi must be none, row or col")
        if self.dispersion not in ("none", "global", "per_row", "per_col"):
            raise ValueError("dispersion must be none, global, per_row or per_col")

    def full_loss(self) -> Loss:
        r = ROBUST[self.robust] if isinstance(self.robust, (bool, str)) and self.robust in ROBUST else float(self.robust)
        return Loss(self.loss, robust=r, **self.loss_args)

    def picked_solver(self) -> str:
        if self.solver != "auto":
            return self.solver
        return "cholesky" if not self.full_loss().reweighted and self.k < 32 and max(self.l1) == 0 else "cd"


def lengths(gram: np.ndarray, l1: np.ndarray, norm: str) -> np.ndarray:
    if norm == "none":
        return np.ones(len(l1))
    return (l1 if norm == "L1" else np.sqrt(np.maximum(np.diag(gram), 0))) + EPS


def initial_w(a: MatrixFrame, c: Config) -> np.ndarray:
    if isinstance(c.init, np.ndarray):
        w = c.init if c.init.shape[0] == a.m else c.init.T
        if w.shape != (a.m, c.k):
            raise ValueError(f"the initial matrix has shape {c.init.shape}, not {(a.m, c.k)}")
        return np.maximum(w, 0) if c.nonneg[0] else w
    w = uniform(c.seed, np.arange(a.m)[:, None] + np.zeros((1, c.k), np.int64), np.arange(c.k)[None, :] + np.zeros((a.m, 1), np.int64))
    if c.init in ("lanczos", "irlba", "svd", "randomized"):
        from .svd import svd

        s = svd(a, k=min(c.k, min(a.m, a.n)), method="irlba" if c.init == "irlba" else "lanczos", local_nnz=c.local_nnz)
        w[:, : s.k] = np.abs(s.u) * np.sqrt(s.d)
    elif c.init != "random":
        raise ValueError("init must be random, lanczos, irlba, or a matrix")
    return w


def _masks(a: MatrixFrame, c: Config) -> tuple[bool, DataFrame | None]:
    zeros, frame_ = False, None
    for part in c.mask if isinstance(c.mask, (tuple, list)) else (c.mask,):
        if part is None:
            continue
        if isinstance(part, str):
            if part not in ("zeros", "NA"):
                raise ValueError('mask must be "zeros", "NA", a DataFrame (i, j), or ("zeros", DataFrame)')
            zeros |= part == "zeros"  # missing entries are always left out
        else:
            frame_ = part
    return zeros, frame_


def nmf(a: MatrixFrame | dict[str, MatrixFrame], k: int | list[int] | str = 10, config: Config | None = None, **kw) -> NMF | DataFrame:
    """Fit. k: a rank, a list of ranks (a cross-validation table), or "auto"; a dict of matrices shares one H."""
    if isinstance(a, dict):
        from .graph import fit_shared

        return fit_shared(a, k, config, **kw)
    unknown = set(kw) - set(Config.__dataclass_fields__) - {"cv_seeds", "seeds"}
    if unknown:
        raise TypeError(f"unknown arguments: {', '.join(sorted(unknown))}")
    seeds, cv_seeds = kw.pop("seeds", None), kw.pop("cv_seeds", None)
    if k == "auto":
        return auto_rank(a, replace(config or Config(), **kw))[0]
    if isinstance(k, (list, tuple)):
        return cross_validate(a, list(k), replace(config or Config(), **kw), cv_seeds)
    c = replace(config or Config(), k=int(k), **kw)
    if seeds:
        return multi_init(a, c, seeds)
    if c.zi != "none":
        from .dispersion import fit_zero_inflated

        return fit_zero_inflated(a, c)
    return Fit(a, c).run()


class Fit:
    def __init__(self, a: MatrixFrame, c: Config, samples: Samples | None = None) -> None:
        self.a, self.c = a, c
        self.zeros, mask = _masks(a, c)
        self.data = samples or Samples(a, c.local_nnz, mask)
        self.loss = c.full_loss()
        solver = c.picked_solver()
        side = lambda s: Rule(c.l1[s], c.l2[s], c.l21[s], c.angular[s], c.upper[s], c.nonneg[s], solver, c.target[s], c.target_weight[s])
        self.w_rule, self.h_rule = side(0), side(1)
        self.spread = SPREAD.get(self.loss.name) if c.dispersion != "none" else None
        start = np.full(a.m, float(getattr(self.loss, self.spread))) if self.spread and c.dispersion != "per_col" else None
        self.plan = Plan(self.h_rule, self.loss, c.test_fraction, c.cv_seed or c.seed, self.zeros, self.data.mask, c.projective, c.rounds, c.still, per_row=start, per_col=bool(self.spread) and start is None)
        if c.symmetric and a.m != a.n:
            warnings.warn("a symmetric fit needs a square matrix", stacklevel=3)

    def run(self) -> NMF:
        c, data = self.c, self.data
        w, d = self._first(), np.ones(c.k)
        shape, history, tests, still = None, [], [], 0
        best = (np.inf, 0, None)
        done, it = False, 0
        for it in range(1, c.maxit + 1):
            start = (w, d, shape)
            plan = self._plan(shape, d, w)
            s = data.against(w) if c.symmetric and not self.loss.reweighted else data.run(w, plan, self._angles(shape))
            dh = lengths(s.gram, s.l1, c.norm)
            gram, b = s.gram / np.outer(dh, dh), s.b / dh
            shape = (np.sqrt(np.maximum(np.diag(s.gram), EPS)), s.gram)
            own = None if s.row_gram is None else s.row_gram.reshape(-1, c.k, c.k) / np.outer(dh, dh)
            w_new = self._solve_w(w, gram, b, own, w * d)
            dw = lengths(w_new.T @ w_new, np.abs(w_new).sum(axis=0), c.norm)
            w_used, w, d = w, w_new / dw, dw
            if self.plan.per_row is not None:
                self.plan = replace(self.plan, per_row=self._row_spread(w_used, plan, start[2], dh, w * d, gram, s.l1 / dh))
            if self.plan.holdout or self.loss.reweighted or own is not None:
                train = s.loss / max(s.count, 1)
            else:
                scaled = w * d
                train = max(0.0, data.square - 2 * float((scaled * b).sum()) + float(((scaled.T @ scaled) * gram).sum()))
            test = s.test / s.test_count if s.test_count else np.nan
            history.append(train)
            tests.append(test)
            if c.on_iteration:
                c.on_iteration(it, train, test)
            watched = test if self.plan.holdout else train
            if self.plan.holdout:
                if watched < best[0]:
                    best = (watched, it, (w_used, start, dh, w, d))
                elif it - best[1] >= c.patience:
                    break
                if it > 1 and abs(tests[-2] - test) / (abs(tests[-2]) + EPS) < c.tol:
                    done = True
                    break
            elif it > 1:
                still = still + 1 if abs(history[-2] - train) / (abs(history[-2]) + EPS) < c.tol else 0
                if still >= PATIENCE:
                    done = True
                    break
        if best[2] is not None:
            w_used, start, dh, w, d = best[2]
        last = self._plan(start[2], start[1], w_used)
        h = data.coefficients(w_used, last, dh, self._angles(start[2]))
        if c.symmetric:
            from .models import frame

            h = frame(self.a.entries.sparkSession, w)
        misc = {"iter": it, "converged": done, "tol": c.tol, "loss": history[-1], "train_loss": history, "test_loss": best[0] if best[2] is not None else None, "test_history": tests, "best_iter": best[1] or it, "loss_type": c.loss}
        if self.plan.per_row is not None:
            misc[self.spread] = self.plan.per_row
        if c.loss in POWER:
            misc["phi"] = self._phi(w_used, last, start[2], dh, w * d)
        out = NMF(w, d, h, self.a.n, misc)
        return out.sort() if c.sort_model else out

    def _first(self) -> np.ndarray:
        """W to start from; if only H is given, the least squares on it."""
        c = self.c
        if c.h_init is None:
            return initial_w(self.a, c)
        h = c.h_init if c.h_init.shape[0] == self.a.n else c.h_init.T
        if h.shape != (self.a.n, c.k):
            raise ValueError(f"the initial matrix has shape {c.h_init.shape}, not {(self.a.n, c.k)}")
        s = self.data.against(h)
        w = nnls(s.gram + EPS * np.eye(c.k), s.b.T, "cd", c.nonneg[0]).T
        return w / lengths(w.T @ w, np.abs(w).sum(axis=0), c.norm)

    def _plan(self, shape: tuple | None, d: np.ndarray, w: np.ndarray | None = None) -> Plan:
        rule, extra = self.h_rule, None
        if rule.l21 and shape is not None:  # each factor's ridge by its last length
            extra = np.diag(rule.l21 / shape[0])
        if self.c.graph_h is not None and self.c.graph_h_weight and shape is not None:
            extra = (0.0 if extra is None else extra) + self.c.graph_h_weight * self._graph_gram()
        plan = replace(self.plan, rule=replace(rule, extra=extra), d=d)
        if self.c.graph_h is not None and w is not None:
            self._h = (w, replace(self.plan, rule=replace(rule, extra=extra), d=d), self._angles(shape))
        return plan

    def _graph_gram(self) -> np.ndarray:
        """H L H' of the last pass's coefficients, from one aggregation over the graph's entries."""
        h = self.data.coefficients(self._h[0], self._h[1], None, self._h[2])
        k = self.c.k
        e = self.c.graph_h.join(h.select(F.col("j").alias("a"), F.col("h").alias("x")), "a").join(h.select(F.col("j").alias("b"), F.col("h").alias("y")), "b")
        r = e.agg(*[F.sum(F.col("v") * F.col("x")[p] * F.col("y")[q]).alias(f"g{p}_{q}") for p in range(k) for q in range(k)]).first()
        return np.array([x or 0.0 for x in r]).reshape(k, k)

    def _row_spread(self, w_used: np.ndarray, plan: Plan, shape: tuple | None, dh: np.ndarray, w: np.ndarray, gram: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Sizes or thetas of the rows after a step; w with its scale, gram and total of the scaled H."""
        fitted = lambda h, i, j: np.maximum(np.einsum("ek,ek->e", w[i], (h / dh)[j]), 1e-10)
        sums = lambda fn, n: self.data.stats(fn, n, w_used, plan, self._angles(shape))
        mu, old = w @ total, plan.per_row
        if self.spread == "size":
            x = sums(lambda h, i, j, y: np.stack([y**2 - 2 * y * fitted(h, i, j), fitted(h, i, j), fitted(h, i, j) ** 2], axis=1), 3)
            new = nb_sizes(x[:, 1], x[:, 2], x[:, 0]) if self.zeros else nb_sizes(mu, np.einsum("mk,kl,ml->m", w, gram, w), x[:, 0])
            return np.full(len(new), np.sort(new)[len(new) // 2]) if self.c.dispersion == "global" else new
        for _ in range(5):
            x = sums(lambda h, i, j, y: np.concatenate([gp_parts(y, fitted(h, i, j), old[i]), fitted(h, i, j)[:, None]], axis=1), 5)
            old = gp_thetas(x, x[:, 4] if self.zeros else mu, old)
        return np.full(len(old), old.mean()) if self.c.dispersion == "global" else old

    def _phi(self, w_used: np.ndarray, plan: Plan, shape: tuple | None, dh: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Pearson dispersion of the rows (one value if global) over positive entries."""
        power = POWER[self.c.loss] or self.loss.power

        def part(h: np.ndarray, i: np.ndarray, j: np.ndarray, y: np.ndarray) -> np.ndarray:
            mu = np.maximum(np.einsum("ek,ek->e", w[i], (h / dh)[j]), 1e-10)
            return np.stack([(y > 0) * (y - mu) ** 2 / mu**power, y > 0], axis=1)

        x = self.data.stats(part, 2, w_used, plan, self._angles(shape))
        x = x.sum(axis=0, keepdims=True) if self.c.dispersion == "global" else x
        return np.clip(x[:, 0] / np.maximum(x[:, 1], 1), 1e-4, 1e4)

    def _angles(self, shape: tuple | None) -> tuple | None:
        if shape is None:
            return None
        norms, gram = shape
        return norms, gram / np.outer(norms, norms)

    def _solve_w(self, w: np.ndarray, gram: np.ndarray, b: np.ndarray, own: np.ndarray | None, start: np.ndarray) -> np.ndarray:
        r, k = self.w_rule, self.c.k
        g = gram + EPS * np.eye(k)
        b = b - r.l1
        if r.l21:
            g = g + np.diag(r.l21 / np.maximum(np.linalg.norm(w, axis=0), EPS))
        g = g + r.l2 * np.eye(k)
        if self.c.graph_w is not None and self.c.graph_weight:
            x, y, v = self.c.graph_w
            g = g + self.c.graph_weight * (w[x] * v[:, None]).T @ w[y]
        if r.target is not None and r.target_weight > 0:
            g, b = g + r.target_weight * np.eye(k), b + r.target_weight * r.target
        elif r.target is not None and r.target_weight < 0:
            g = adverse(g, r.target, -r.target_weight)
        if own is None:
            out = nnls(g, b.T, r.solver, r.nonneg, r.upper, x=start.T).T
        else:
            base = g - gram if self.zeros else g
            out = nnls_each(base[None] + own, b, r.nonneg, r.upper, solver=r.solver)
        if r.angular:
            norms = np.maximum(np.linalg.norm(out, axis=0), EPS)
            out = turned(out, out.T @ out / np.outer(norms, norms), norms, r.angular)
        return out


def multi_init(a: MatrixFrame, c: Config, seeds: list) -> NMF:
    """The best of several starts; misc["all_inits"] lists (seed number, loss, iterations)."""
    if c.test_fraction:
        raise ValueError("several starts cannot be combined with cross-validation")
    data = Samples(a, c.local_nnz, _masks(a, c)[1])
    fits = [Fit(a, replace(c, init=s) if isinstance(s, np.ndarray) else replace(c, seed=int(s)), data).run() for s in seeds]
    table = [(k, float(f.misc["loss"]), int(f.misc["iter"])) for k, f in enumerate(fits)]
    best = min(range(len(fits)), key=lambda k: table[k][1])
    return replace(fits[best], misc=fits[best].misc | {"all_inits": table, "best_init": best})


def cross_validate(a: MatrixFrame, ranks: list[int], c: Config, cv_seeds: list[int] | None = None) -> DataFrame:
    """One row for each hold-out seed and rank."""
    c = c if c.test_fraction else replace(c, test_fraction=0.1)
    data = Samples(a, c.local_nnz, _masks(a, c)[1])
    rows = []
    for rep, cv in enumerate(cv_seeds or [c.cv_seed or c.seed], 1):
        for k in ranks:
            f = Fit(a, replace(c, k=k, cv_seed=cv, seed=(cv + k) % (2**31 - 1)), data).run()
            at = f.misc["best_iter"] - 1
            rows.append((rep, k, float(f.misc["train_loss"][at]), float(f.misc["test_history"][at]), int(f.misc["best_iter"]), int(f.misc["iter"]), None, None))
    return a.entries.sparkSession.createDataFrame(rows, CV_SCHEMA)


def auto_rank(a: MatrixFrame, c: Config, k_max: int = 128) -> tuple[NMF, pd.DataFrame]:
    """Doubling from 2 until the test loss rises, then golden-section between the last three ranks."""
    c = c if c.test_fraction else replace(c, test_fraction=0.1)
    data, seen, train = Samples(a, c.local_nnz, _masks(a, c)[1]), {}, {}
    k_max = min(k_max, a.m, a.n)

    def test(k: int) -> float:
        if k not in seen:
            f = Fit(a, replace(c, k=k, cv_seed=c.cv_seed or c.seed, seed=c.seed + k), data).run()
            seen[k], train[k] = float(f.misc["test_loss"]), float(f.misc["loss"])
        return seen[k]

    low, mid, high = 1, min(2, k_max), min(4, k_max)
    while high < k_max and test(high) < test(mid):
        if abs(train[mid] - train[high]) / (train[mid] + EPS) < 0.01 and test(high) > test(mid):
            break
        low, mid, high = mid, high, min(high * 2, k_max)
    ratio = (5**0.5 - 1) / 2
    while high - low > 2:
        x, y = round(high - ratio * (high - low)), round(low + ratio * (high - low))
        if x >= y:
            x, y = low + 1, high - 1
            if x >= y:
                break
        low, high = (low, y) if test(x) <= test(y) else (x, high)
    for k in range(low, high + 1):
        test(k)
    best = min(seen, key=lambda k: (seen[k], k))
    final = Fit(a, replace(c, k=best, test_fraction=0.0)).run()
    table = pd.DataFrame({"k": sorted(seen), "test_mse": [seen[k] for k in sorted(seen)], "train_mse": [train[k] for k in sorted(seen)]})
    return replace(final, misc=final.misc | {"rank_search": table, "best_k": best}), table


def project(a: MatrixFrame, w: np.ndarray, loss: str = "mse", mask: DataFrame | None = None, local_nnz: int = LOCAL_NNZ, solver: str = "cd", loss_args: dict | None = None, **rule) -> DataFrame:
    """(j, h): non-negative least squares (or another loss) of each sample on the factors w (m x k)."""
    if w.shape[0] != a.m:
        if w.shape[1] != a.m:
            raise ValueError(f"w has {w.shape[0]} rows, the matrix {a.m}")
        w = w.T
    data = Samples(a, local_nnz, mask)
    full = Loss(loss, **(loss_args or {}))
    plan = Plan(Rule(rule.get("l1", 0.0), rule.get("l2", 0.0), 0.0, 0.0, rule.get("upper", 0.0), rule.get("nonneg", True), "cd" if full.reweighted else solver), full, mask=data.mask)
    return data.coefficients(w, plan)


def nnls_fit(a: MatrixFrame, w: np.ndarray | None = None, h: np.ndarray | None = None, **kw) -> DataFrame:
    """With w: (j, h). With h (k x n or n x k): the rows of a on it, as (i, h)."""
    if (w is None) == (h is None):
        raise ValueError("give one of w and h")
    if w is not None:
        return project(a, w, **kw)
    return project(a.t(), h if h.shape[0] == a.n else h.T, **kw).withColumnRenamed("j", "i")


def project_named(a: MatrixFrame, w: DataFrame, k: int, **kw) -> DataFrame:
    """As project, with w as (name, w) joined to the row names of a; names that only one side has are left out."""
    both = a.row_names.join(w, "name")
    rows = both.count()
    if not rows:
        raise ValueError("no row names in common")
    if rows < a.m:
        warnings.warn(f"{rows} of {a.m} row names are shared", stacklevel=2)
    p = both.select("i", "w").orderBy("i").toPandas()
    return project(a.slice(rows=p["i"].tolist()), np.stack(p["w"].to_numpy())[:, :k], **kw)


def mse(a: MatrixFrame, model: NMF) -> float:
    return model.evaluate(a)


def tidy_loss(model: NMF) -> pd.DataFrame:
    """Losses by iteration, for plots."""
    return pd.DataFrame({"iteration": np.arange(1, len(model.misc["train_loss"]) + 1), "train": model.misc["train_loss"], "test": model.misc["test_history"]})


def compare(models: dict[str, NMF]) -> pd.DataFrame:
    return pd.concat([tidy_loss(m).assign(model=k) for k, m in models.items()], ignore_index=True)


