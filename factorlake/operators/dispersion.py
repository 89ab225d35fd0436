"""Dispersion updates, zero inflation, and diagnostics of the error distribution."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.losses import Loss, values, weights
from ..sources.matrix import MatrixFrame
from . import linalg
from .models import NMF, frame
from .nmf import Config, Fit, initial_w, lengths
from .solve import EPS, nnls_each

MAX_DENSE = 20_000_000
ZERO_VALUES = 131_072  # expected zeros held at once
ZERO_TASK = 1_000_000_000  # of a task


def upper_median(df: DataFrame, col: str) -> float:
    """The element at floor(n / 2) of the sorted values."""
    n = df.where(F.col(col).isNotNull()).count()
    if not n:
        return 0.0
    q = df.agg(F.expr(f"percentile_disc(0.5) within group (order by {col})"), F.min(col)).first()
    if n % 2:
        return float(q[0])
    # an even count: the next element after the lower median
    low = df.where(F.col(col) <= q[0]).count()
    return float(q[0]) if low > n // 2 else float(df.where(F.col(col) > q[0]).agg(F.min(col)).first()[0])


def nb_sizes(fit: DataFrame, r_min: float = 0.01, r_max: float = 1e6) -> DataFrame:
    """(i, size) by moments from (i, v, mu): sum mu^2 / sum((v - mu)^2 - mu), r_max where that is not positive."""
    s = fit.groupBy("i").agg(F.sum(F.col("mu") * F.col("mu")).alias("num"), F.sum((F.col("v") - F.col("mu")) ** 2 - F.col("mu")).alias("den"))
    r = F.when(F.col("den") > 0, F.least(F.greatest(F.col("num") / F.col("den"), F.lit(r_min)), F.lit(r_max))).otherwise(F.lit(r_max))
    return s.select("i", r.alias("size"))


def pearson_phi(fit: DataFrame, power: float, by: str = "i", low: float = 1e-4, high: float = 1e4) -> DataFrame:
    """(by, phi): mean of (v - mu)^2 / mu^power over positive entries."""
    x = (F.col("v") - F.col("mu")) ** 2 / F.pow(F.greatest(F.col("mu"), F.lit(1e-10)), F.lit(float(power)))
    return fit.where("v > 0").groupBy(by).agg(F.least(F.greatest(F.avg(x), F.lit(low)), F.lit(high)).alias("phi"))


def gp_theta(fit: DataFrame, steps: int = 5, theta_max: float = 5.0, start: float = 0.1) -> DataFrame:
    """(i, theta) of the generalised Poisson by majorising steps over the stored entries of each row, as plain aggregates."""
    cur = fit.groupBy("i").agg(F.lit(start).alias("theta"))
    for _ in range(steps):
        e = fit.join(cur, "i")
        part = F.when(F.col("v") >= 1, (F.col("v") - 1) * F.col("theta") * F.col("v") / F.greatest(F.col("mu") + F.col("theta") * F.col("v"), F.lit(1e-10))).otherwise(0.0)
        s = e.groupBy("i").agg(F.sum(part).alias("c"), F.sum(F.col("v") - F.col("mu")).alias("r"), F.sum("v").alias("y"))
        # alpha t^2 + beta t - gamma = 0 with the loss's two log terms held at the current theta
        beta, root = F.col("y") - F.col("r") - F.col("c"), F.lit(0.0)
        root = (-beta + F.sqrt(beta * beta + 4 * F.greatest(F.col("y"), F.lit(EPS)) * F.col("c"))) / (2 * F.greatest(F.col("y"), F.lit(EPS)))
        cur = s.select("i", F.least(F.greatest(root, F.lit(0.0)), F.lit(theta_max)).alias("theta"))
    return cur


def trimmed_mean(df: DataFrame, by: str, col: str, trim: float = 0.1) -> DataFrame:
    """(by, mean) without the lowest and highest share of each group."""
    w = Window.partitionBy(by)
    r = df.withColumn("__r", F.row_number().over(w.orderBy(col))).withColumn("__n", F.count("*").over(w))
    cut = F.floor(F.col("__n") * trim)
    return r.where((F.col("__r") > cut) & (F.col("__r") <= F.col("__n") - cut)).groupBy(by).agg(F.avg(col).alias("mean"))


def score_test(a: MatrixFrame, model: NMF, powers: tuple[float, ...] = (0.0, 1.0, 2.0, 3.0), test_nb: bool = True) -> pd.DataFrame:
    """T_p = mean(r^2 / mu^p - 1) over stored entries; the power nearest zero fits best."""
    fit = linalg.fitted(a, model.w_frame(), model.d, model.h, a.m, a.n)
    return score_test_fit(fit, powers, test_nb)


def score_test_fit(fit: DataFrame, powers: tuple[float, ...] = (0.0, 1.0, 2.0, 3.0), test_nb: bool = True) -> pd.DataFrame:
    r2, mu = (F.col("v") - F.col("mu")) ** 2, F.greatest(F.col("mu"), F.lit(1e-10))
    cols: list[Column] = [F.avg(r2 / F.pow(mu, F.lit(float(p))) - 1).alias(f"t{k}") for k, p in enumerate(powers)]
    cols += [F.avg((r2 - mu) / (mu * mu)).alias("nb"), F.max(F.abs(F.col("v") - F.round("v"))).alias("frac")]
    r = fit.agg(*cols).first()
    out = pd.DataFrame({"test": [f"power_{p:g}" for p in powers], "score": [r[f"t{k}"] for k in range(len(powers))]})
    if test_nb and r["frac"] is not None and r["frac"] < 1e-9:
        out.loc[len(out)] = ["nb_overdispersion", r["nb"]]
        out.attrs["overdispersed"] = bool(r["nb"] > 0.1)
    best = int(np.argmin(np.abs(out["score"].to_numpy()[: len(powers)])))
    out.attrs["best_power"] = powers[best]
    return out


def zero_inflation(a: MatrixFrame, model: NMF, threshold: float = 0.05) -> dict:
    """Zeros beyond the Poisson ones by row and column; expected zeros need all m n entries, made in blocks of H."""
    m, k, held = a.m, model.k, ZERO_VALUES
    shared = model.h.sparkSession.sparkContext.broadcast(np.ascontiguousarray((model.w * model.d).T))

    def run(it):
        wt, rows = shared.value, np.zeros(m)
        wide = min(m, held)
        step = max(1, held // max(1, wide))
        for batch in it:
            h = batch.column("h").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            cols = np.zeros(len(h))
            for s in range(0, len(h), step):
                for c in range(0, m, wide):
                    x = h[s : s + step] @ wt[:, c : c + wide]
                    np.negative(np.maximum(x, 0, out=x), out=x)
                    np.exp(x, out=x)
                    rows[c : c + wide] += x.sum(axis=0)
                    cols[s : s + step] += x.sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(["col"] * len(h)), batch.column("j").cast(pa.int64()), pa.array(cols)], ["kind", "key", "expected"])
        yield pa.RecordBatch.from_arrays([pa.array(["row"] * m), pa.array(np.arange(m)), pa.array(rows)], ["kind", "key", "expected"])

    h = model.h.repartition(max(1, min(-(-a.n // 256), max(-(-a.n * m // ZERO_TASK), model.h.sparkSession.sparkContext.defaultParallelism))))
    exp = h.select("j", "h").mapInArrow(run, "kind string, key long, expected double").groupBy("kind", "key").agg(F.sum("expected").alias("expected")).persist()
    out = {}
    for kind, stats, key, of in (("row", a.row_stats(), "i", a.n), ("col", a.column_stats(), "j", a.m)):
        e = stats.join(exp.where(F.col("kind") == kind), stats[key] == exp["key"]).select((F.greatest((F.col("zeros") - F.col("expected")) / of, F.lit(0.0))).alias("excess"))
        r = e.agg(F.avg("excess"), F.var_samp("excess")).first()
        out[kind] = (float(r[0] or 0.0), float(r[1] or 0.0))
    exp.unpersist()
    excess = out["row"][0]
    mode = "none" if excess <= threshold else "row" if out["row"][1] >= out["col"][1] and out["row"][1] > 0.001 else "col" if out["col"][1] > 0.001 else "row"
    return {"excess": excess, "row_variance": out["row"][1], "col_variance": out["col"][1], "zero_inflated": excess > threshold, "mode": mode}


def dispersion_mode(a: MatrixFrame, model: NMF, cv_threshold: float = 0.5, power: float = 1.0) -> dict:
    """Trimmed Pearson dispersion by row and column; how much it varies picks the mode."""
    fit = linalg.fitted(a, model.w_frame(), model.d, model.h, a.m, a.n)
    fit = fit.withColumn("x", (F.col("v") - F.col("mu")) ** 2 / F.pow(F.greatest(F.col("mu"), F.lit(1e-10)), F.lit(power)))
    cv = {}
    for by in ("i", "j"):
        r = trimmed_mean(fit, by, "x").agg(F.stddev_samp("mean"), F.avg("mean")).first()
        cv[by] = float((r[0] or 0.0) / r[1]) if r[1] else 0.0
    mode = "global" if max(cv.values()) < cv_threshold else "per_row" if cv["i"] >= cv["j"] else "per_col"
    return {"row_cv": cv["i"], "col_cv": cv["j"], "mode": mode}


def auto_distribution(a: MatrixFrame, k: int, distributions: tuple[str, ...] = ("mse", "gp", "nb"), criterion: str = "bic", **kw) -> tuple[str, pd.DataFrame]:
    """Fits of each distribution, by AIC or BIC; N is the stored entries."""
    nnz = a.entries.count()
    rows = []
    for dist in distributions:
        f = Fit(a, Config(k=k, loss=dist, **kw)).run()
        fit = linalg.fitted(a, f.w_frame(), f.d, f.h, a.m, a.n)
        total = float(linalg.stored_loss(fit, Loss("mse") if dist == "mse" else Loss(dist)).first()["total"])
        nll = nnz / 2 * (1 + np.log(2 * np.pi * max(total, EPS) / nnz)) if dist == "mse" else total
        df = k * (a.m + a.n) + (1 if dist == "mse" else a.m)
        rows.append((dist, nll, df, 2 * nll + 2 * df, 2 * nll + df * np.log(nnz)))
    table = pd.DataFrame(rows, columns=["distribution", "nll", "df", "aic", "bic"])
    return table.loc[table[criterion].idxmin(), "distribution"], table


def zero_probability(mu: np.ndarray, loss: Loss) -> np.ndarray:
    if loss.name == "nb":
        return (loss.size / (loss.size + mu)) ** loss.size
    return np.exp(-mu / (1 + (loss.theta if loss.name == "gp" else 0.0)))


def fit_zero_inflated(a: MatrixFrame, c: Config) -> NMF:
    """Row or column zero inflation by expectation steps on the dense matrix; its size is bounded by MAX_DENSE."""
    if a.m * a.n > MAX_DENSE:
        raise ValueError(f"zero inflation fills all {a.m} x {a.n} entries; that is over {MAX_DENSE}")
    x, loss, axis = a.to_numpy(), c.full_loss(), 1 if c.zi == "row" else 0
    zero = x == 0
    pi = np.minimum(0.5 * zero.mean(axis=axis), 0.3)
    w, d = initial_w(a, replace(c, zi="none")), np.ones(c.k)
    y, history, h = x.copy(), [], np.zeros((a.n, c.k))
    for it in range(c.maxit):
        h = _reweighted(w, y.T, h if it else None, loss, c)
        dh = lengths(h.T @ h, np.abs(h).sum(axis=0), c.norm)
        h = h / dh
        w = _reweighted(h, y, w * dh, loss, c)
        d = lengths(w.T @ w, np.abs(w).sum(axis=0), c.norm)
        w = w / d
        mu = (w * d) @ h.T
        p0 = zero_probability(mu, loss)
        full = pi[:, None] if axis == 1 else pi[None, :]
        z = np.where(zero, full / np.maximum(full + (1 - full) * p0, EPS), 0.0)
        pi = np.clip(z.mean(axis=axis), 0.001, 0.999)
        y = np.where(zero, z * mu, x)
        history.append(float(values(x[~zero], mu[~zero], loss).mean()) if (~zero).any() else 0.0)
        if it > 5 and abs(history[-2] - history[-1]) / (abs(history[-2]) + EPS) < c.tol:
            break
    out = NMF(w, d, frame(a.entries.sparkSession, h), a.n, {"loss": history[-1], "train_loss": history, "iter": len(history), f"pi_{c.zi}": pi})
    return out.sort() if c.sort_model else out


def _reweighted(w: np.ndarray, y: np.ndarray, start: np.ndarray | None, loss: Loss, c: Config) -> np.ndarray:
    """Items (rows of y) on the factors w, one reweighting."""
    wt = np.ones_like(y) if start is None or not loss.reweighted else weights(y, start @ w.T, loss)
    outer = (w[:, :, None] * w[:, None, :]).reshape(len(w), -1)
    g = (wt @ outer).reshape(-1, c.k, c.k) + c.l2[1] * np.eye(c.k)
    return nnls_each(g, (wt * y) @ w - c.l1[1], True)
