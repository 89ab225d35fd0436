"""Fitted models. The side of the samples stays a DataFrame; the other side and the scale are arrays on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.matrix import MatrixFrame
from . import linalg
from .passes import factor_frame as frame
from .solve import hungarian


class Accessors:
    """Slots by name in any case, then entries of misc."""

    def __getattr__(self, name: str) -> Any:
        low = name.lower()
        if low != name and low in self.__dataclass_fields__:
            return getattr(self, low)
        misc = self.__dict__.get("misc", {})
        if name in misc or low in misc:
            return misc.get(name, misc.get(low))
        raise AttributeError(name)

    def __getitem__(self, name: str | slice | list) -> Any:
        return getattr(self, name) if isinstance(name, str) else self.factors(name)


@dataclass(frozen=True)
class NMF(Accessors):
    """A ~ W diag(d) H: w is (m x k), h holds (j, h)."""

    w: np.ndarray
    d: np.ndarray
    h: DataFrame
    n: int
    misc: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.w.shape[1] != len(self.d):
            raise ValueError("w and d have different ranks")

    @property
    def k(self) -> int:
        return len(self.d)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.w.shape[0], self.n, self.k

    @property
    def names(self) -> list[str]:
        return [f"nmf{r + 1}" for r in range(self.k)]

    def factors(self, which: slice | list[int]) -> NMF:
        at = np.arange(self.k)[which]
        return replace(self, w=self.w[:, at], d=self.d[at], h=_reorder(self.h, "h", at))

    def sort(self, decreasing: bool = True) -> NMF:
        o = np.argsort(-self.d if decreasing else self.d, kind="stable")
        return self.factors(o.tolist())

    def t(self, spark: SparkSession | None = None) -> NMF:
        """The model of the transpose; H is collected, so its size is checked."""
        if self.n * self.k > 60_000_000:
            raise ValueError("H is too large to become the driver's side")
        h = self.h_numpy()
        return replace(self, w=h, h=frame(spark or self.h.sparkSession, self.w), n=self.w.shape[0])

    def head(self, n: int = 6) -> dict:
        return {"w": self.w[:n], "d": self.d, "h": self.h.orderBy("j").limit(n)}

    def asdict(self) -> dict:
        return {"w": self.w, "d": self.d, "h": self.h, "misc": self.misc}

    def __repr__(self) -> str:
        m, n, k = self.shape
        return f"NMF of rank {k} of {m} x {n}, " + ", ".join(f"{x}={self.misc[x]}" for x in ("iter", "tol", "loss") if x in self.misc)

    def h_numpy(self) -> np.ndarray:
        out = np.zeros((self.n, self.k))
        p = self.h.toPandas()
        if len(p):
            out[p["j"].to_numpy()] = np.stack(p["h"].to_numpy())
        return out

    def w_frame(self) -> DataFrame:
        return frame(self.h.sparkSession, self.w, "i", "w")

    def reconstruct(self) -> DataFrame:
        """(i, j, v) of all m n entries of W diag(d) H, from one broadcast of the factor."""
        if self.w.size > 12_000_000:
            raise ValueError("w is too large to broadcast")
        w = self.h.sparkSession.sparkContext.broadcast(self.w * self.d)

        def run(it):
            for p in it:
                x = np.stack(p["h"].to_numpy()) @ w.value.T
                n, m = x.shape
                yield pd.DataFrame({"i": np.tile(np.arange(m), n), "j": np.repeat(p["j"].to_numpy(), m), "v": x.ravel()})

        return self.h.mapInPandas(run, "i long, j long, v double")

    def sparsity(self) -> DataFrame:
        """(factor, sparsity, model): the share of zeros in each factor of w and h."""
        w = [(name, float((self.w[:, r] == 0).mean()), "w") for r, name in enumerate(self.names)]
        h = self.h.select(F.posexplode("h").alias("r", "x")).groupBy("r").agg(F.avg((F.col("x") == 0).cast("double")).alias("sparsity"))
        h = h.select(F.concat(F.lit("nmf"), (F.col("r") + 1).cast("string")).alias("factor"), "sparsity", F.lit("h").alias("model"))
        return self.h.sparkSession.createDataFrame(w, "factor string, sparsity double, model string").unionByName(h)

    def summary(self, groups: DataFrame, stat: str = "sum", side: str = "h") -> DataFrame:
        """(group, factor, stat) of h by (j, group), or of w by (i, group); any stat but "sum" is the mean."""
        key, x = ("j", self.h) if side == "h" else ("i", self.w_frame().withColumnRenamed("w", "h"))
        e = x.join(groups, key).select("group", F.posexplode("h").alias("r", "x"))
        agg = F.sum("x") if stat == "sum" else F.avg("x")
        return e.groupBy("group", "r").agg(agg.alias("stat")).select("group", F.concat(F.lit("nmf"), (F.col("r") + 1).cast("string")).alias("factor"), "stat")

    def align(self, ref: NMF, method: str = "cosine") -> NMF:
        """Factors in the order that matches those of ref best."""
        a, b = (self.w, ref.w) if method == "cosine" else (self.w - self.w.mean(axis=0), ref.w - ref.w.mean(axis=0))
        norm = lambda x: x / np.maximum(np.linalg.norm(x, axis=0), 1e-15)
        rows, _ = hungarian(1 - norm(b).T @ norm(a) + 1e-10)
        return self.factors([int(r) for r in rows])

    def predict(self, a: MatrixFrame, l1: float = 0.0, l2: float = 0.0, upper: float = 0.0, nonneg: bool = True, mask: DataFrame | None = None) -> DataFrame:
        """(j, h): the samples of a projected on w; d is not applied."""
        from .nmf import project

        return project(a, self.w, l1=l1, l2=l2, upper=upper, nonneg=nonneg, mask=mask)

    def evaluate(self, a: MatrixFrame, loss: str = "mse", mask: DataFrame | None = None, missing_only: bool = False, domain: str = "all", **loss_args) -> float:
        """Mean loss over all entries, the stored ones ("stored"), without masked ones, or over masked ones only."""
        from ..functions.losses import Loss, column

        rule = Loss(loss, **loss_args)
        if domain == "all" and mask is None and loss == "mse":
            return linalg.all_entries_sse(a, self.w_frame(), self.d, self.h, self.w.shape[0]) / (self.w.shape[0] * self.n)
        e = a
        if domain == "all" or missing_only:
            cells = mask.select("i", "j").distinct() if missing_only and mask is not None else _cells(a)
            full = cells.join(a.entries, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))
            e = replace(a, entries=full)
        if mask is not None and not missing_only:
            e = e.without(mask)
        fit = linalg.fitted(e, self.w_frame(), self.d, self.h, self.w.shape[0], self.n)
        return float(fit.agg(F.avg(column(F.col("v"), F.col("mu"), rule))).first()[0] or 0.0)


@dataclass(frozen=True)
class SVD(Accessors):
    """A ~ U diag(d) V': u is (m x k), v holds (j, v)."""

    u: np.ndarray
    d: np.ndarray
    v: DataFrame
    n: int
    misc: dict = field(default_factory=dict)

    @property
    def k(self) -> int:
        return len(self.d)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.u.shape[0], self.n, self.k

    def factors(self, which: slice | list[int]) -> SVD:
        at = np.arange(self.k)[which]
        return replace(self, u=self.u[:, at], d=self.d[at], v=_reorder(self.v, "v", at))

    def head(self, n: int = 6) -> dict:
        return {"u": self.u[:n], "d": self.d, "v": self.v.orderBy("j").limit(n)}

    def __repr__(self) -> str:
        m, n, k = self.shape
        return f"SVD of rank {k} of {m} x {n}"

    def v_numpy(self) -> np.ndarray:
        out = np.zeros((self.n, self.k))
        p = self.v.toPandas()
        if len(p):
            out[p["j"].to_numpy()] = np.stack(p["v"].to_numpy())
        return out

    def reconstruct(self) -> DataFrame:
        """(i, j, v) of U diag(d) V', scale undone and row means added."""
        sd, mean = self.misc.get("row_sds"), self.misc.get("row_means")
        u = (self.u * self.d) * (sd[:, None] if sd is not None else 1.0)
        model = NMF(u, np.ones(self.k), self.v.withColumnRenamed("v", "h"), self.n)
        out = model.reconstruct()
        if mean is None:
            return out
        m = frame(self.v.sparkSession, mean[:, None], "i", "mean").select("i", F.col("mean")[0].alias("mean"))
        return out.join(F.broadcast(m), "i").select("i", "j", (F.col("v") + F.col("mean")).alias("v"))

    def variance_explained(self) -> np.ndarray:
        return self.d**2 / self.misc["frobenius_sq"]

    def predict(self, rows: DataFrame) -> DataFrame:
        """(i, score): new observations (i, j, v) over the n columns, times V / d, their own means taken out if centred."""
        k = self.k
        e = rows
        if self.misc.get("row_means") is not None:
            own = rows.groupBy("i").agg((F.sum("v") / self.n).alias("mean"))
            total = self.v.agg(*[F.sum(F.col("v")[r]).alias(f"t{r}") for r in range(k)]).first()
            b = e.join(self.v.withColumnRenamed("v", "x"), "j").groupBy("i").agg(*[F.sum(F.col("v") * F.col("x")[r]).alias(f"b{r}") for r in range(k)])
            return b.join(own, "i").select("i", F.array(*[(F.col(f"b{r}") - F.col("mean") * float(total[r])) / float(self.d[r]) for r in range(k)]).alias("score"))
        b = e.join(self.v.withColumnRenamed("v", "x"), "j").groupBy("i").agg(*[F.sum(F.col("v") * F.col("x")[r]).alias(f"b{r}") for r in range(k)])
        return b.select("i", F.array(*[F.col(f"b{r}") / float(self.d[r]) for r in range(k)]).alias("score"))


def _reorder(df: DataFrame, col: str, at: np.ndarray) -> DataFrame:
    return df.withColumn(col, F.array(*[F.col(col)[int(r)] for r in at]))


def _cells(a: MatrixFrame) -> DataFrame:
    """All (i, j), made from one range rather than a product of two."""
    s = a.entries.sparkSession.range(a.m * a.n)
    return s.select((F.col("id") % a.m).alias("i"), F.floor(F.col("id") / a.m).cast("long").alias("j"))


Callback = Callable[[int, float, float], None]
