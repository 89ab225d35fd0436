"""Factor graphs: inputs, layers and combinators as frozen nodes, compiled into an order and fitted by the engines."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from itertools import product
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.matrix import MatrixFrame
from .models import NMF, SVD
from .nmf import Config, Fit, project
from .svd import svd


@dataclass(frozen=True, eq=False)
class Node:
    name: str = ""


@dataclass(frozen=True, eq=False)
class Input(Node):
    data: MatrixFrame | None = None


@dataclass(frozen=True)
class Override:
    """Settings of one side of a layer; they beat the layer's own."""

    side: str
    values: dict[str, Any]


def W(**values: Any) -> Override:
    return Override("w", values)


def H(**values: Any) -> Override:
    return Override("h", values)


@dataclass(frozen=True, eq=False)
class Layer(Node):
    input: Node | None = None
    k: int = 0
    kind: str = "nmf"
    options: dict[str, Any] = field(default_factory=dict)
    sides: tuple[Override, ...] = ()


@dataclass(frozen=True, eq=False)
class Combine(Node):
    kind: str = "shared"
    inputs: tuple[Node, ...] = ()
    extra: DataFrame | None = None
    extra_width: int = 0


def factor_input(data: MatrixFrame, name: str = "") -> Input:
    return Input(name, data)


def nmf_layer(input: Node, k: int, *sides: Override, name: str = "", **options: Any) -> Layer:
    bad = set(options) - set(Config.__dataclass_fields__)
    if bad:
        raise TypeError(f"unknown layer options: {', '.join(sorted(bad))}")
    return Layer(name, input, k, "nmf", options, tuple(sides))


def svd_layer(input: Node, k: int, name: str = "", **options: Any) -> Layer:
    return Layer(name, input, k, "svd", options)


def factor_shared(*inputs: Node) -> Combine:
    """Matrices over the same samples, stacked by rows; one H."""
    if len(inputs) < 2:
        raise ValueError("factor_shared needs two inputs or more")
    return Combine("", "shared", inputs)


def factor_concat(*inputs: Node) -> Combine:
    """Branches' H side by side."""
    if len(inputs) < 2:
        raise ValueError("factor_concat needs two inputs or more")
    return Combine("", "concat", inputs)


def factor_add(*inputs: Node) -> Combine:
    """Branches' H added; their ranks are equal."""
    if len({x.k for x in inputs if isinstance(x, Layer)}) > 1:
        raise ValueError("factor_add needs layers of one rank")
    return Combine("", "add", inputs)


def factor_condition(input: Node, z: DataFrame, width: int) -> Combine:
    """H with the columns of z (j, z array of this width) appended."""
    return Combine("", "condition", (input,), z, width)


@dataclass(frozen=True)
class GraphConfig:
    maxit: int = 100
    tol: float = 1e-4
    seed: int = 1
    init_iterations: int = 10
    outer: int = 5
    local_nnz: int = Config.__dataclass_fields__["local_nnz"].default


@dataclass(frozen=True)
class Net:
    inputs: tuple[Input, ...]
    output: Node
    config: GraphConfig
    order: tuple[Layer, ...]
    names: dict[int, str]

    def __repr__(self) -> str:
        return "net: " + " -> ".join(f"{self.names[id(x)]}({x.kind}, k={x.k})" for x in self.order)


def factor_net(inputs: Input | list[Input], output: Node, config: GraphConfig | None = None) -> Net:
    """Checks that the output depends on every input, and puts layers in order; unnamed layers are L1, L2, ..."""
    ins = tuple(inputs) if isinstance(inputs, (list, tuple)) else (inputs,)
    order: list[Layer] = []
    seen: set[int] = set()
    reached: set[int] = set()

    def visit(x: Node | None) -> None:
        if x is None:
            raise ValueError("a node has no input")
        if id(x) in seen:
            return
        seen.add(id(x))
        if isinstance(x, Input):
            reached.add(id(x))
        elif isinstance(x, Layer):
            visit(x.input)
            order.append(x)
        else:
            for y in x.inputs:
                visit(y)

    visit(output)
    if not order:
        raise ValueError("the graph has no layer")
    if missing := [x.name or "?" for x in ins if id(x) not in reached]:
        raise ValueError(f"inputs that the output does not use: {', '.join(missing)}")
    names = {id(x): x.name or f"L{k}" for k, x in enumerate(order, 1)}
    if len(set(names.values())) != len(names):
        raise ValueError("layer names are not unique")
    return Net(ins, output, config or GraphConfig(), tuple(order), names)


@dataclass(frozen=True)
class NetResult:
    """One model a layer; modalities split the rows of a shared layer's w."""

    net: Net
    layers: dict[str, NMF | SVD]
    loss: float
    history: list[float]
    modalities: dict[str, dict[str, np.ndarray]]

    def __getitem__(self, name: str) -> NMF | SVD:
        return self.layers[name]

    def __getattr__(self, name: str) -> Any:
        layers = self.__dict__.get("layers", {})
        if name in layers:
            return layers[name]
        raise AttributeError(name)

    def summary(self) -> pd.DataFrame:
        return pd.DataFrame([(n, type(m).__name__, *m.shape, m.misc.get("loss")) for n, m in self.layers.items()], columns=["layer", "model", "rows", "samples", "k", "loss"])

    def predict(self, a: MatrixFrame) -> DataFrame:
        """New samples through the chain of layers: (j, h)."""
        x, out = a, None
        for layer in self.net.order:
            if isinstance(layer.input, Combine):
                raise ValueError("prediction needs a chain of single inputs")
            m = self.layers[self.net.names[id(layer)]]
            out = project(x, m.w if isinstance(m, NMF) else m.u)
            x = as_matrix(out, m.k, a.n)
        return out


def as_matrix(h: DataFrame, k: int, n: int) -> MatrixFrame:
    """k x n matrix of coefficients: factors are the rows of the next layer."""
    e = h.select("j", F.posexplode("h").alias("i", "v")).select(F.col("i").cast("long").alias("i"), "j", "v").where("v <> 0")
    return MatrixFrame(e, k, n)


def _coefficients(m: NMF | SVD) -> DataFrame:
    if isinstance(m, NMF):
        return m.h.select("j", F.array(*[F.col("h")[r] * float(m.d[r]) for r in range(m.k)]).alias("h"))
    return m.v.select("j", F.array(*[F.col("v")[r] * float(m.d[r]) for r in range(m.k)]).alias("h"))


def _resolve(x: Node, net: Net, fitted: dict[str, NMF | SVD]) -> tuple[MatrixFrame, list[tuple[str, int]]]:
    """The matrix that a layer sees, and the rows of each part of a shared one."""
    if isinstance(x, Input):
        return x.data, [(x.name, x.data.m)]
    if isinstance(x, Layer):
        m = fitted[net.names[id(x)]]
        return as_matrix(_coefficients(m), m.k, m.n), [(net.names[id(x)], m.k)]
    parts = [_resolve(y, net, fitted) for y in x.inputs]
    mats = [p[0] for p in parts]
    rows = [(f"{n or 'part'}" if sum(n == q for z in parts for q, _ in z[1]) == 1 else f"{n or 'part'}{k + 1}", r) for k, p in enumerate(parts) for n, r in p[1]]
    if x.kind in ("shared", "concat"):
        return MatrixFrame.rbind(mats), rows
    if x.kind == "add":
        e = mats[0].entries
        for m in mats[1:]:
            e = e.unionByName(m.entries)
        return MatrixFrame.from_long(e, m=mats[0].m, n=mats[0].n), rows[:1]
    z = x.extra.select("j", F.posexplode("z").alias("i", "v")).select(F.col("i").cast("long").alias("i"), "j", "v")
    return MatrixFrame.rbind([mats[0], MatrixFrame(z, x.extra_width, mats[0].n)]), [*rows, ("z", x.extra_width)]


def _layer_config(x: Layer, g: GraphConfig, maxit: int) -> Config:
    base = {"k": x.k, "maxit": maxit, "tol": g.tol, "seed": g.seed, "local_nnz": g.local_nnz} | x.options
    for side in x.sides:
        at = 0 if side.side == "w" else 1
        for name, v in side.values.items():
            old = base.get(name, Config.__dataclass_fields__[name].default)
            pair = list(old) if isinstance(old, (tuple, list)) else [old, old]
            pair[at] = v
            base[name] = tuple(pair)
    return Config(**base)


def fit(net: Net) -> NetResult:
    """One layer: a plain fit. More: each layer in order, then outer rounds that go on from the layers' factors."""
    g = net.config
    fitted: dict[str, NMF | SVD] = {}
    parts: dict[str, dict[str, np.ndarray]] = {}
    history: list[float] = []
    deep = len(net.order) > 1
    for outer in range(g.outer if deep else 1):
        total = 0.0
        for x in net.order:
            name = net.names[id(x)]
            a, rows = _resolve(x.input, net, fitted)
            if x.kind == "svd":
                m = svd(a, min(x.k, a.m, a.n), **x.options)
                total += float(m.misc["frobenius_sq"] - (m.d**2).sum()) / max(1, a.m * a.n)
            else:
                c = _layer_config(x, g, (g.init_iterations if outer == 0 else max(1, g.maxit // (10 * g.outer))) if deep else g.maxit)
                if outer and name in fitted and fitted[name].w.shape == (a.m, x.k):
                    c = replace(c, init=fitted[name].w)
                m = Fit(a, replace(c, sort_model=not deep and c.sort_model)).run()
                total += float(m.misc["loss"]) / max(1, a.m * a.n)
            fitted[name] = m
            left = m.w if isinstance(m, NMF) else m.u
            cut = np.cumsum([0, *(r for _, r in rows)])
            parts[name] = {n: left[p:q] for (n, _), p, q in zip(rows, cut[:-1], cut[1:])}
        history.append(total)
        if len(history) > 1 and abs(history[-2] - total) / (abs(history[-2]) + 1e-15) < g.tol:
            break
    return NetResult(net, fitted, history[-1], history, parts)


def fit_shared(data: dict[str, MatrixFrame], k: int, config: Config | None = None, **kw: Any) -> NetResult:
    """Matrices over the same samples with one H."""
    ins = [factor_input(x, n) for n, x in data.items()]
    base = {f.name: getattr(config, f.name) for f in fields(Config) if f.name != "k"} if config else {}
    opts = base | kw
    return fit(factor_net(ins, nmf_layer(factor_shared(*ins), k, **opts), GraphConfig(maxit=opts.get("maxit", 100))))


def cross_validate_graph(layer_fn: Callable[[dict], Net], params: dict[str, list], reps: int = 1, strategy: str = "grid", n_random: int = 10, seed: int = 1) -> tuple[pd.DataFrame, dict]:
    """Loss of each setting, mean and standard error over repeats; and the best setting."""
    grid = [dict(zip(params, v)) for v in product(*params.values())]
    if strategy == "random":
        grid = random.Random(seed).sample(grid, min(n_random, len(grid)))
    elif strategy != "grid":
        raise ValueError("strategy must be grid or random")
    rows = []
    for p in grid:
        for rep in range(reps):
            net = layer_fn(p)
            net = replace(net, config=replace(net.config, seed=net.config.seed + rep))
            rows.append(p | {"rep": rep + 1, "loss": fit(net).loss})
    t = pd.DataFrame(rows)
    s = t.groupby(list(params), dropna=False)["loss"].agg(["mean", "std", "count"]).reset_index()
    s["se"] = (s["std"] / np.sqrt(s["count"])).fillna(0.0)
    best = s.loc[s["mean"].idxmin(), list(params)].to_dict()
    return s[[*params, "mean", "se"]], best


class TrainingLogger:
    """Collects losses, and any measure of the user's, by iteration: pass it as on_iteration."""

    def __init__(self, every: int = 1, measure: Callable[[int], dict[str, float]] | None = None) -> None:
        self.every, self.measure, self.rows = every, measure, []

    def __call__(self, it: int, train: float, test: float) -> None:
        if it % self.every == 0:
            self.rows.append({"iteration": it, "train_loss": float(train), "test_loss": float(test)} | (self.measure(it) if self.measure else {}))

    def to_pandas(self) -> pd.DataFrame:
        return pd.DataFrame(self.rows)

    def export(self, path: str) -> None:
        self.to_pandas().to_csv(path, index=False)

    def __repr__(self) -> str:
        return f"training log of {len(self.rows)} iterations"


def embedding_frame(x: NMF | SVD) -> DataFrame:
    return _coefficients(x)


