"""One pass over the samples of a matrix: solve each sample's coefficients against a fixed factor, and sum what the other
factor needs.

The samples' coefficients H (k x n) never leave the tasks during a fit: with W fixed they are a function of the sample, so each
iteration is one narrow job over cached blocks that returns k, k x k and m x k sums (partial in each task, then by row). The
driver keeps W (m x k), whose size is checked. Small matrices take the same kernel on the driver, without a job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.losses import Loss, values, weights
from ..functions.rng import held_out
from ..sources.matrix import MatrixFrame
from .solve import EPS, nnls, nnls_each

LOCAL_NNZ = 3_000_000  # stored entries that the driver may hold
DRIVER_VALUES = 60_000_000  # numbers in a factor that the driver may hold
BLOCK_COLUMNS = 2048
BLOCK_ENTRIES = 1_000_000  # a block is cut after that many
TASK_ENTRIES = 1_500_000  # entries of a partition of blocks
FULL_VALUES = 2_000_000  # entries, zeros included, that a hold-out fills at once
SENT_VALUES = 8_000_000  # numbers of all partitions' sums that go to the driver as they are
PART_VALUES = 32_768  # numbers in a part of a sum
PACKED = "keys binary, ptr binary, idx binary, val binary, mask_ptr binary, mask_idx binary"


SPREAD = {"nb": "size", "gp": "theta"}  # the loss's parameter that a fit estimates


@dataclass(frozen=True)
class Rule:
    """How one side's coefficients are solved."""

    l1: float = 0.0
    l2: float = 0.0
    l21: float = 0.0
    angular: float = 0.0
    upper: float = 0.0
    nonneg: bool = True
    solver: str = "cd"
    target: np.ndarray | None = None  # one row for each of the side's items
    target_weight: float = 0.0
    extra: np.ndarray | None = None  # added to every Gram matrix: factor-wise ridges, the graph penalty


@dataclass(frozen=True)
class Plan:
    """What a pass does besides solving."""

    rule: Rule = Rule()
    loss: Loss = Loss()
    holdout: float = 0.0
    cv_seed: int = 0
    mask_zeros: bool = False  # only stored entries are data
    mask: bool = False  # the blocks' masks hold entries left out
    projective: bool = False
    rounds: int = 5  # reweighting rounds for losses other than squared error
    still: float = 1e-4  # rounds of a sample end when none of its coefficients moves more than this, relatively
    d: np.ndarray | None = None
    per_row: np.ndarray | None = None  # size or theta of each row
    per_col: bool = False  # size or theta of each sample, found from its own entries while it is solved

    def loss_of(self, at: np.ndarray | None) -> Loss:
        return self.loss if at is None else replace(self.loss, **{SPREAD[self.loss.name]: at})


@dataclass
class Sums:
    l1: np.ndarray
    gram: np.ndarray
    b: np.ndarray
    cross: float = 0.0
    row_gram: np.ndarray | None = None  # corrections to each row's Gram matrix
    loss: float = 0.0
    count: float = 0.0
    test: float = 0.0
    test_count: float = 0.0

    def add(self, o: Sums) -> Sums:
        for k in ("l1", "gram", "b", "cross", "loss", "count", "test", "test_count"):
            setattr(self, k, getattr(self, k) + getattr(o, k))
        if o.row_gram is not None:
            self.row_gram = o.row_gram if self.row_gram is None else self.row_gram + o.row_gram
        return self


@dataclass
class Block:
    """Some samples: keys, and their entries in compressed columns."""

    keys: np.ndarray
    ptr: np.ndarray
    idx: np.ndarray
    val: np.ndarray
    mask_ptr: np.ndarray | None = None  # entries left out, in the same form
    mask_idx: np.ndarray | None = None
    col: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.col = np.repeat(np.arange(len(self.keys)), np.diff(self.ptr))

    def part(self, of: np.ndarray) -> Block:
        """Some of the samples, without masks."""
        entry = of[self.col]
        return Block(self.keys[of], np.append(0, np.cumsum(np.diff(self.ptr)[of])), self.idx[entry], self.val[entry])

    def masked(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the entries left out, by column and row."""
        if self.mask_idx is None:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return self.mask_idx, np.repeat(np.arange(len(self.keys)), np.diff(self.mask_ptr))


def sum_by(col: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Rows of x (sorted by col) summed for each of n columns."""
    out = np.zeros((n, *x.shape[1:]))
    if len(col):
        start = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]]))
        out[col[start]] = np.add.reduceat(x, start, axis=0)
    return out


def sum_to(row: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """Rows of x summed for each of m rows, in any order."""
    flat = x.reshape(len(row), int(np.prod(x.shape[1:])))
    return np.stack([np.bincount(row, flat[:, c], m) for c in range(flat.shape[1])], axis=1).reshape(m, *x.shape[1:])


def products(b: Block, x: np.ndarray) -> np.ndarray:
    """A'X of the block's samples."""
    return np.stack([np.bincount(b.col, b.val * x[b.idx, c], len(b.keys)) for c in range(x.shape[1])], axis=1)


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each of x is one of y, which rise."""
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _left_out(blk: Block, m: int, p: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries not trained on, as (row, column, value, is test), and the mask over stored entries."""
    stored_test = held_out(p.cv_seed, blk.idx, blk.keys[blk.col], p.holdout) if p.holdout else np.zeros(len(blk.idx), bool)
    mask_rows, mask_cols = blk.masked() if p.mask else (np.empty(0, np.int64), np.empty(0, np.int64))
    stored, masked = blk.col * m + blk.idx, mask_cols * m + mask_rows
    stored_mask = _among(stored, masked) | np.isnan(blk.val)
    stored_test &= ~stored_mask
    gone = stored_test | stored_mask
    rows, cols, vals, test = blk.idx[gone], blk.col[gone], np.nan_to_num(blk.val[gone]), stored_test[gone]
    if not p.mask_zeros:  # zeros only
        more = []
        if p.holdout:
            step = max(1, FULL_VALUES // max(m, 1))
            for c in range(0, len(blk.keys), step):
                keys = blk.keys[c : c + step]
                full = held_out(p.cv_seed, np.arange(m)[None, :] + np.zeros((len(keys), 1), np.int64), keys[:, None] + np.zeros((1, m), np.int64), p.holdout)
                a, b = blk.ptr[c], blk.ptr[c + len(keys)]
                full[blk.col[a:b] - c, blk.idx[a:b]] = False
                here = (mask_cols >= c) & (mask_cols < c + len(keys))
                full[mask_cols[here] - c, mask_rows[here]] = False
                more.append((*np.nonzero(full), True))
                more[-1] = (more[-1][0] + c, *more[-1][1:])
        if len(masked):
            only = ~_among(masked, stored)
            more.append((mask_cols[only], mask_rows[only], False))
        for c, r, is_test in more:
            rows, cols = np.concatenate([rows, r]), np.concatenate([cols, c])
            vals, test = np.concatenate([vals, np.zeros(len(r))]), np.concatenate([test, np.full(len(r), is_test)])
    return gone, rows, cols, vals, test


def solve_block(blk: Block, w: np.ndarray, g: np.ndarray, p: Plan) -> tuple[np.ndarray, tuple]:
    """Coefficients (nb x k) of the block's samples."""
    m, k = w.shape
    nb, rule = len(blk.keys), p.rule
    gone, rows, cols, vals, test = _left_out(blk, m, p)
    keep = ~gone
    idx, col, val = blk.idx[keep], blk.col[keep], blk.val[keep]
    b = sum_by(col, val[:, None] * w[idx], nb)
    extra = (rows, cols, vals, test, idx, col, val, b)
    if p.projective:
        return b * (p.d if p.d is not None else 1.0), extra
    b0 = b - rule.l1
    base = g + rule.l2 * np.eye(k) + (0.0 if rule.extra is None else rule.extra)
    if rule.target is not None and rule.target_weight > 0:
        base = base + rule.target_weight * np.eye(k)
        b0 = b0 + rule.target_weight * rule.target[blk.keys]
    elif rule.target is not None and rule.target_weight < 0:
        base = adverse(base, rule.target, -rule.target_weight)
    own = len(rows) > 0 or p.mask_zeros or p.loss.reweighted
    if not own:
        return nnls(base, b0.T, rule.solver, rule.nonneg, rule.upper).T, extra
    outer = lambda r: (w[r][:, :, None] * w[r][:, None, :]).reshape(len(r), -1)
    fixed = np.broadcast_to((base - g if p.mask_zeros else base).reshape(1, -1), (nb, k * k)).copy()
    if p.mask_zeros:
        fixed += sum_by(col, outer(idx), nb)
    elif len(rows):
        o = np.argsort(cols, kind="stable")
        fixed -= sum_by(cols[o], outer(rows[o]), nb)
    h = nnls_each(fixed.reshape(nb, k, k), b0, rule.nonneg, rule.upper, solver=rule.solver)
    if p.loss.reweighted:
        prod, going = outer(idx), np.ones(nb, bool)
        for _ in range(p.rounds):
            mu = np.einsum("ek,ek->e", w[idx], h[col])
            wt = weights(val, mu, p.loss_of(spread(blk, h, w, g, p, idx, col, val)))
            bw = sum_by(col, (wt * val)[:, None] * w[idx], nb) + (b0 - b)
            new = nnls_each((fixed + sum_by(col, (wt - 1)[:, None] * prod, nb)).reshape(nb, k, k), bw, rule.nonneg, rule.upper, solver=rule.solver)
            moved = np.abs(new - h).max(axis=1) / (np.abs(new).max(axis=1) + EPS)
            h = np.where(going[:, None], new, h)
            going &= moved >= p.still  # each sample by itself, so that blocks do not matter
            if not going.any():
                break
    return h, extra


def nb_sizes(mu: np.ndarray, sq: np.ndarray, left: np.ndarray, low: float = 0.01, high: float = 1e6) -> np.ndarray:
    """Sizes by moments from sums of mu and mu^2 over all entries and of y^2 - 2 y mu; `high` where the variance is not above mu."""
    over = sq + left - mu
    return np.where((over > 1e-10) & (sq > 1e-10), np.clip(sq / np.where(over > 0, over, 1.0), low, high), high)


def gp_parts(y: np.ndarray, mu: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """What each stored entry adds to a majorising step for theta."""
    s = np.maximum(mu, 1e-10)
    share = s / np.maximum(s + theta * y, 1e-10)
    big = y >= 1
    return np.stack([big * (y - 1) * share, big * (y - 1) * (1 - share), big, y], axis=1)


def gp_thetas(parts: np.ndarray, mu: np.ndarray, old: np.ndarray, high: float = 5.0) -> np.ndarray:
    """The step from sums of gp_parts and of mu over all entries: the positive root of a quadratic."""
    alpha, gamma = parts[:, 0] + parts[:, 2], parts[:, 1]
    beta = parts[:, 3] - mu - gamma + alpha
    disc = beta**2 + 4 * alpha * gamma
    ok = (alpha > 1e-15) & (disc > 0)
    new = (-beta + np.sqrt(np.maximum(disc, 0))) / np.where(ok, 2 * alpha, 1.0)
    return np.where(ok & (new >= 0), np.minimum(new, high), old)


def spread(blk: Block, h: np.ndarray, w: np.ndarray, g: np.ndarray, p: Plan, idx: np.ndarray, col: np.ndarray, val: np.ndarray) -> np.ndarray | None:
    """Size or theta at each stored entry, None if the loss's own holds everywhere."""
    if p.per_row is not None:
        return p.per_row[idx]
    if not p.per_col:
        return None
    n, mu = len(blk.keys), np.einsum("ek,ek->e", w[idx], h[col])
    by = lambda x: sum_by(col, x, n)
    total = by(mu) if p.mask_zeros else h @ w.sum(axis=0)
    if p.loss.name == "nb":
        sq = by(mu**2) if p.mask_zeros else np.einsum("nk,kl,nl->n", h, g, h)
        return nb_sizes(total, sq, by(val**2 - 2 * val * mu))[col]
    theta = np.full(n, p.loss.theta)
    for _ in range(5):
        theta = gp_thetas(by(gp_parts(val, mu, theta[col])), total, theta)
    return theta[col]


def adverse(g: np.ndarray, target: np.ndarray, weight: float) -> np.ndarray:
    """Gram matrix with the target's directions taken out, kept positive definite."""
    tt = target.T @ target / max(1, len(target))
    if np.trace(tt) <= 0:
        return g
    val, vec = np.linalg.eigh(g - weight * np.trace(g) / np.trace(tt) * tt)
    return (vec * np.maximum(val, 1e-8)) @ vec.T


def turned(f: np.ndarray, cos: np.ndarray, norms: np.ndarray, weight: float) -> np.ndarray:
    """Angular penalty after a solve: each factor steps away from the directions it shares; items in rows."""
    off = cos - np.diag(np.diag(cos))
    unit = f / np.maximum(norms, EPS)
    return np.maximum(f - weight * norms * (unit @ off), 0.0)


def block_sums(blk: Block, h: np.ndarray, extra: tuple, w: np.ndarray, p: Plan) -> Sums:
    m, k = w.shape
    rows, cols, vals, test, idx, col, val, b = extra
    s = Sums(np.abs(h).sum(axis=0), h.T @ h, np.zeros((m, k)), float((h * b).sum()))
    own = len(rows) > 0 or p.mask_zeros or p.loss.reweighted
    wt = np.ones(len(val))
    if p.loss.reweighted:
        mu = np.einsum("ek,ek->e", w[idx], h[col])
        full = p.loss_of(spread(blk, h, w, w.T @ w, p, idx, col, val))
        wt = weights(val, mu, full)
        s.loss = float(values(val, mu, full).sum())
        s.count = len(val)
    elif own:
        mu = np.einsum("ek,ek->e", w[idx], h[col])
        s.loss, s.count = float(((val - mu) ** 2).sum()), len(val)
        if not p.mask_zeros:  # training zeros, by the Gram identity
            out = np.einsum("ek,ek->e", w[rows], h[cols])
            s.loss += float(np.einsum("kl,kl->", w.T @ w, h.T @ h) - (mu**2).sum() - (out**2).sum())
            s.count = m * len(blk.keys) - len(rows)
    if test.any():
        mt = np.einsum("ek,ek->e", w[rows[test]], h[cols[test]])
        loss = p.loss_of(None if p.per_row is None else p.per_row[rows[test]]) if p.loss.reweighted else Loss()
        s.test, s.test_count = float(values(vals[test], mt, loss).sum()), int(test.sum())
    s.b = sum_to(idx, (wt * val)[:, None] * h[col], m)
    if own:
        def row_part(r: np.ndarray, c: np.ndarray, f: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(r, f * h[c, x] * h[c, y], m) for x in range(k) for y in range(k)], axis=1)

        if p.mask_zeros:
            s.row_gram = row_part(idx, col, wt)
        else:
            s.row_gram = row_part(idx, col, wt - 1) if p.loss.reweighted else np.zeros((m, k * k))
            if len(rows):
                s.row_gram -= row_part(rows, cols, np.ones(len(rows)))
    return s


class Samples:
    """The samples of a matrix, on the driver or in cached blocks, which are rows of bytes: keys, and stored and masked entries in
    compressed columns. Samples without entries are there too."""

    def __init__(self, a: MatrixFrame, local_nnz: int = LOCAL_NNZ, mask: DataFrame | None = None) -> None:
        self.m, self.n, self.frame = a.m, a.n, a
        good = F.col("v").isNotNull() & ~F.isnan("v")
        one = a.entries.agg(F.count("*"), F.sum(F.when(good, F.col("v") * F.col("v"))), F.count(F.when(good, 1))).first()
        self.local = one[0] <= local_nnz
        self.square, self.missing = float(one[1] or 0.0), one[2] < one[0]
        self.mask = mask is not None
        if self.local and mask is not None:
            self.local = mask.limit(local_nnz + 1).count() <= local_nnz
        rows = _sample_rows(a, mask)
        if self.local:
            t = rows.toArrow()
            self.blocks = list(_blocks(_packed(t.sort_by([(c, "ascending") for c in ("j", "i", "kind")])))) if len(t) else []
        else:
            self.partitions = spread_over(a.entries.sparkSession, one[0] + a.n)
            self.frame_blocks = rows.repartition(self.partitions, "j").sortWithinPartitions("j", "i", "kind").mapInArrow(_pack, PACKED).persist()

    def _check(self, w: np.ndarray) -> None:
        if w.size > DRIVER_VALUES:
            raise ValueError(f"a factor of {w.shape[0]} x {w.shape[1]} is too large; factorise the transpose")

    def run(self, w: np.ndarray, p: Plan, shape: tuple | None = None) -> Sums:
        """shape: (norms, cosines) of the side's factors for the angular penalty."""
        self._check(w)
        m, k = w.shape
        own = p.mask_zeros or p.loss.reweighted or p.holdout > 0 or p.mask or self.missing

        def one(blk: Block, w: np.ndarray) -> tuple[Sums, tuple]:
            h, extra = solve_block(blk, w, w.T @ w + EPS * np.eye(k), p)
            if p.rule.angular and shape is not None:
                h = turned(h, shape[1], shape[0], p.rule.angular)
            return block_sums(blk, h, extra, w, p), (h, extra)

        if self.local:
            out, self.last = Sums(np.zeros(k), np.zeros((k, k)), np.zeros((m, k))), []
            for blk in self.blocks:
                s, solved = one(blk, w)
                out.add(s)
                self.last.append(solved)
            return out

        def sums(blk: Block, w: np.ndarray) -> np.ndarray:
            """Rows 0..m-1: b and, if there are any, the rows' Gram corrections; then the Gram matrix, l1 and five numbers."""
            s, _ = one(blk, w)
            x = np.zeros((m + k + 6, k + k * k if own else k))
            x[:m, :k] = s.b
            if s.row_gram is not None:
                x[:m, k:] = s.row_gram
            x[m : m + k, :k], x[m + k, :k] = s.gram, s.l1
            x[m + k + 1 :, 0] = s.cross, s.loss, s.count, s.test, s.test_count
            return x

        x = self.sweep(sums, m + k + 6, k + k * k if own else k, w)
        return Sums(x[m + k, :k], x[m : m + k, :k], x[:m, :k], x[m + k + 1, 0], x[:m, k:] if own else None, *x[m + k + 2 :, 0])

    def stats(self, fn, width: int, w: np.ndarray, p: Plan, shape: tuple | None = None) -> np.ndarray:
        """Sums by row of fn(h, row, column, value) -> (entries x width) over the training entries of the last pass (which other
        tasks solve again, as coefficients are not kept)."""
        m = self.m

        def by_row(h: np.ndarray, extra: tuple) -> np.ndarray:
            idx, col, val = extra[4:7]
            return sum_to(idx, fn(h, idx, col, val), m)

        if self.local:
            return sum((by_row(*x) for x in self.last), np.zeros((m, width)))

        def one(blk: Block, w: np.ndarray) -> np.ndarray:
            h, extra = solve_block(blk, w, w.T @ w + EPS * np.eye(w.shape[1]), p)
            if p.rule.angular and shape is not None:
                h = turned(h, shape[1], shape[0], p.rule.angular)
            return by_row(h, extra)

        return self.sweep(one, m, width, w)

    def against(self, h: np.ndarray) -> Sums:
        """Sums for given coefficients (n x k), which the driver holds."""
        self._check(h)
        m = self.m

        def one(blk: Block, h: np.ndarray) -> np.ndarray:  # nothing of self, which tasks cannot get
            return sum_to(blk.idx, np.nan_to_num(blk.val)[:, None] * h[blk.keys[blk.col]], m)

        return Sums(np.abs(h).sum(axis=0), h.T @ h, self.sweep(one, m, h.shape[1], h))

    def coefficients(self, w: np.ndarray, p: Plan, scale: np.ndarray | None = None, shape: tuple | None = None) -> DataFrame:
        """(j, h) of every sample, as a DataFrame."""
        self._check(w)
        g = w.T @ w + EPS * np.eye(w.shape[1])
        by = np.ones(w.shape[1]) if scale is None else scale

        def one(blk: Block) -> np.ndarray:
            h, _ = solve_block(blk, w, g, p)
            if p.rule.angular and shape is not None:
                h = turned(h, shape[1], shape[0], p.rule.angular)
            return h / by

        return self.each(one, "j", "h")

    def each(self, fn, key: str, col: str) -> DataFrame:
        """(key, col): a vector of each sample, fn(block) -> (samples x width)."""
        if self.local:
            x = np.concatenate([fn(b) for b in self.blocks]) if self.blocks else np.empty((0, 1))
            return factor_frame(self.frame.entries.sparkSession, x, key, col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for blk in _blocks(batches):
                yield pa.RecordBatch.from_arrays([pa.array(blk.keys), listed(fn(blk))], [key, col])

        return self.frame_blocks.mapInArrow(run, f"{key} long, {col} array<double>")

    def sweep(self, fn, m: int, width: int, shared: np.ndarray | None = None) -> np.ndarray:
        """Sum over blocks of fn(block, shared) -> (m x width), on the driver or in tasks; `shared` is broadcast once."""
        if self.local:
            out = np.zeros((m, width))
            for b in self.blocks:
                out += fn(b) if shared is None else fn(b, shared)
            return out
        spark = self.frame.entries.sparkSession
        sent = None if shared is None else spark.sparkContext.broadcast(shared)
        rows = max(1, PART_VALUES // max(width, 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for blk in _blocks(batches):
                x = fn(blk) if sent is None else fn(blk, sent.value)
                total = x if total is None else np.add(total, x, out=total)
            if total is None:
                return
            for p in range(0, -(-m // rows)):
                x = total[p * rows : (p + 1) * rows]
                if x.any():
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.ascontiguousarray(x, float).tobytes()], pa.binary())], ["p", "x"])

        def merged(key: tuple, part: pa.Table) -> pa.Table:
            return pa.table({"p": pa.array([key[0].as_py()], pa.int32()), "x": pa.array([sum(np.frombuffer(x.as_buffer()) for x in part["x"]).tobytes()], pa.binary())})

        sums = self.frame_blocks.mapInArrow(run, "p int, x binary")
        if self.partitions * m * width > SENT_VALUES:
            sums = sums.groupBy("p").applyInArrow(merged, "p int, x binary")
        out = np.zeros((m, width))
        for batch in sums.toArrow().to_batches():
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                out[p * rows : (p + 1) * rows] += np.frombuffer(x.as_buffer()).reshape(-1, width)
        if sent is not None:
            sent.unpersist()
        return out

    def release(self) -> None:
        if not self.local:
            self.frame_blocks.unpersist()


def factor_frame(spark: SparkSession, x: np.ndarray, key: str = "j", col: str = "h") -> DataFrame:
    """Rows of an array as (key, col)."""
    return spark.createDataFrame(pa.table({key: pa.array(np.arange(len(x))), col: listed(x)}), f"{key} long, {col} array<double>")


def listed(x: np.ndarray) -> pa.ListArray:
    x = np.ascontiguousarray(x, float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _sample_rows(a: MatrixFrame, mask: DataFrame | None) -> DataFrame:
    """(j, i, v, kind): stored entries (0), masked ones (1) and a row for each sample (2)."""
    inside, none = (F.col("j") >= 0) & (F.col("j") < a.n), F.lit(None).cast("double")
    kind = lambda x: F.lit(x).cast("byte").alias("kind")
    e = a.entries.where("v <> 0 or v is null").where(inside).select("j", F.col("i").cast("int").alias("i"), "v", kind(0))
    e = e.unionByName(a.entries.sparkSession.range(a.n).select(F.col("id").alias("j"), F.lit(None).cast("int").alias("i"), none.alias("v"), kind(2)))
    if mask is not None:
        e = e.unionByName(mask.where(inside & (F.col("i") >= 0) & (F.col("i") < a.m)).select("j", F.col("i").cast("int").alias("i"), none.alias("v"), kind(1)))
    return e


def spread_over(spark: SparkSession, entries: int) -> int:
    return max(1, -(-entries // TASK_ENTRIES), min(spark.sparkContext.defaultParallelism, -(-entries // 50_000)))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > 200_000:
            t = pa.Table.from_batches(held)
            j = t["j"].to_numpy()
            cut = int(np.searchsorted(j, j[-1]))  # the last sample may go on
            if cut:
                yield from _packed(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows -= cut
    if rows:
        yield from _packed(pa.Table.from_batches(held))


def _packed(t: pa.Table) -> Iterator[pa.RecordBatch]:
    j, kind = t["j"].to_numpy(), t["kind"].to_numpy()
    i, v = t["i"].fill_null(-1).to_numpy(), t["v"].to_numpy()  # null: NaN
    keys, first = np.unique(j, return_index=True)
    at = np.append(first, len(j))
    a = 0
    while a < len(keys):
        b = max(a + 1, min(a + BLOCK_COLUMNS, int(np.searchsorted(at, at[a] + BLOCK_ENTRIES, "right")) - 1))
        s = slice(at[a], at[b])
        jj, ii, vv, kk = j[s], i[s], v[s], kind[s]
        one, two = kk == 0, kk == 1
        two[1:] &= ~((jj[1:] == jj[:-1]) & (ii[1:] == ii[:-1]) & two[:-1])
        own = keys[a:b]
        ptr = lambda x: np.append(np.searchsorted(jj[x], own), x.sum()).astype(np.int64).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (own.astype(np.int64).tobytes(), ptr(one), ii[one].astype(np.int32).tobytes(), vv[one].astype(float).tobytes(), ptr(two), ii[two].astype(np.int32).tobytes())], [c.split()[0] for c in PACKED.split(", ")])
        a = b


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for r in range(batch.num_rows):
            keys, ptr, idx, val, mask_ptr, mask_idx = (np.frombuffer(batch.column(c)[r].as_buffer(), t) if batch.column(c)[r].as_buffer().size else np.empty(0, t) for c, t in enumerate((np.int64, np.int64, np.int32, float, np.int64, np.int32)))
            yield Block(keys, ptr, idx.astype(np.int64), val, mask_ptr, mask_idx.astype(np.int64))
