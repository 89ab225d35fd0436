"""Counter-based random numbers (the public splitmix64 generator), the same on the driver and in tasks."""

from __future__ import annotations

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def splitmix(x: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = np.asarray(x, np.uint64) + GOLDEN
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def uniform(seed: int, *index: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) as a function of the seed and integer arrays of one shape."""
    h = splitmix(np.uint64(seed or 12345))
    for x in index:
        h = splitmix(h ^ np.asarray(x).astype(np.uint64))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def normal(seed: int, *index: np.ndarray) -> np.ndarray:
    return np.sqrt(-2 * np.log(uniform(seed, *index))) * np.cos(2 * np.pi * uniform(seed + 7919, *index))


def held_out(seed: int, i: np.ndarray, j: np.ndarray, fraction: float) -> np.ndarray:
    """Speckled hold-out: entry (i, j) is in the test set; a function of the entry, never stored."""
    return uniform(seed, i, j) < fraction


def r_unif(n: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> np.ndarray:
    return low + (high - low) * uniform(seed, np.arange(n))


def r_sample(n: int, size: int | None = None, replace: bool = False, seed: int = 0) -> np.ndarray:
    size = n if size is None else size
    if replace:
        return (uniform(seed, np.arange(size)) * n).astype(np.int64)
    if size > n:
        raise ValueError("cannot take a sample larger than the population without replacement")
    return np.argsort(uniform(seed, np.arange(n)), kind="stable")[:size]


def r_binom(n: int, size: int = 1, prob: float = 0.5, seed: int = 0) -> np.ndarray:
    return (uniform(seed, np.repeat(np.arange(n), size), np.tile(np.arange(size), n)) < prob).reshape(n, size).sum(axis=1)


def r_matrix(nrow: int, ncol: int, seed: int = 0) -> np.ndarray:
    return uniform(seed, np.arange(nrow)[:, None] + np.zeros((1, ncol), int), np.arange(ncol)[None, :] + np.zeros((nrow, 1), int))


def r_sparsematrix(nrow: int, ncol: int, density: float, seed: int = 0) -> np.ndarray:
    x = r_matrix(nrow, ncol, seed)
    return np.where(r_matrix(nrow, ncol, seed + 1) < density, x, 0.0)
