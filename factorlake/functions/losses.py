"""Losses of an observed value y and a fitted value mu: Spark columns and their numpy twins, and reweighting rules."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10
WEIGHT_CAP = 1e6
ROBUST = {False: 0.0, True: 1.345, "mae": 1e-4}  # fixed values: tuning constants of the robust modifier


@dataclass(frozen=True)
class Loss:
    """name: mse, mae, huber, kl, gp, nb, gamma, inverse_gaussian or tweedie; the rest are its parameters."""

    name: str = "mse"
    delta: float = 1.0
    theta: float = 0.1
    size: float = 10.0
    power: float = 1.5
    robust: float = 0.0

    def __post_init__(self) -> None:
        if self.name not in NAMES:
            raise ValueError(f"loss must be one of {', '.join(NAMES)}, not {self.name!r}")
        if self.robust < 0:
            raise ValueError("robust must be FALSE, TRUE, 'mae' or a positive number")

    @property
    def reweighted(self) -> bool:
        return self.name not in ("mse",) or self.robust > 0


NAMES = ("mse", "mae", "huber", "kl", "gp", "nb", "gamma", "inverse_gaussian", "tweedie")


def column(y: Column, mu: Column, loss: Loss) -> Column:
    """Loss of one entry as a built-in expression (nb: for whole-number y, as Spark has no lgamma)."""
    r = y - mu
    p, m = F.greatest(y, F.lit(TINY)), F.greatest(mu, F.lit(TINY))
    if loss.robust:
        z = F.abs(r) / F.sqrt(F.greatest(_variance_column(mu, loss), F.lit(TINY)))
        return F.when(z <= loss.robust, z * z / 2).otherwise(loss.robust * (z - loss.robust / 2))
    match loss.name:
        case "mse":
            return r * r
        case "mae":
            return F.abs(r)
        case "huber":
            return F.when(F.abs(r) <= loss.delta, r * r / 2).otherwise(loss.delta * (F.abs(r) - loss.delta / 2))
        case "kl":
            return p * F.log(p / m) - p + m
        case "gp":
            t = F.lit(float(loss.theta))
            return -F.log(m / (1 + t)) - F.when(y >= 1, (y - 1) * F.log(F.greatest((m + t * y) / (1 + t), F.lit(TINY)))).otherwise(0.0) + (m + t * y) / (1 + t)
        case "nb":
            s = F.lit(float(loss.size))
            steps = F.when(y >= 1, F.aggregate(F.sequence(F.lit(0), F.greatest(y, F.lit(1.0)).cast("int") - 1), F.lit(0.0), lambda acc, t: acc + F.log(s + t))).otherwise(0.0)
            return -steps - s * F.log(s / (s + m)) - y * F.log(m / (s + m))
        case "gamma":
            return 2 * (-F.log(p / m) + (p - m) / m)
        case "inverse_gaussian":
            return (p - m) * (p - m) / (m * m * p)
    q = float(loss.power)
    if q == 1:
        return 2 * (p * F.log(p / m) - (p - m))
    if q == 2:
        return 2 * (-F.log(p / m) + (p - m) / m)
    return 2 * (F.pow(p, F.lit(2 - q)) / ((1 - q) * (2 - q)) - p * F.pow(m, F.lit(1 - q)) / (1 - q) + F.pow(m, F.lit(2 - q)) / (2 - q))


def _variance_column(mu: Column, loss: Loss) -> Column:
    match loss.name:
        case "nb":
            return mu + mu * mu / loss.size
        case "gamma":
            return mu * mu
        case "inverse_gaussian":
            return mu * mu * mu
        case "tweedie":
            return F.pow(F.greatest(mu, F.lit(TINY)), F.lit(float(loss.power)))
        case "kl" | "gp":
            return mu
    return F.lit(1.0)


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def values(y: np.ndarray, mu: np.ndarray, loss: Loss) -> np.ndarray:
    r = y - mu
    p, m = np.maximum(y, TINY), np.maximum(mu, TINY)
    if loss.robust:
        z = np.abs(r) / np.sqrt(np.maximum(variance(mu, loss), TINY))
        return np.where(z <= loss.robust, z * z / 2, loss.robust * (z - loss.robust / 2))
    match loss.name:
        case "mse":
            return r * r
        case "mae":
            return np.abs(r)
        case "huber":
            return np.where(np.abs(r) <= loss.delta, r * r / 2, loss.delta * (np.abs(r) - loss.delta / 2))
        case "kl":
            return p * np.log(p / m) - p + m
        case "gp":
            t = loss.theta
            return -np.log(m / (1 + t)) - np.where(y >= 1, (y - 1) * np.log(np.maximum((m + t * y) / (1 + t), TINY)), 0.0) + (m + t * y) / (1 + t)
        case "nb":
            s = loss.size
            return -np.asarray(_lgamma(y + s), float) + np.asarray(_lgamma(s), float) - s * np.log(s / (s + m)) - y * np.log(m / (s + m))
        case "gamma":
            return 2 * (-np.log(p / m) + (p - m) / m)
        case "inverse_gaussian":
            return (p - m) ** 2 / (m * m * p)
    q = loss.power
    if q == 1:
        return 2 * (p * np.log(p / m) - (p - m))
    if q == 2:
        return 2 * (-np.log(p / m) + (p - m) / m)
    return 2 * (p ** (2 - q) / ((1 - q) * (2 - q)) - p * m ** (1 - q) / (1 - q) + m ** (2 - q) / (2 - q))


def variance(mu: np.ndarray, loss: Loss) -> np.ndarray:
    match loss.name:
        case "nb":
            return mu + mu * mu / loss.size
        case "gamma":
            return mu * mu
        case "inverse_gaussian":
            return mu**3
        case "tweedie":
            return np.maximum(mu, TINY) ** loss.power
        case "kl" | "gp":
            return mu
    return np.ones_like(mu)


def weights(y: np.ndarray, mu: np.ndarray, loss: Loss) -> np.ndarray:
    """Weights of the squared error that stands for the loss around mu."""
    m = np.maximum(mu, TINY)
    match loss.name:
        case "mae":
            w = 1 / np.maximum(np.abs(y - mu), 1e-4)
        case "huber":
            w = np.minimum(1.0, loss.delta / np.maximum(np.abs(y - mu), TINY))
        case "kl" | "gp":
            w = 1 / np.maximum(mu, 1e-4)
        case "nb":
            w = np.minimum(loss.size / (m * (loss.size + m)), WEIGHT_CAP)
        case "gamma":
            w = np.minimum(m**-2.0, WEIGHT_CAP)
        case "inverse_gaussian":
            w = np.minimum(m**-3.0, WEIGHT_CAP)
        case "tweedie":
            w = np.minimum(m**-loss.power, WEIGHT_CAP)
        case _:
            w = np.ones_like(mu)
    if loss.robust:
        z = np.abs(y - mu) / np.sqrt(np.maximum(variance(mu, loss), TINY))
        w = w * np.where(z > loss.robust, loss.robust / np.maximum(z, TINY), 1.0)
    return w
