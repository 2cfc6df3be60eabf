"""Losses, gradients and links of the three objectives, as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECTIVES = ("logistic", "hinge", "squared")


def loss(kind: str, y: Column, f: Column) -> Column:
    z = y * f
    if kind == "logistic":  # log(1 + exp(-z)) without overflow
        return F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))
    if kind == "hinge":
        return F.pow(F.greatest(1 - z, F.lit(0.0)), F.lit(2.0))
    return (y - f) * (y - f)


def pull(kind: str, y: Column, f: Column) -> Column:
    """A document's share of the negative gradient of each feature that it holds."""
    z = y * f
    if kind == "logistic":
        e = F.exp(-F.abs(z))
        return y * F.when(z > 0, e / (1 + e)).otherwise(1 / (1 + e))
    if kind == "hinge":
        return y * F.greatest(2 * (1 - z), F.lit(0.0))
    return 2 * (y - f)


def penalty_gradient(weight: float, c: float, alpha: float) -> float:
    """The elastic net's part of the gradient of a selected feature."""
    sign = (weight > 0) - (weight < 0)
    return c * (alpha * sign + (1 - alpha) * weight)


def penalty(weights, c: float, alpha: float) -> float:
    return c * (alpha * sum(map(abs, weights)) + (1 - alpha) / 2 * sum(w * w for w in weights))


def probability(score: Column) -> Column:
    e = F.exp(-F.abs(score))
    return F.when(score >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def pull_values(kind: str, y: np.ndarray, f: np.ndarray) -> np.ndarray:
    """:func:`pull` of arrays."""
    z = y * f
    if kind == "logistic":
        e = np.exp(-np.abs(z))
        return y * np.where(z > 0, e / (1 + e), 1 / (1 + e))
    if kind == "hinge":
        return y * np.maximum(2 * (1 - z), 0.0)
    return 2 * (y - f)
