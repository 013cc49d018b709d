"""Removing the linear identity subspace of a feature table, and measuring overlap of subspaces.

Rows are read for the mean, the Gram matrix and the subject means; width x width algebra runs on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import arrays as A
from ..plans.moments import cell_moments, gram, mean_vector


@dataclass
class Whitening:
    n: int
    mu: np.ndarray
    whiten: np.ndarray
    color: np.ndarray
    cond: float
    shrinkage: float


@dataclass
class Eraser:
    mu: np.ndarray
    projector: np.ndarray
    basis: np.ndarray
    rank: int


def ledoit_wolf_weight(cov: np.ndarray, n: int, quartic: float) -> float:
    """Shrinkage weight towards a scaled identity, from the covariance and sum |x - mu|^4 (Ledoit and Wolf, 2004)."""
    d = len(cov)
    mu = np.trace(cov) / d
    spread = float((cov * cov).sum())
    delta = (spread - d * mu * mu) / d
    beta = (quartic / n - spread) / (d * n)
    beta = min(beta, delta)
    return 0.0 if beta <= 0 or delta <= 0 else float(beta / delta)


def _spectral_power(variances: np.ndarray, axes: np.ndarray, live: np.ndarray, exponent: float) -> np.ndarray:
    """Power of a symmetric matrix on its live axes; zero on the others."""
    kept = axes[:, live]
    return kept @ np.diag(variances[live] ** exponent) @ kept.T


def fit_whitening(features: DataFrame, shrinkage: bool = True, vec: str = "x") -> Whitening:
    """Square root and pseudo-inverse square root of the (shrunk) covariance; directions below 1e-8 of the largest
    standard deviation are dropped from the inverse."""
    n, mu = mean_vector(features, vec)
    scatter, _, quartic = gram(features, vec, center_left=mu)
    cov = scatter / n
    weight = ledoit_wolf_weight(cov, n, quartic) if shrinkage else 0.0
    cov = (1.0 - weight) * cov + weight * np.trace(cov) / len(cov) * np.eye(len(cov))
    variances, axes = np.linalg.eigh(cov)
    live = variances > 1e-16 * max(variances[-1], 0.0)  # ascending, so the last is the largest
    cond = float(variances[-1] / variances[live][0]) if live.sum() > 1 else float("inf")
    half, minus_half = (_spectral_power(variances, axes, live, p) for p in (0.5, -0.5))
    return Whitening(n, mu, minus_half, half, cond, weight)


def fit_eraser(features: DataFrame, whitening: Whitening, subject: str = "subject_id", vec: str = "x") -> Eraser:
    """Oblique projector that removes all linear trace of ``subject`` with the least change to the features.

    The cross-covariance with a one-hot subject has one column n_s (mean_s - mu) / n per subject; its left singular
    vectors come from the Gram matrix of those columns, so no one-hot matrix and no subject list is formed.
    """
    cells = cell_moments(features, [subject], vec)
    weight = F.col("n").cast("double") / whitening.n
    columns = cells.select(
        F.transform(A.subtract(F.col("mean"), F.lit([float(v) for v in whitening.mu])), lambda v: v * weight).alias("c")
    )
    outer, _, _ = gram(columns, "c")
    white = whitening.whiten @ outer @ whitening.whiten
    values, vectors = np.linalg.eigh((white + white.T) / 2.0)
    values, vectors = values[::-1], vectors[:, ::-1]
    singular = np.sqrt(np.maximum(values, 0.0))
    rank = int((singular > 1e-6 * singular[0]).sum()) if singular[0] > 0 else 0
    u = vectors[:, :rank]
    basis = np.linalg.qr(whitening.color @ u)[0][:, :rank]
    projector = np.eye(len(white)) - whitening.color @ (u @ u.T) @ whitening.whiten
    return Eraser(whitening.mu, projector, basis, rank)


def apply_eraser(features: DataFrame, eraser: Eraser, vec: str = "x") -> DataFrame:
    """``(x - mu) P^T + mu`` on every row."""
    shared = features.sparkSession.sparkContext.broadcast((eraser.mu, eraser.projector.T.copy()))

    @F.pandas_udf("array<double>")
    def erase(x: pd.Series) -> pd.Series:
        mu, turn = shared.value
        if not len(x):
            return pd.Series([], dtype=object)
        rows = np.stack(x.to_numpy()).astype(float)
        return pd.Series(list((rows - mu) @ turn + mu))

    return features.withColumn(vec, erase(A.as_double(vec)))


def subspace_overlap(left: DataFrame, right: DataFrame, vec: str = "x") -> float:
    """|A^T B|^2 / min(rank) for two tables of orthonormal basis vectors; 0 when either is empty."""
    if left.isEmpty() or right.isEmpty():
        return 0.0
    a, na, _ = gram(left, vec)
    b, nb, _ = gram(right, vec)
    return float((a * b).sum() / min(na, nb))


def basis_table(spark, eraser: Eraser) -> DataFrame:
    """The erased subspace as rows of orthonormal vectors."""
    rows = [(i, [float(v) for v in eraser.basis[:, i]]) for i in range(eraser.rank)]
    return spark.createDataFrame(rows, "axis int, x array<double>")
