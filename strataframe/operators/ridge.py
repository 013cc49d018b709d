"""Ridge regression from distributed moments: one pass for means, one for Gram and cross moments, a small solve."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import arrays as A
from ..plans.moments import cell_moments, gram, mean_vector
from . import metrics, sampling

# The regularisation grid of the multivariate probe.
LAMBDAS = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1000.0, 1e4, 1e5)


@dataclass
class RidgeMap:
    mu: np.ndarray
    scale: np.ndarray
    target_mean: np.ndarray
    weights: np.ndarray


def fit_ridge_map(train: DataFrame, alpha: float = 1000.0, x: str = "x", y: str = "y") -> RidgeMap:
    """Multi-output ridge on standardised features (population deviation), intercept unpenalised: one pass for the means,
    one for all products."""
    xy = train.select(A.as_double(x).alias("_x"), F.concat(A.as_double(x), A.as_double(y)).alias("_xy"))
    row = cell_moments(xy, [], "_xy", extra=[F.max(F.size("_x")).alias("d")]).first()
    n, d, mean = int(row["n"]), int(row["d"]), np.array(row["mean"])
    sd = np.sqrt(np.array(row["within"])[:d] / n)
    sd = np.where(sd > 0, sd, 1.0)
    cross, _, _ = gram(xy, "_x", "_xy", center_left=mean[:d], center_right=mean, scale_left=sd)
    g, c = cross[:, :d] / sd, cross[:, d:]
    return RidgeMap(mean[:d], sd, mean[d:], np.linalg.solve(g + alpha * np.eye(d), c))


def apply_ridge_map(df: DataFrame, model: RidgeMap, x: str = "x", out: str = "prediction") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def predict(col: pd.Series) -> pd.Series:
        m = shared.value
        if not len(col):
            return pd.Series([], dtype=object)
        rows = (np.stack(col.to_numpy()).astype(float) - m.mu) / m.scale
        return pd.Series(list(rows @ m.weights + m.target_mean))

    return df.withColumn(out, predict(A.as_double(x)))


def ridge_table(spark, model: RidgeMap) -> DataFrame:
    """The fitted map as a table, to be written once and joined by streams."""
    rows = [("mu", 0, model.mu), ("scale", 0, model.scale), ("target_mean", 0, model.target_mean)]
    rows += [("weights", i, w) for i, w in enumerate(model.weights)]
    return spark.createDataFrame([(p, i, [float(v) for v in w]) for p, i, w in rows], "part string, i int, v array<double>")


def ridge_from_table(df: DataFrame) -> RidgeMap:
    parts = {}
    for r in df.orderBy("part", "i").collect():
        parts.setdefault(r["part"], []).append(r["v"])
    return RidgeMap(
        np.array(parts["mu"][0]), np.array(parts["scale"][0]), np.array(parts["target_mean"][0]), np.array(parts["weights"])
    )


def principal_map(train: DataFrame, n_components: int, x: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal axes (columns): the compression baseline."""
    _, mu = mean_vector(train, x)
    scatter, _, _ = gram(train, x, center_left=mu)
    values, vectors = np.linalg.eigh(scatter)
    return mu, vectors[:, np.argsort(values)[::-1][:n_components]]


def _ridge_paths(train: DataFrame, lambdas: Sequence[float], x: str, y: str):
    xy = train.select(A.as_double(x).alias("_x"), F.concat(A.as_double(x), F.array(F.col(y).cast("double"))).alias("_xy"))
    _, mean = mean_vector(xy, "_xy")
    d = len(mean) - 1
    mu, y_mean = mean[:d], mean[d:]
    cross, _, _ = gram(xy, "_x", "_xy", center_left=mu, center_right=mean)
    g, c = cross[:, :d], cross[:, d:]
    values, vectors = np.linalg.eigh(g)
    turned = vectors.T @ c
    weights = np.hstack([vectors @ (turned / (values[:, None] + lam)) for lam in lambdas])
    return mu, float(y_mean[0]), weights


def _score_paths(df: DataFrame, model, lambdas, kind: str, x: str, y: str, by: Sequence[str]) -> DataFrame:
    mu, y_mean, weights = model
    shared = df.sparkSession.sparkContext.broadcast((mu, y_mean, weights))

    @F.pandas_udf("array<double>")
    def predict(col: pd.Series) -> pd.Series:
        m, b, w = shared.value
        if not len(col):
            return pd.Series([], dtype=object)
        return pd.Series(list((np.stack(col.to_numpy()).astype(float) - m) @ w + b))

    grid = F.lit([float(v) for v in lambdas])
    rows = df.select(*by, "row_id", F.col(y).cast("double").alias("y"), predict(A.as_double(x)).alias("_p"))
    rows = rows.select(*by, "row_id", "y", F.posexplode("_p").alias("_i", "p")).withColumn("lam", grid[F.col("_i")])
    keys = [*by, "lam"]
    if kind == "binary":
        scored = metrics.rank_auc(rows, keys, "p", "y").select(*keys, "auc")
        return scored.select(*keys, F.greatest("auc", 1.0 - F.col("auc")).alias("score"))
    return metrics.r2(rows, "y", "p", keys).select(*keys, F.col("r2").alias("score"))


def ridge_probe(
    subjects: DataFrame,
    kind: str = "continuous",
    lambdas: Sequence[float] = LAMBDAS,
    select_on: str = "test",
    cv_folds: int = 5,
    seed: int = 0,
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Centred ridge over a grid of penalties, from rows ``row_id, split, x, y``; all penalties share one decomposition.

    ``select_on="test"`` reports the penalty that scores best on the test rows (optimistic); ``"train_cv"`` picks it by
    folds of the training rows. The score is R^2, or AUC mirrored above one half for a binary target.
    """
    train = subjects.where(F.col("split") == "train")
    scores = _score_paths(subjects, _ridge_paths(train, lambdas, x, y), lambdas, kind, x, y, ["split"])
    wide = scores.groupBy("lam").agg(
        F.max(F.when(F.col("split") == "train", F.col("score"))).alias("train_score"),
        F.max(F.when(F.col("split") == "test", F.col("score"))).alias("test_score"),
    )
    if select_on == "train_cv":
        folded = sampling.stratified_folds(train.withColumn("_all", F.lit(0)), "_all", cv_folds, seed)
        parts = None
        for k in range(cv_folds):
            held = folded.where(F.col("fold") == k)
            model = _ridge_paths(folded.where(F.col("fold") != k), lambdas, x, y)
            part = _score_paths(held, model, lambdas, kind, x, y, ["fold"])
            parts = part if parts is None else parts.unionByName(part)
        wide = wide.join(parts.groupBy("lam").agg(F.avg("score").alias("pick")), "lam")
    else:
        wide = wide.withColumn("pick", F.col("test_score"))
    best = wide.agg(F.min_by(F.struct("lam", "train_score", "test_score"), F.struct(-F.col("pick"), F.col("lam"))).alias("b"))
    sizes = subjects.agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test")
    )
    metric = F.lit("AUC" if kind == "binary" else "R2").alias("metric")
    return best.select(metric, F.col("b.lam").alias("best_lambda"), "b.train_score", "b.test_score").join(F.broadcast(sizes))
