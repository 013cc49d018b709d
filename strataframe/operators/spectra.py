"""Spectra of weight matrices and of activation Gram matrices, and power-law tails."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..contracts import ContractError
from ..functions import arrays as A
from ..functions.scalars import round_half_even
from ..plans.moments import attach, gram, mean_vector
from ..plans.ordered import HOT_ROWS, ranked

TALL = 4
#: Eigenvalues up to this share of a matrix's largest are rounding noise of a deficient rank; they are left out.
NOISE = 1e-12


def _above_noise(lam: np.ndarray) -> np.ndarray:
    return lam[lam > NOISE * max(lam.max(initial=0.0), np.finfo(float).tiny)]


def matrix_eigenvalues(weights: DataFrame, keys: Sequence[str] = ("model", "layer"), row: str = "row_idx", vec: str = "w") -> DataFrame:
    """``keys, lam``: squared non-zero singular values of each matrix, those above ``NOISE`` times the largest.

    A matrix with at most ``TALL`` times as many rows as columns is decomposed by one task (so a group is bounded by its
    width); a taller one is first reduced to its Gram matrix, summed over tasks.
    """
    keys = list(keys)
    kind = weights.schema[vec].dataType
    if kind.typeName() != "array" or kind.elementType.typeName() == "array":
        raise ContractError("a weight row must be one array of numbers")
    rows = weights.select(*keys, row, A.as_double(vec).alias("w"))
    shapes = rows.groupBy(*keys).agg((F.count(F.lit(1)) > TALL * F.max(F.size("w"))).alias("_tall"))
    marked = rows.join(shapes, keys)
    schema = marked.select(*keys).schema.add("lam", "double")

    def decompose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.linalg.svd(np.stack(pdf["w"].to_numpy()), compute_uv=False)
        return pd.DataFrame({**dict(zip(keys, key)), "lam": _above_noise(s * s)})

    small = marked.where(~F.col("_tall")).drop("_tall").groupBy(*keys).applyInPandas(decompose, schema)

    def partial(batches):
        sums: dict[tuple, np.ndarray] = {}

        def flush():
            for key, g in sums.items():
                yield pd.DataFrame({**dict(zip(keys, key)), "i": np.arange(len(g)), "g": list(g)})
            sums.clear()

        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False):
                m = np.stack(part["w"].to_numpy())
                g = m.T @ m
                sums[key] = sums[key] + g if key in sums else g
                if sum(v.size for v in sums.values()) > 16_000_000:
                    yield from flush()
        yield from flush()

    gram_schema = marked.select(*keys).schema.add("i", "long").add("g", marked.schema["w"].dataType)
    parts = marked.where("_tall").select(*keys, "w").mapInPandas(partial, gram_schema)
    summed = parts.groupBy(*keys, "i").agg(Summarizer.metrics("sum").summary(array_to_vector("g")).alias("s"))

    def eigen(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lam = np.linalg.eigvalsh(np.stack(pdf.sort_values("i")["g"].to_numpy()))
        return pd.DataFrame({**dict(zip(keys, key)), "lam": _above_noise(lam)})

    tall = summed.select(*keys, "i", vector_to_array("s.sum").alias("g")).groupBy(*keys).applyInPandas(eigen, schema)
    return small.unionByName(tall)


def spectral_summary(eigenvalues: DataFrame, keys: Sequence[str], tail_frac: float = 0.5, lam: str = "lam", hot_rows=HOT_ROWS) -> DataFrame:
    """Participation ratio, stable rank, largest eigenvalue and Hill exponent of the upper tail of each spectrum.

    The tail holds ``max(2, round(tail_frac * n))`` values (half to even); the exponent is 1 + n / sum ln(l / l_min),
    NaN when the tail is flat.
    """
    keys = list(keys)
    live = eigenvalues.where(F.col(lam) > 0)
    sizes = live.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_eigs"))
    tail_n = F.least(F.greatest(F.lit(2).cast("bigint"), round_half_even(F.col("n_eigs") * tail_frac)), F.col("n_eigs"))
    rows = ranked(live.select(*keys, lam), keys, [F.desc(lam)], "_r", hot_rows=hot_rows)
    rows = attach(rows, sizes.withColumn("_t", tail_n), keys)
    inside = F.col("_r") <= F.col("_t")
    sums = rows.groupBy(*keys).agg(
        F.max("n_eigs").alias("n_eigs"),
        F.max("_t").alias("_t"),
        F.sum(lam).alias("_s"),
        F.sum(F.col(lam) * F.col(lam)).alias("_s2"),
        F.max(lam).alias("lambda_max"),
        F.min(F.when(inside, F.col(lam))).alias("_low"),
        F.sum(F.when(inside, F.log(F.col(lam)))).alias("_logs"),
    )
    spread = F.col("_logs") - F.col("_t") * F.log(F.col("_low") + 1e-30)
    return sums.select(
        *keys,
        (F.col("_s") * F.col("_s") / (F.col("_s2") + 1e-30)).alias("participation_ratio"),
        F.when(spread > 1e-12 * F.col("_t"), 1.0 + F.try_divide(F.col("_t").cast("double"), spread)).otherwise(float("nan")).alias("alpha_hill"),
        (F.col("_s") / (F.col("lambda_max") + 1e-30)).alias("stable_rank"),
        "lambda_max",
        "n_eigs",
        F.lit(float(tail_frac)).alias("tail_frac"),
    )


def activation_spectrum(features: DataFrame, vec: str = "x") -> DataFrame:
    """Eigenvalues of the centred activation covariance, for the activation participation ratio."""
    n, mu = mean_vector(features, vec)
    scatter, _, _ = gram(features, vec, center_left=mu)
    lam = np.linalg.eigvalsh(scatter / n)
    return features.sparkSession.createDataFrame([(float(v),) for v in lam if v > 0], "lam double")


def merge_update(base: DataFrame, left: DataFrame, right: DataFrame, scaling: float, layer: str = "layer") -> DataFrame:
    """Rows of ``W + scaling * B A``: ``left(layer, row_idx, b array)`` holds the rows of B, ``right(layer, r, a array)``
    those of A; products are summed over the rank by an aggregate."""
    b = left.select(layer, "row_idx", F.posexplode("b").alias("r", "_b"))
    terms = b.join(right.select(layer, F.col("r").cast("int").alias("r"), A.as_double("a").alias("a")), [layer, "r"])
    terms = terms.select(layer, "row_idx", A.scale(F.col("a"), F.col("_b") * scaling).alias("w"))
    both = base.select(layer, "row_idx", A.as_double("w").alias("w")).unionByName(terms)
    merged = both.groupBy(layer, "row_idx").agg(Summarizer.metrics("sum").summary(array_to_vector("w")).alias("s"))
    return merged.select(layer, "row_idx", vector_to_array("s.sum").alias("w"))


def update_deltas(base: DataFrame, left: DataFrame, right: DataFrame, scaling: float, tail_frac: float = 0.5) -> DataFrame:
    """Spectral summary of each layer before and after the low-rank update, and the difference."""
    from .metrics import compare_runs

    before = spectral_summary(matrix_eigenvalues(base, ["layer"]), ["layer"], tail_frac)
    merged = merge_update(base, left, right, scaling)
    after = spectral_summary(matrix_eigenvalues(merged, ["layer"]), ["layer"], tail_frac)
    return compare_runs(before, after, ["layer"], ["participation_ratio", "alpha_hill", "stable_rank"])
