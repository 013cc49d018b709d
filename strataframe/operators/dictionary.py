"""Sparse dictionaries: top-k encoding, reconstruction, health and liveness.

A dictionary is a model of fixed size: ``atoms(feature, enc array, enc_bias, dec array)`` and a decoder bias. It goes
to every task behind a size check; activations stay distributed and latents are emitted sparse.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..contracts import ContractError
from ..functions import arrays as A
from ..plans.moments import pool

DICTIONARY_LIMIT = 1 << 30


@dataclass
class Dictionary:
    features: np.ndarray
    enc: np.ndarray
    enc_bias: np.ndarray
    dec: np.ndarray
    dec_bias: np.ndarray

    def pre(self, x: np.ndarray) -> np.ndarray:
        return (x - self.dec_bias) @ self.enc.T + self.enc_bias

    def code(self, pre: np.ndarray, k: int) -> np.ndarray:
        return sparsify(np.maximum(pre, 0.0), k)

    def decode(self, z: np.ndarray) -> np.ndarray:
        return z @ self.dec + self.dec_bias


def sparsify(z: np.ndarray, k: int) -> np.ndarray:
    """Keep the ``k`` largest signed entries of each row, the lower index on ties; k <= 0 clears, k >= width keeps all."""
    if k <= 0:
        return np.zeros_like(z)
    if k >= z.shape[-1]:
        return z
    order = np.argsort(-z, axis=-1, kind="stable")[..., :k]
    out = np.zeros_like(z)
    np.put_along_axis(out, order, np.take_along_axis(z, order, axis=-1), axis=-1)
    return out


def load_dictionary(atoms: DataFrame, dec_bias: Sequence[float] | None = None, limit: int = DICTIONARY_LIMIT) -> Dictionary:
    """Atoms in feature order; a table beyond ``limit`` bytes is refused, as it is not a dictionary."""
    width = int(atoms.select(F.size("enc")).first()[0])
    cap = max(1, limit // (16 * width + 16))
    if atoms.limit(cap + 1).count() > cap:
        raise ContractError(f"dictionary exceeds {limit} bytes")
    rows = atoms.select("feature", A.as_double("enc").alias("enc"), "enc_bias", A.as_double("dec").alias("dec")).orderBy("feature").collect()
    bias = np.zeros(width) if dec_bias is None else np.asarray(dec_bias, dtype=float)
    return Dictionary(
        np.array([r["feature"] for r in rows]),
        np.array([r["enc"] for r in rows]),
        np.array([float(r["enc_bias"]) for r in rows]),
        np.array([r["dec"] for r in rows]),
        bias,
    )


def topk_arrays(df: DataFrame, k: int, vec: str = "x") -> DataFrame:
    """``sparsify`` on an array column inside the JVM: the k-th largest value and its index decide each entry."""
    if k <= 0:
        return df.withColumn(vec, F.transform(vec, lambda v: F.lit(0.0)))
    order = F.array_sort(F.transform(vec, lambda v, i: F.struct((-v).alias("s"), i.alias("i"))))
    edge = A.let(order, lambda o: F.element_at(o, F.least(F.lit(k), F.size(o)).cast("int")))
    keep = A.let(
        edge,
        lambda e: F.transform(
            vec, lambda v, i: F.when(F.struct((-v).alias("s"), i.alias("i")) <= e, v.cast("double")).otherwise(0.0)
        ),
    )
    return df.withColumn(vec, keep)


def encode(acts: DataFrame, dictionary: Dictionary, k: int, row: str = "row_id", vec: str = "x", keep: Sequence[str] = ()) -> DataFrame:
    """``row, feature, value``: the active latents of each row."""
    shared = acts.sparkSession.sparkContext.broadcast(dictionary)
    keep = list(keep)
    source = acts.select(row, *keep, A.as_double(vec).alias("_x"))
    schema = source.drop("_x").schema.add("feature", "long").add("value", "double")

    def scan(batches):
        d = shared.value
        for pdf in batches:
            for start in range(0, len(pdf), 1024):
                part = pdf.iloc[start : start + 1024]
                z = d.code(d.pre(np.stack(part["_x"].to_numpy())), k)
                i, j = np.nonzero(z > 0)
                out = part[[row, *keep]].iloc[i].reset_index(drop=True)
                yield out.assign(feature=d.features[j], value=z[i, j])

    return source.mapInPandas(scan, schema)


def reconstruct(acts: DataFrame, dictionary: Dictionary, k: int, vec: str = "x", out: str = "x_hat") -> DataFrame:
    """Decoded activations beside the originals."""
    shared = acts.sparkSession.sparkContext.broadcast(dictionary)

    @F.pandas_udf("array<double>")
    def forward(x: pd.Series) -> pd.Series:
        d = shared.value
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(d.decode(d.code(d.pre(np.stack(x.to_numpy())), k))))

    return acts.withColumn(out, forward(A.as_double(vec)))


def _fire_table(acts: DataFrame, dictionary: Dictionary, k: int, vec: str, dead: np.ndarray | None, aux_k: int) -> DataFrame:
    """Per task: mean and sum of squares of inputs, errors and auxiliary errors, firing counts, rows and active latents."""
    shared = acts.sparkSession.sparkContext.broadcast((dictionary, dead))

    def scan(batches):
        d, asleep = shared.value
        n, rows, l0 = 0, 0, 0
        mean, within = np.zeros(3), np.zeros(3)
        fires = np.zeros(len(d.features))
        for pdf in batches:
            for start in range(0, len(pdf), 1024):
                x = np.stack(pdf["_x"].iloc[start : start + 1024].to_numpy())
                pre = d.pre(x)
                z = d.code(pre, k)
                err = x - d.decode(z)
                aux = np.zeros_like(err)
                if asleep is not None:
                    woken = np.maximum(sparsify(np.where(asleep, pre, -np.inf), aux_k), 0.0)
                    aux = err - woken @ d.dec
                m, size = np.array([x.mean(), err.mean(), aux.mean()]), x.size
                w = np.array([((v - c) ** 2).sum() for v, c in zip((x, err, aux), m)])
                delta, total = m - mean, n + size
                within += w + delta**2 * n * size / total
                mean += delta * size / total
                n = total
                fires += (z > 0).sum(axis=0)
                l0 += int((z > 0).sum())
                rows += len(x)
        if rows:
            yield pd.DataFrame(
                {"n": [n], "mean": [mean], "within": [within], "fires": [fires], "rows": [rows], "l0": [l0]}
            )

    schema = "n long, mean array<double>, within array<double>, fires array<double>, rows long, l0 long"
    return acts.select(A.as_double(vec).alias("_x")).mapInPandas(scan, schema)


def _health_row(acts, dictionary, k, vec, dead, aux_k) -> DataFrame:
    merged = pool(_fire_table(acts, dictionary, k, vec, dead, aux_k), [], sums=["within", "fires"], counts=["rows", "l0"])
    return merged.withColumn("ss", A.add(F.col("within"), F.col("between")))


def dictionary_health(acts: DataFrame, dictionary: Dictionary, k: int, dead_threshold: int = 0, vec: str = "x") -> DataFrame:
    """Dead share, densities, active latents per row, reconstruction error and explained variance, in one pass. Features
    that never fire are counted: the firing counts cover the whole dictionary."""
    row = _health_row(acts, dictionary, k, vec, None, 0)
    mse = (F.col("ss")[1] + F.col("n") * F.col("mean")[1] * F.col("mean")[1]) / F.col("n")
    density = F.transform("fires", lambda f: f / F.col("rows"))
    return row.select(
        (F.size(F.filter("fires", lambda f: f <= dead_threshold)) / F.size("fires")).alias("dead_fraction"),
        A.mean(density).alias("mean_density"),
        F.array_max(density).alias("max_density"),
        (F.col("l0") / F.col("rows")).alias("l0_actual"),
        mse.alias("recon_mse"),
        (1.0 - (F.col("ss")[1] / F.col("n")) / (F.col("ss")[0] / F.col("n") + 1e-12)).alias("explained_var"),
    )


def auxiliary_loss(acts: DataFrame, dictionary: Dictionary, k: int, aux_k: int, dead: Sequence[bool], aux_coef: float = 1.0 / 32.0, vec: str = "x") -> DataFrame:
    """Main error, and how much of the residual the strongest ``aux_k`` dead features (by raw projection) would explain."""
    row = _health_row(acts, dictionary, k, vec, np.asarray(dead, dtype=bool), aux_k)
    mse = lambda i: (F.col("ss")[i] + F.col("n") * F.col("mean")[i] * F.col("mean")[i]) / F.col("n")
    return row.select(mse(1).alias("main_mse"), mse(2).alias("aux_mse"), (mse(1) + aux_coef * mse(2)).alias("total_loss"))


def firing_counts(latents: DataFrame, atoms: DataFrame, n_rows: int) -> DataFrame:
    """Firing count and density of every feature of the dictionary, zeros included."""
    counts = latents.groupBy("feature").agg(F.count(F.lit(1)).alias("_c"))
    joined = atoms.select(F.col("feature").cast("bigint").alias("feature")).join(counts, "feature", "left")
    n = F.coalesce("_c", F.lit(0))
    return joined.select("feature", n.alias("fire_count"), (n / F.lit(float(n_rows))).alias("density"))


def feature_liveness(firings: DataFrame, atoms: DataFrame, current_step: int, n_steps: int = 200) -> DataFrame:
    """Last step each feature fired (0 for never) and whether it is dead at ``current_step``."""
    last = firings.groupBy("feature").agg(F.max("step").alias("_l"))
    joined = atoms.select(F.col("feature").cast("bigint").alias("feature")).join(last, "feature", "left")
    step = F.coalesce("_l", F.lit(0))
    return joined.select("feature", step.alias("last_fired_step"), (F.lit(current_step) - step > n_steps).alias("dead"))
