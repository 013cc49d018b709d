"""Grouped vector moments.

``cell_moments`` reads the rows once and leaves one row per cell (count, mean vector, within-cell sums of squares);
large inputs are summed over Arrow batches first.
``pool`` merges cells upwards. Every variance operator works on cells, so the wide rows are shuffled nowhere and a hot
subject or label costs one partial buffer per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import arrays as A


# Above this planner estimate rows are first summed per batch in numpy; below, starting Python workers costs more.
ARROW_BYTES = 256 << 20
# What a task holds of them at once; short vectors reach the rows first, whose keys take many times their bytes.
BUFFER_BYTES, BUFFER_ROWS = 32 << 20, 1 << 16


def cell_moments(df: DataFrame, keys: Sequence[str], vec: str = "x", extra: Sequence[Column] = ()) -> DataFrame:
    """``keys, n, mean, within``: ``within`` is the sum of squares about the cell mean, per dimension."""
    if not extra and planned_bytes(df) > ARROW_BYTES:
        return batch_cell_moments(df, keys, vec)
    summary = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(A.as_double(vec)))
    grouped = df.groupBy(*keys).agg(summary.alias("_m"), *extra)
    kept = [c for c in grouped.columns if c not in (*keys, "_m")]
    n = F.col("_m.count")
    return grouped.select(
        *keys,
        n.alias("n"),
        vector_to_array("_m.mean").alias("mean"),
        F.transform(vector_to_array("_m.variance"), lambda v: v * (n - 1)).alias("within"),
        *kept,
    )


def planned_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def batch_cell_moments(df: DataFrame, keys: Sequence[str], vec: str = "x") -> DataFrame:
    """``cell_moments`` with partial sums over Arrow batches: a task turns each stretch of rows into one partial cell per
    key by sorted segment sums, and the partial cells are pooled. Vectors of unequal width fail."""
    keys = list(keys)
    source = df.select(*keys, A.as_double(vec).alias("_x"))
    schema = T.StructType(
        [
            *source.select(*keys).schema.fields,
            T.StructField("n", T.LongType()),
            T.StructField("mean", T.ArrayType(T.DoubleType())),
            T.StructField("within", T.ArrayType(T.DoubleType())),
        ]
    )

    def cells(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks()
        vectors = whole.column("_x").chunk(0)
        rows = len(vectors)
        x = vectors.flatten().to_numpy(zero_copy_only=False)
        if len(x) % rows or len(np.unique(np.diff(vectors.offsets.to_numpy()))) > 1:
            raise ValueError("vectors of different width")
        x = x.reshape(rows, -1)
        names = whole.select(keys)
        code = names.to_pandas().groupby(keys, sort=False, dropna=False).ngroup().to_numpy() if keys else np.zeros(rows, int)
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        n = np.diff(starts, append=rows)
        x = x[order]
        mean = np.add.reduceat(x, starts, axis=0) / n[:, None]
        x -= np.repeat(mean, n, axis=0)
        within = np.add.reduceat(x * x, starts, axis=0)
        offsets = np.arange(len(n) + 1, dtype=np.int32) * x.shape[1]
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel())) for m in (mean, within)]
        first = names.take(pa.array(order[starts])).combine_chunks()
        columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in first.columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64)), *lists], [*keys, "n", "mean", "within"])

    def partial(batches):
        for held in stretches(batches):
            yield cells(held)

    pooled = pool(source.mapInArrow(partial, schema), keys)
    return pooled.select(*keys, "n", "mean", A.add(F.col("within"), F.col("between")).alias("within"))


def stretches(batches: Iterable[pa.RecordBatch], most_bytes: int = BUFFER_BYTES, most_rows: int = BUFFER_ROWS) -> Iterable[list[pa.RecordBatch]]:
    """Runs of batches up to the bytes or rows given, at least one batch each; empty batches are left out."""
    held, size, rows = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        rows += batch.num_rows
        if size >= most_bytes or rows >= most_rows:
            yield held
            held, size, rows = [], 0, 0
    if held:
        yield held


def pool(cells: DataFrame, keys: Sequence[str], sums: Iterable[str] = ("within",), counts: Iterable[str] = ()) -> DataFrame:
    """Merge cells into ``keys, n, n_cells, mean, between`` plus summed vectors and summed scalars.

    ``between`` is sum n_c (mean_c - mean)^2 per dimension and ``n_cells`` the number of cells merged.
    """
    weight = F.col("n").cast("double")
    aggregates = [
        Summarizer.metrics("mean", "variance").summary(array_to_vector("mean"), weight).alias("_m"),
        F.sum("n").alias("n"),
        F.sum(weight * weight).alias("_n2"),
        F.count(F.lit(1)).alias("n_cells"),
    ]
    sums, counts = list(sums), list(counts)
    aggregates += [Summarizer.metrics("sum").summary(array_to_vector(c)).alias(f"_s_{c}") for c in sums]
    aggregates += [F.sum(c).alias(c) for c in counts]
    merged = cells.groupBy(*keys).agg(*aggregates)
    spread = F.col("n") - F.col("_n2") / F.col("n")
    return merged.select(
        *keys,
        "n",
        "n_cells",
        vector_to_array("_m.mean").alias("mean"),
        F.transform(vector_to_array("_m.variance"), lambda v: v * spread).alias("between"),
        *[vector_to_array(f"_s_{c}.sum").alias(c) for c in sums],
        *counts,
    )


def mean_vector(df: DataFrame, vec: str = "x") -> tuple[int, np.ndarray]:
    """Row count and mean vector on the driver (one vector of the feature width)."""
    row = cell_moments(df, [], vec).first()
    return int(row["n"]), np.asarray(row["mean"], dtype=float)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def gram(
    df: DataFrame,
    left: str = "x",
    right: str | None = None,
    center_left: np.ndarray | None = None,
    center_right: np.ndarray | None = None,
    scale_left: np.ndarray | None = None,
) -> tuple[np.ndarray, int, float]:
    """(sum l r^T, n, sum |l|^4) of centred rows in one pass: matrix products inside tasks, rows of the matrix merged in Spark.

    Only a width x width matrix reaches the driver.
    """
    same = right is None or right == left

    def partial(batches):
        acc, n, quartic = None, 0, 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            l = _stack(pdf[left])
            if center_left is not None:
                l = l - center_left
            if scale_left is not None:
                l = l / scale_left
            if same:
                r = l
            else:
                r = _stack(pdf[right])
                if center_right is not None:
                    r = r - center_right
            product = l.T @ r
            acc = product if acc is None else acc + product
            n += len(l)
            squares = (l * l).sum(axis=1)
            quartic += float((squares * squares).sum())
        if acc is not None:
            yield pd.DataFrame(
                {
                    "i": np.arange(len(acc), dtype="int32"),
                    "g": list(acc),
                    "n": np.where(np.arange(len(acc)) == 0, n, 0),
                    "q": np.where(np.arange(len(acc)) == 0, quartic, 0.0),
                }
            )

    columns = [left] if same else [left, right]
    parts = df.select(*[A.as_double(c).alias(c) for c in columns]).mapInPandas(
        partial, "i int, g array<double>, n long, q double"
    )
    merged = parts.groupBy("i").agg(
        Summarizer.metrics("sum").summary(array_to_vector("g")).alias("s"), F.sum("n").alias("n"), F.sum("q").alias("q")
    )
    rows = merged.select("i", vector_to_array("s.sum").alias("g"), "n", "q").orderBy("i").collect()
    if not rows:
        raise ValueError("no rows to accumulate")
    return np.array([r["g"] for r in rows]), int(sum(r["n"] for r in rows)), float(sum(r["q"] for r in rows))


def attach(df: DataFrame, one_row: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Put the columns of a small summary on every row: one row in all, or one per ``by`` group."""
    if by:
        return df.join(one_row, list(by))
    return df.join(F.broadcast(one_row.limit(1)))
