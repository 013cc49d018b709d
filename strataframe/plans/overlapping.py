"""Statistics of many overlapping sets of rows at once: moments and exact percentiles of every dimension of a vector.

A row says in ``train`` which sets it belongs to. Each task reduces its rows to arrays for each set, which are merged
by sums, minima and maxima; vectors are never taken apart into rows of scalars, and no set is copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

#: Brackets of a dimension, and numbers that a task holds for all of them.
BRACKETS, HELD = 128, 1 << 21
#: Numbers in one merged array.
STACK = 4096


def unpack(batch: pa.RecordBatch, n_sets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, labels and set membership of the rows (x, y, train) of a batch."""
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    train = batch.column("train")
    member = np.zeros((n, n_sets), bool)
    sizes = np.diff(train.offsets.to_numpy())
    member[np.repeat(np.arange(n), sizes), train.flatten().to_numpy(zero_copy_only=False)] = True
    return x, batch.column("y").to_numpy(zero_copy_only=False), member


def set_sums(rows: DataFrame, n_sets: int, part: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> dict[int, np.ndarray]:
    """Sum of ``part(x, y, set)`` over all rows of each set; the driver gets one array for each set."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x, y, member = unpack(batch, n_sets)
                for m in np.flatnonzero(member.any(axis=0)).tolist():
                    pick = member[:, m]
                    found = part(x[pick], y[pick], m)
                    acc[m] = acc[m] + found if m in acc else found
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int64()), pa.array([v.tolist() for v in acc.values()], pa.list_(pa.float64()))], ["m", "s"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            for m, found in zip(batch.column("m").to_pylist(), batch.column("s")):
                found = found.values.to_numpy()
                acc[m] = acc[m] + found if m in acc else found
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int64()), pa.array([v.tolist() for v in acc.values()], pa.list_(pa.float64()))], ["m", "s"])

    # Plain sums: Summarizer's are a running mean times a count, which loses the last digit of counts.
    summed = rows.mapInArrow(partial, "m long, s array<double>").repartition("m").mapInArrow(merged, "m long, s array<double>")
    return {r["m"]: np.array(r["s"]) for r in summed.collect()}


def set_moments(rows: DataFrame, n_sets: int, shape: Callable[[np.ndarray, int], np.ndarray]) -> tuple[np.ndarray, ...]:
    """Rows, positive labels, mean and population variance of ``shape(x, set)`` in each set."""
    first = set_sums(rows, n_sets, lambda x, y, m: np.concatenate([[len(x), y.sum()], shape(x, m).sum(axis=0)]))
    width = len(next(iter(first.values()))) - 2
    n, pos, mean, variance = np.zeros(n_sets), np.zeros(n_sets), np.zeros((n_sets, width)), np.zeros((n_sets, width))
    for m, s in first.items():
        n[m], pos[m], mean[m] = s[0], s[1], s[2:] / s[0]
    centre = rows.sparkSession.sparkContext.broadcast(mean)
    second = set_sums(rows, n_sets, lambda x, y, m: ((shape(x, m) - centre.value[m]) ** 2).sum(axis=0))
    for m, s in second.items():
        variance[m] = s / n[m]
    return n, pos, mean, variance


def _stack_dims(width: int, brackets: int) -> int:
    return min(width, max(1, STACK // brackets))


def _stacks(flat: np.ndarray, slots: int, width: int, brackets: int, fill: float) -> np.ndarray:
    """(slot, dimension, bracket) as rows of a few dimensions each, the last ones of a slot filled up."""
    dims = _stack_dims(width, brackets)
    whole = np.full((slots, -(-width // dims) * dims, brackets), fill)
    whole[:, :width] = flat.reshape(slots, width, brackets)
    return whole.reshape(-1, dims * brackets)


def _bracket_counts(low: np.ndarray, high: np.ndarray, of_set: np.ndarray, n_sets: int, brackets: int):
    """Per slot and dimension: how many values each bracket of [low, high] holds, the least and the largest of them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, width = low.shape
        counts = np.zeros(slots * width * brackets)
        least, most = np.full(counts.shape, np.inf), np.full(counts.shape, -np.inf)
        open_dims = np.isfinite(low) | np.isfinite(high) | (low < high)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, _, member = unpack(batch, n_sets)
            order = np.argsort(x, axis=0)
            value, row = np.take_along_axis(x, order, 0).T.ravel(), order.T.ravel()
            dim = np.repeat(np.arange(width), len(x))
            for s in range(slots):
                lo, hi = low[s], high[s]
                if not open_dims[s].any():
                    continue
                keep = member[row, of_set[s]] & (value >= lo[dim]) & (value <= hi[dim])
                v, d = value[keep], dim[keep]
                if not len(v):
                    continue
                if brackets > 1:
                    span = np.where(hi > lo, hi - lo, 1.0)
                    place = np.minimum(((v - lo[d]) / span[d] * brackets).astype(np.int64), brackets - 1)
                    at = (s * width + d) * brackets + place
                else:
                    at = s * width + d
                heads = np.flatnonzero(np.diff(at, prepend=-1))
                ends = np.append(heads[1:], len(at)) - 1
                at = at[heads]
                counts[at] += ends - heads + 1
                least[at] = np.minimum(least[at], v[heads])
                most[at] = np.maximum(most[at], v[ends])
        if counts.any():
            stacks = [_stacks(a, slots, width, brackets, fill) for a, fill in ((counts, 0.0), (least, np.inf), (most, -np.inf))]
            used = np.flatnonzero(stacks[0].any(axis=1))
            length = stacks[0].shape[1]
            offsets = pa.array(np.arange(len(used) + 1) * length, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(a[used].ravel())) for a in stacks]
            yield pa.RecordBatch.from_arrays([pa.array(used), *lists], ["stack", "counts", "least", "most"])

    return partial


def _narrowed(rank: np.ndarray, brackets: int):
    """From merged brackets and the rank (slot, dimension) wanted in each: the values of that rank and the next, or where
    to look on."""
    width = rank.shape[1]
    dims = _stack_dims(width, brackets)
    per_slot = -(-width // dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stack, *arrays in zip(*(batch.column(c).to_pylist() for c in ("stack", "counts", "least", "most"))):
                slot, first = stack // per_slot, stack % per_slot * dims
                for dim, c, least, most in zip(range(first, width), *(np.array(a).reshape(dims, brackets) for a in arrays)):
                    if not c.any():
                        continue
                    r = int(rank[slot, dim])
                    upto = np.cumsum(c)
                    j = int(np.searchsorted(upto, r, "right"))
                    r -= int(upto[j] - c[j])
                    lo, hi = float(least[j]), float(most[j])
                    if lo == hi and r + 1 < c[j]:
                        out.append((slot, dim, 0, lo, lo))
                    elif r + 1 == c[j]:
                        later = np.flatnonzero(c[j + 1 :])
                        out.append((slot, dim, 0, hi, float(least[j + 1 + later[0]]) if len(later) else hi))
                    elif c[j] == 2:
                        out.append((slot, dim, 0, lo, hi))
                    else:
                        out.append((slot, dim, 1 + r, lo, hi))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["slot", "dim", "go_on", "a", "b"])

    return run


def set_percentiles(rows: DataFrame, n_sets: int, probs: Sequence[float], held: int = HELD) -> np.ndarray:
    """Exact, linearly interpolated percentiles of every dimension in each set, shaped (probability, set, dimension).

    Each pass over the rows counts the values of an interval in brackets and keeps the bracket with the wanted rank, so
    the number of passes grows with the logarithm of the rows. The driver holds a few numbers for each probability, set
    and dimension. Sets without rows get zeros.
    """
    probs = np.asarray(probs, float)
    width = int(rows.select(F.size("x").alias("n")).first()["n"])

    def measured(low: np.ndarray, high: np.ndarray, of_set: np.ndarray, brackets: int) -> DataFrame:
        parts = rows.mapInArrow(_bracket_counts(low, high, of_set, n_sets, brackets), "stack long, counts array<double>, least array<double>, most array<double>")
        pick = lambda how, c: vector_to_array(Summarizer.metrics(how).summary(array_to_vector(c))[how]).alias(c)
        return parts.groupBy("stack").agg(pick("sum", "counts"), pick("min", "least"), pick("max", "most"))

    bound = np.full((n_sets, width), np.inf)
    size, least, most = np.zeros((n_sets, width)), np.zeros((n_sets, width)), np.zeros((n_sets, width))
    dims = _stack_dims(width, 1)
    for r in measured(-bound, bound, np.arange(n_sets), 1).collect():
        slot, first = divmod(r["stack"], -(-width // dims))
        at = slot, slice(first * dims, min(width, (first + 1) * dims))
        for into, name in ((size, "counts"), (least, "least"), (most, "most")):
            into[at] = r[name][: len(into[at])]
    position = probs[:, None, None] * np.maximum(size - 1, 0)
    slots = len(probs) * n_sets
    low, high = (np.broadcast_to(a, position.shape).reshape(slots, width).copy() for a in (least, most))
    rank = np.floor(position).astype(np.int64).reshape(slots, width)
    a, b = low.copy(), low.copy()
    waiting = (np.broadcast_to(size, position.shape).reshape(slots, width) > 1) & (low < high)
    of_set = np.tile(np.arange(n_sets), len(probs))
    while waiting.any():
        some = np.flatnonzero(waiting.any(axis=1))
        brackets = int(np.clip(held // (3 * len(some) * width), 2, BRACKETS))
        ask_low, ask_high = np.where(waiting[some], low[some], np.inf), np.where(waiting[some], high[some], -np.inf)
        found = measured(ask_low, ask_high, of_set[some], brackets).mapInArrow(_narrowed(rank[some], brackets), "slot long, dim long, go_on long, a double, b double")
        for r in found.collect():
            at = some[r["slot"]], r["dim"]
            if r["go_on"]:
                rank[at], low[at], high[at] = r["go_on"] - 1, r["a"], r["b"]
            else:
                a[at], b[at], waiting[at] = r["a"], r["b"], False
    share = (position - np.floor(position)).reshape(slots, width)
    return (a + (b - a) * share).reshape(position.shape)
