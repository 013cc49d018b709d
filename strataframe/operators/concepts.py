"""Univariate concept probes: every feature against every concept of the subjects, as block products.

Subjects are dealt into blocks. A block multiplies its sparse features by the dense table of its subjects' concepts, so
the sums of all concepts of a feature leave it as one array, and counts the classes of the binary concepts for each
distinct score. Scores are then ordered by (feature, score) in ranges of any size; a range's class counts and pair counts
merge with those of the range before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..session import checkpoint
from . import sampling

#: Sides of a split, and the least number of subjects that each must have.
SIDES, LEAST = ("train", "test"), (10, 5)


class _Totals:
    """What is known of the concepts without any feature; arrays over (concept, side)."""

    def __init__(self, rows: list):
        self.names = sorted({(r["kind"], r["concept"]) for r in rows}, key=lambda x: (x[0] != "continuous", x[1]))
        self.n_lines = sum(kind == "continuous" for kind, _ in self.names)
        self.at = {c: i for i, (_, c) in enumerate(self.names)}
        shape = (len(self.names), 2)
        self.n, self.sy, self.syy, self.pos, self.neg = (np.zeros(shape) for _ in range(5))
        self.centre = np.zeros(len(self.names))
        for r in rows:
            i, side = self.at[r["concept"]], SIDES.index(r["split"])
            for field in ("n", "pos", "neg"):
                getattr(self, field)[i, side] = r[field]
            if side == 0:
                self.centre[i] = r["sy"] / r["n"]
        for r in rows:
            i, side = self.at[r["concept"]], SIDES.index(r["split"])
            c, n = self.centre[i], r["n"]
            self.sy[i, side], self.syy[i, side] = r["sy"] - c * n, r["syy"] - 2 * c * r["sy"] + c * c * n


def _block_product(totals: _Totals, latents: pa.Table, concepts: pa.Table) -> pa.Table:
    """Per feature of a block its sums with all concepts, and per distinct score its class counts."""
    lines = totals.n_lines
    kinds = len(totals.names)
    feature = latents.column("feature").combine_chunks().dictionary_encode()
    fi = feature.indices.to_numpy()
    value = latents.column("value").to_numpy()
    subjects = concepts.column("subject_id").combine_chunks().dictionary_encode()
    who = pa.compute.index_in(latents.column("subject_id").combine_chunks(), subjects.dictionary).fill_null(len(subjects.dictionary)).to_numpy()
    inside = np.zeros((len(subjects.dictionary) + 1, kinds, 2))  # the last row is for subjects without concepts
    y = np.zeros_like(inside)
    rows, number, side = subjects.indices.to_numpy(), concepts.column("number").to_numpy(), concepts.column("side").to_numpy()
    inside[rows, number, side] = 1.0
    y[rows, number, side] = concepts.column("y").to_numpy() - np.where(number < lines, totals.centre[number], 0.0)

    order = np.argsort(fi, kind="stable")
    heads = np.flatnonzero(np.diff(fi[order], prepend=-1))
    v, at = value[order, None], who[order]
    member = inside[:, :lines].reshape(len(inside), -1)
    target = y[:, :lines].reshape(len(y), -1)
    sums = [np.add.reduceat(x, heads) for x in (v * member[at], v * v * member[at], v * target[at])] if lines else []
    sums = np.hstack(sums) if sums else np.zeros((len(heads), 0))
    sum_keys = fi[order][heads]

    there = np.flatnonzero((value != 0) & (kinds > lines))
    there = there[np.lexsort((value[there], fi[there]))]
    new = (np.diff(fi[there], prepend=-1) != 0) | (np.diff(value[there], prepend=np.nan) != 0)
    starts = np.flatnonzero(new)
    yes = (inside * (y == 1))[:, lines:].reshape(len(inside), -1)
    no = (inside * (y == 0))[:, lines:].reshape(len(inside), -1)
    counts = np.hstack([yes, no])[who[there]]
    counts = np.add.reduceat(counts, starts) if len(starts) else np.zeros((0, counts.shape[1]))
    score_keys = fi[there][starts]

    keys = np.concatenate([sum_keys, score_keys])
    scores = pa.array(np.concatenate([np.zeros(len(sum_keys)), value[there][starts]]), mask=np.arange(len(keys)) < len(sum_keys))
    return pa.table(
        {
            "feature": feature.dictionary.take(pa.array(keys)),
            "value": scores,
            "sums": pa.concat_arrays([_lists(sums), pa.nulls(len(score_keys), pa.list_(pa.float64()))]),
            "counts": pa.concat_arrays([pa.nulls(len(sum_keys), pa.list_(pa.float64())), _lists(counts)]),
        }
    )


def _lists(matrix: np.ndarray) -> pa.ListArray:
    width = matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * width, pa.int32()), pa.array(matrix.ravel(), pa.float64()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


class _Partial:
    """Sums and class counts of one feature over a range of scores; ``pairs`` counts (positive, lower negative), ties half."""

    FIELDS = ("pos", "neg", "pairs", "above", "below")

    def __init__(self, n_sums: int, n_counts: int):
        self.sums = np.zeros(n_sums)
        self.pos, self.neg, self.pairs, self.above, self.below = (np.zeros(n_counts) for _ in range(5))

    def add_scores(self, value: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        """Counts of different ascending scores, all above those added before."""
        before = self.neg + np.cumsum(neg, axis=0) - neg
        self.pairs += (pos * (before + neg / 2)).sum(axis=0)
        self.pos += pos.sum(axis=0)
        self.neg += neg.sum(axis=0)
        self.above += pos[value > 0].sum(axis=0)
        self.below += neg[value < 0].sum(axis=0)

    def merge(self, later: _Partial) -> None:
        self.sums += later.sums
        self.pairs += later.pairs + later.pos * self.neg
        for field in ("pos", "neg", "above", "below"):
            setattr(self, field, getattr(self, field) + getattr(later, field))

    def packed(self) -> list[float]:
        return np.concatenate([self.sums, *(getattr(self, f) for f in self.FIELDS)]).tolist()

    @classmethod
    def unpacked(cls, packed: np.ndarray, n_sums: int, n_counts: int) -> _Partial:
        out = cls(n_sums, n_counts)
        out.sums = packed[:n_sums].copy()
        for i, field in enumerate(cls.FIELDS):
            setattr(out, field, packed[n_sums + i * n_counts : n_sums + (i + 1) * n_counts].copy())
        return out


def _ranges(n_sums: int, n_counts: int):
    """One row per feature and range, from rows sorted by feature and score (null: sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, partial, held = None, None, None

        def close(done):
            if feature is not None:
                if held is not None:
                    partial.add_scores(held[0], *np.split(held[1], 2, axis=1))
                done.append((feature, partial.packed()))

        def emit(done):
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], kind), pa.array([p for _, p in done], pa.list_(pa.float64()))], ["feature", "partial"])

        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, done = batch.column("feature").type, []
            coded = batch.column("feature").dictionary_encode()
            indices = coded.indices.to_numpy()
            edges = np.append(np.flatnonzero(np.diff(indices, prepend=-1)), len(indices))
            for low, high in zip(edges, edges[1:]):
                own = batch.slice(low, high - low)
                name = coded.dictionary[int(indices[low])].as_py()
                if name != feature:
                    close(done)
                    feature, partial, held = name, _Partial(n_sums, n_counts), None
                summed = own.column("sums").drop_null()
                if len(summed):
                    partial.sums += _matrix(summed, n_sums).sum(axis=0)
                counts = own.column("counts").drop_null()
                if len(counts):
                    value = own.column("value").drop_null().to_numpy()
                    counts = _matrix(counts, 2 * n_counts)
                    if held is not None:
                        value, counts = np.append(held[0], value), np.vstack([held[1], counts])
                    starts = np.flatnonzero(np.diff(value, prepend=np.nan) != 0)
                    value, counts = value[starts], np.add.reduceat(counts, starts)
                    partial.add_scores(value[:-1], *np.split(counts[:-1], 2, axis=1))
                    held = value[-1:], counts[-1:]  # the next batch may go on with this score
            if done:
                yield emit(done)
        last: list = []
        close(last)
        if last:
            yield emit(last)

    return run


def _scores(totals: _Totals, p: _Partial) -> tuple[np.ndarray, np.ndarray]:
    """Train and test scores of a feature with all concepts."""
    lines = totals.n_lines
    out = np.full((len(totals.names), 2), np.nan)
    n, sy, syy = totals.n[:lines], totals.sy[:lines], totals.syy[:lines]
    with np.errstate(divide="ignore", invalid="ignore"):
        sx, sxx, sxy = p.sums.reshape(3, lines, 2)
        m, mean_x, mean_y = n[:, 0], sx[:, 0] / n[:, 0], sy[:, 0] / n[:, 0]
        var = sxx[:, 0] / m - mean_x * mean_x
        flat = var < 1e-12
        slope = np.where(flat, 0.0, (sxy[:, 0] / m - mean_x * mean_y) / np.where(flat, 1.0, var))
        level = mean_y - slope * mean_x
        a, b = slope[:, None], level[:, None]
        residual = syy - 2 * a * sxy - 2 * b * sy + a * a * sxx + 2 * a * b * sx + n * b * b
        out[:lines] = np.where(flat[:, None], 0.0, 1.0 - residual / (syy - sy * sy / n + 1e-12))
        pos, neg = totals.pos[lines:], totals.neg[lines:]
        silent_pos, silent_neg = pos - p.pos.reshape(-1, 2), neg - p.neg.reshape(-1, 2)
        pairs = p.pairs.reshape(-1, 2) + silent_pos * (p.below.reshape(-1, 2) + silent_neg / 2) + silent_neg * p.above.reshape(-1, 2)
        out[lines:] = np.where((pos == 0) | (neg == 0), 0.5, pairs / (pos * neg))
    size = np.vstack([n, pos + neg])
    out[~((size[:, 0] >= LEAST[0]) & (size[:, 1] >= LEAST[1]))] = np.nan
    return out[:, 0], out[:, 1]


def concept_probes(
    latents: DataFrame, concepts: DataFrame, test_frac: float = 0.25, seed: int = 0, features: DataFrame | None = None, blocks: int | None = None
) -> DataFrame:
    """``feature, concept, kind, train_score, test_score`` of every feature against every concept.

    ``latents(subject_id, feature, value)`` may be sparse: absent entries are zeros. ``concepts(subject_id, concept,
    kind, y)`` has one row for a subject and concept at most. Continuous concepts get a least-squares line fitted on
    training subjects and scored by R^2, binary ones the AUC. Scores are NaN below 10 training or 5 test subjects.
    Latents are read once, in ``blocks`` of subjects (by default as many as shuffle partitions). The driver holds five
    numbers for each concept. Features of ``features`` without entries are scored as all zero.
    """
    spark = latents.sparkSession
    split = checkpoint(concepts.join(sampling.subject_split(concepts, test_frac, seed, "subject_id", ["concept"]), ["concept", "subject_id"]))
    y = F.col("y").cast("double")
    rows = split.groupBy("concept", "kind", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"),
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"),
    )
    totals = _Totals(rows.collect())
    out_schema = StructType([*latents.select("feature").schema.fields, *concepts.select("concept", "kind").schema.fields])
    out_schema = out_schema.add("train_score", "double").add("test_score", "double")
    if not totals.names:
        return spark.createDataFrame([], out_schema)
    n_sums, n_counts = 6 * totals.n_lines, 2 * (len(totals.names) - totals.n_lines)
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64("subject_id"), F.lit(blocks)).alias("block")
    number = F.array_position(F.lit([c for _, c in totals.names]), F.col("concept")) - 1
    side = F.array_position(F.lit(list(SIDES)), F.col("split")) - 1
    left = latents.select(block, "subject_id", "feature", F.col("value").cast("double").alias("value"))
    right = split.select(block, "subject_id", number.alias("number"), side.alias("side"), y.alias("y"))
    kind = latents.schema["feature"]
    numbers = ArrayType(DoubleType())
    schema = StructType([kind]).add("value", "double").add("sums", numbers).add("counts", numbers)

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        return _block_product(totals, a, b)

    scored = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(multiply, schema)
    if features is not None:
        absent = features.select(F.col("feature").cast(kind.dataType)).distinct()
        zeros = F.array(*[F.lit(0.0)] * n_sums).cast("array<double>")
        scored = scored.unionByName(absent.select("feature", F.lit(None).cast("double").alias("value"), zeros.alias("sums"), F.lit(None).cast("array<double>").alias("counts")))
    scored = checkpoint(scored)  # ranges take a sample first
    ordered = scored.repartitionByRange("feature", "value").sortWithinPartitions("feature", "value")
    partials = ordered.mapInArrow(_ranges(n_sums, n_counts), StructType([kind]).add("partial", numbers))
    partials = partials.withColumn("part", F.spark_partition_id())
    whole = partials.groupBy("feature").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "partial"))), lambda s: s["partial"]).alias("parts"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train, test = [], []
            for parts in batch.column("parts").to_pylist():
                total = _Partial(n_sums, n_counts)
                for part in parts:
                    total.merge(_Partial.unpacked(np.array(part), n_sums, n_counts))
                a, b = _scores(totals, total)
                train.append(a.tolist())
                test.append(b.tolist())
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("feature"), pa.array(train, lists), pa.array(test, lists)], ["feature", "train", "test"])

    done = whole.mapInArrow(finish, StructType([kind]).add("train", numbers).add("test", numbers))
    each = done.select("feature", F.posexplode(F.arrays_zip("train", "test")).alias("i", "s"))
    named = F.element_at(F.lit([c for _, c in totals.names]), F.col("i") + 1)
    kinds = F.element_at(F.lit([k for k, _ in totals.names]), F.col("i") + 1)
    return each.select("feature", named.alias("concept"), kinds.alias("kind"), F.col("s.train").alias("train_score"), F.col("s.test").alias("test_score"))


def _strength():
    return F.when(F.col("kind") == "binary", F.abs(F.col("test_score") - 0.5)).otherwise(F.col("test_score"))


def selectivity(scores: DataFrame) -> DataFrame:
    """Per feature: best concept, its strength (|AUC - 0.5| or R^2), the runner-up and the gap. NaN scores are ignored.
    Both are picked by one aggregate that keeps the two best concepts."""
    live = scores.where(~F.isnan("test_score")).withColumn("_m", _strength())
    best = F.min_by(F.struct("concept", "_m"), F.struct(-F.col("_m"), "concept"))
    top = live.groupBy("feature").agg(best.alias("_b"), F.sort_array(F.collect_list("_m"), asc=False).alias("_all"))
    off = F.coalesce(F.try_element_at("_all", F.lit(2)), F.lit(float("nan")))
    out = top.select("feature", F.col("_b.concept").alias("target_concept"), F.col("_b._m").alias("target_metric"), off.alias("off_target_max"))
    return out.withColumn("selectivity_gap", F.col("target_metric") - F.col("off_target_max"))


def top_features(scores: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` strongest features of each concept on held-out subjects."""
    live = scores.where(~F.isnan("test_score")).withColumn("metric", _strength())
    ranks = live.withColumn("rank", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("metric"), "feature")))
    return ranks.where(F.col("rank") <= n).select("concept", "rank", "feature", "metric")
