"""Probes: how well a label, a subject or a concept can be read off features."""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..contracts import ContractError
from ..functions import arrays as A
from ..plans.overlapping import set_moments, set_percentiles, set_sums
from ..session import checkpoint
from . import metrics, sampling

# Seeds of the canonical probe.
SEEDS = (42, 123, 2024)
#: Numbers that one task of a fit reads in each pass (16 MB).
TASK_NUMBERS = 1 << 21
#: The same times the folds fitted at once, as far as there are cores.
STEP_NUMBERS = 1 << 19

# ---- many binary logistic models in one pass per iteration -------------------------------------------------------------


class ModelSet:
    """Scaling and coefficients of a set of binary models, indexed 0 .. m-1."""

    def __init__(self, mu, sd, low, high, weight0, weight1):
        self.mu, self.sd, self.low, self.high = mu, sd, low, high
        self.class_weight = np.stack([weight0, weight1])
        self.coef = np.zeros((len(mu), mu.shape[1] + 1))

    def design(self, x: np.ndarray, m: int) -> np.ndarray:
        clipped = np.clip(x, self.low[m], self.high[m]) if self.low is not None else x
        return np.hstack([(clipped - self.mu[m]) / self.sd[m], np.ones((len(x), 1))])

    def probability(self, x: np.ndarray, m: int) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.design(x, m) @ self.coef[m], -700, 700)))


def fit_binary_models(
    rows: DataFrame,
    n_models: int,
    clip: tuple[float, float] | None = None,
    c: float = 1.0,
    penalise_intercept: bool = False,
    max_iter: int = 50,
    tol: float = 1e-6,
) -> ModelSet:
    """Balanced, ridge-penalised logistic regressions by Newton steps.

    ``rows`` has ``x``, ``y`` (0/1) and ``train``: the array of models a row trains. Every iteration reads the rows once
    for all models together (folds, seeds, depths); tasks return one gradient and Hessian per model, so the driver
    holds n_models x width^2 numbers. Clipping bounds are exact percentiles of each model's training rows, found by
    counting in brackets; standardisation uses population deviations of the (clipped) training rows.
    """
    rows = rows.select(A.as_double("x").alias("x"), F.col("y").cast("int").alias("y"), "train").persist()
    try:
        return _newton(rows, n_models, clip, c, penalise_intercept, max_iter, tol)
    finally:
        rows.unpersist()


def _newton(rows, n_models, clip, c, penalise_intercept, max_iter, tol) -> ModelSet:
    context = rows.sparkSession.sparkContext
    low = high = None
    if clip is not None:
        low, high = set_percentiles(rows, n_models, [p / 100.0 for p in clip])
    bounds = context.broadcast((low, high))

    def clipped(x: np.ndarray, m: int) -> np.ndarray:
        lo, hi = bounds.value
        return x if lo is None else np.clip(x, lo[m], hi[m])

    n, pos, mu, variance = set_moments(rows, n_models, clipped)
    sd = np.sqrt(np.maximum(variance, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        w0, w1 = (np.where(n == 0, 1.0, np.where(k > 0, n / (2.0 * k), 0.0)) for k in (n - pos, pos))
    models = ModelSet(mu, np.where(sd > 1e-12, sd, 1.0), low, high, w0, w1)
    size = mu.shape[1] + 1
    penalty = np.ones(size)
    penalty[-1] = 1.0 if penalise_intercept else 0.0
    previous, step = np.full(n_models, np.inf), np.zeros_like(models.coef)
    for _ in range(max_iter):
        shared = context.broadcast(models)

        def derivatives(x: np.ndarray, t: np.ndarray, m: int) -> np.ndarray:
            ms = shared.value
            d = ms.design(x, m)
            z = np.clip(d @ ms.coef[m], -700, 700)
            p = 1.0 / (1.0 + np.exp(-z))
            w = c * ms.class_weight[t, m]
            loss = (w * (np.logaddexp(0.0, z) - t * z)).sum()
            return np.concatenate([[loss], d.T @ (w * (p - t)), (d.T @ (d * (w * p * (1.0 - p))[:, None])).ravel()])

        moved = 0.0
        for m, s in set_sums(rows, n_models, derivatives).items():
            loss = s[0] + 0.5 * float((penalty * models.coef[m] ** 2).sum())
            if loss > previous[m] * (1.0 + 1e-10) + 1e-12:
                # the last step overshot: go half of the way back
                step[m] /= 2.0
                models.coef[m] -= step[m]
                moved = max(moved, float(np.abs(step[m]).max()))
                continue
            previous[m] = loss
            grad = s[1 : 1 + size] + penalty * models.coef[m]
            hess = s[1 + size :].reshape(size, size) + np.diag(penalty) + 1e-10 * np.eye(size)
            step[m] = -np.linalg.solve(hess, grad)
            models.coef[m] += step[m]
            moved = max(moved, float(np.abs(step[m]).max()))
        if moved < tol:
            break
    return models


def predict_binary_models(rows: DataFrame, models: ModelSet, keep: Sequence[str]) -> DataFrame:
    """``keep, m, prob`` for every model in the ``test`` array of a row."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    keep = list(keep)
    source = rows.select(*keep, A.as_double("x").alias("x"), F.explode(F.col("test").cast("array<bigint>")).alias("m"))
    schema = source.drop("x").schema.add("prob", "double")

    def scan(batches):
        ms = shared.value
        for pdf in batches:
            if len(pdf):
                x, m = np.stack(pdf["x"].to_numpy()), pdf["m"].to_numpy()
                prob = np.zeros(len(pdf))
                for one in np.unique(m):
                    prob[m == one] = ms.probability(x[m == one], one)
                yield pdf[[*keep, "m"]].assign(prob=prob)

    return source.mapInPandas(scan, schema)


def _membership(rows: DataFrame, folds: DataFrame, group: str, k: int, offset_by: str = "job") -> DataFrame:
    """``train`` and ``test`` model lists of each row: model number = job * k + fold."""
    sets = folds.groupBy(group).agg(F.collect_list(F.struct(offset_by, "fold")).alias("_f"))
    joined = rows.join(sets, group)
    test = F.transform("_f", lambda f: f[offset_by] * k + f["fold"])
    train = F.flatten(
        F.transform(
            "_f",
            lambda f: F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i != f["fold"]), lambda i: f[offset_by] * k + i
            ),
        )
    )
    return joined.withColumn("train", train.cast("array<int>")).withColumn("test", test.cast("array<int>")).drop("_f")


# ---- label probe on windows, scored on recordings --------------------------------------------------------------------------


def linear_probe(
    windows: DataFrame,
    seeds: Sequence[int] = SEEDS,
    n_splits: int = 5,
    cv: str = "stratified-kfold",
    recording: str = "recording_id",
    subject: str = "subject_id",
    label: str = "label",
    vec: str = "x",
) -> DataFrame:
    """``seed, balanced_accuracy``: window-level balanced logistic regression on clipped (1-99 %) standardised features,
    window probabilities averaged per recording, threshold 0.5, accuracy over recordings.

    Folds hold out whole subjects; their number drops to the smaller class of recordings. All folds and seeds are
    fitted together. ``cv="loso"`` leaves one subject out.
    """
    recs = windows.groupBy(recording, subject).agg(F.min(label).alias("y"), F.max(label).alias("y2")).persist()
    sizes = {r["y"]: r["n"] for r in recs.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) != 2:
        raise ContractError(f"a binary label is needed, found {sorted(sizes)}")
    one = max(sizes)
    spark = windows.sparkSession
    if cv == "loso":
        ids = recs.select(subject).distinct()
        k = ids.count()
        folds = sampling.shuffled(ids, 0, [subject], "_p").select(subject, (F.col("_p") - 1).cast("int").alias("fold"), F.lit(0).alias("job"))
        jobs = [seeds[0]]
    elif cv == "stratified-kfold":
        k = min(n_splits, min(sizes.values()))
        if k < 2:
            raise ContractError("fewer than two recordings in a class")
        jobs = list(seeds)
        folds = sampling.seeded_group_folds(recs, subject, "y", k, jobs)
    else:
        raise ContractError(f"unknown cv {cv!r}")
    rows = windows.select(recording, subject, F.col(vec).alias("x"), (F.col(label) == one).cast("int").alias("y"))
    rows = _membership(rows, checkpoint(folds), subject, k)
    recs.unpersist()
    models = fit_binary_models(rows, k * len(jobs), clip=(1.0, 99.0), penalise_intercept=True)
    probs = predict_binary_models(rows, models, [recording, "y"])
    pooled = probs.groupBy(F.floor(F.col("m") / k).cast("int").alias("job"), recording).agg(
        F.avg("prob").alias("prob"), F.max("y").alias("y")
    )
    scored = metrics.balanced_accuracy(pooled.withColumn("p", (F.col("prob") >= 0.5).cast("int")), "y", "p", ["job"])
    names = spark.createDataFrame(list(enumerate(jobs)), "job int, seed int")
    return scored.join(F.broadcast(names), "job").select("seed", "balanced_accuracy")


def probe_report(windows: DataFrame, seeds: Sequence[int], **options) -> DataFrame:
    """Spread of ``linear_probe`` over seeds with the size of the cohort beside it."""
    scores = linear_probe(windows, seeds, **options)
    size = windows.agg(
        F.count_distinct("recording_id").alias("n_recordings"),
        F.count_distinct("subject_id").alias("n_subjects"),
        F.count(F.lit(1)).alias("total_windows"),
        F.max(F.size("x")).alias("embed_dim"),
    )
    return metrics.seed_summary(scores, "balanced_accuracy", first=tuple(seeds[:3])).join(F.broadcast(size))


# ---- subject identity --------------------------------------------------------------------------------------------------------


#: Hidden units of the perceptron.
HIDDEN = 64
#: Coefficients that the fits going on at once may have in all (the driver holds about 20 numbers for each).
FITTED = 1 << 22


def _lbfgs(x: np.ndarray, max_iter: int, tol: float, memory: int = 8):
    """Minimum by limited-memory BFGS: yields a point, is sent the loss and gradient there, returns the last point."""
    f, g = yield x
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        d, shares = -g, []
        for s, y, sy in reversed(pairs):
            shares.append((s @ d) / sy)
            d = d - shares[-1] * y
        if pairs:
            s, y, sy = pairs[-1]
            d = d * (sy / (y @ y))
        for (s, y, sy), share in zip(pairs, reversed(shares)):
            d = d + (share - (y @ d) / sy) * s
        slope = g @ d
        if slope >= 0:
            d, slope, pairs = -g, -(g @ g), []
        t = 1.0 if pairs else 1.0 / max(1.0, float(np.sqrt(g @ g)))
        for _ in range(20):
            after, slopes = yield x + t * d
            if after <= f + 1e-4 * t * slope:
                break
            t /= 2.0
        else:
            return x
        s, y = t * d, slopes - g
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y, float(s @ y))]
        gain, x, f, g = f - after, x + s, after, slopes
        if gain <= tol * max(1.0, abs(f)):
            break
    return x


def _lockstep(searches: dict, evaluate) -> dict:
    """Run searches such as ``_lbfgs`` side by side: ``evaluate`` gets the points that all of them ask for at once."""
    asked, found = {m: next(s) for m, s in searches.items()}, {}
    while asked:
        for m, told in evaluate(asked).items():
            try:
                asked[m] = searches[m].send(told)
            except StopIteration as end:
                found[m] = end.value
                del asked[m]
    return found


class _Classes:
    """Multinomial regression or a perceptron of one sigmoid layer as functions of one array of coefficients."""

    def __init__(self, kind: str, width: int, classes: int):
        self.linear, self.width, self.classes = kind == "linear", width, classes
        self.shapes = [(width, classes), (1, classes)]
        if not self.linear:
            self.shapes = [(width, HIDDEN), (1, HIDDEN), (HIDDEN, classes), (1, classes)]
        self.size = sum(r * c for r, c in self.shapes)

    def start(self, seed: int) -> np.ndarray:
        if self.linear:
            return np.zeros(self.size)
        # layers start within 2.4 / inputs of zero, as Spark ML's perceptron does
        rng, inputs = np.random.default_rng(seed), (self.width, self.width, HIDDEN, HIDDEN)
        return np.concatenate([rng.uniform(-2.4 / i, 2.4 / i, r * c) for i, (r, c) in zip(inputs, self.shapes)])

    def layers(self, coef: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([r * c for r, c in self.shapes])[:-1]
        return [part.reshape(shape) for part, shape in zip(np.split(coef, ends), self.shapes)]

    def scores(self, z: np.ndarray, coef: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input of the last layer and its output; classes without training rows cannot win."""
        *hidden, w, b = self.layers(coef)
        top = z if self.linear else 1.0 / (1.0 + np.exp(-np.clip(z @ hidden[0] + hidden[1], -700, 700)))
        return top, np.where(seen, top @ w + b, -np.inf)

    def loss(self, z, code, weight, coef, seen) -> np.ndarray:
        """Weighted loss of the rows, followed by its gradient."""
        top, out = self.scores(z, coef, seen)
        out -= out.max(axis=1, keepdims=True)
        p = np.exp(out)
        total = p.sum(axis=1)
        at = np.arange(len(code)), code
        loss = float((weight * (np.log(total) - out[at])).sum())
        p /= total[:, None]
        p[at] -= 1.0
        p *= weight[:, None]
        parts = [top.T @ p, p.sum(axis=0)]
        if not self.linear:
            back = p @ self.layers(coef)[2].T * top * (1.0 - top)
            parts = [z.T @ back, back.sum(axis=0), *parts]
        return np.concatenate([[loss], *(v.ravel() for v in parts)])


def _packed(rows: DataFrame, n_numbers: int, k: int):
    """The rows as (code, fold, x) arrays, in no more tasks than they are worth: a fit is hundreds of passes."""

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                code, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("code", "fold"))
                step = max(1, TASK_NUMBERS // max(1, x.shape[1]))
                cuts = [slice(i, i + step) for i in range(0, len(x), step)]
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((code[c], fold[c], x[c])) for c in cuts], pa.binary())], ["b"])

    spread = rows.select(F.col("code").cast("int"), F.col("fold").cast("int"), A.as_double("x").alias("x"))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    spread = spread.repartition(max(1, min(cores, -(-n_numbers * k // STEP_NUMBERS)), -(-n_numbers // TASK_NUMBERS)))
    return spread.mapInArrow(pack, "b binary").rdd.map(lambda r: pickle.loads(r["b"])).persist(StorageLevel.MEMORY_AND_DISK)


def _summed(blocks, part) -> dict[int, np.ndarray]:
    """Sums over all blocks of the arrays that ``part(code, fold, x)`` returns by key."""

    def add(a: dict, b: dict) -> dict:
        return {m: a[m] + b[m] if m in a and m in b else a.get(m, b.get(m)) for m in {**a, **b}}

    return blocks.map(lambda block: part(*block)).treeReduce(add)


def crossval_multiclass(rows: DataFrame, k: int, kind: str = "linear", balanced: bool = False, seed: int = 42) -> list[float]:
    """Balanced accuracy of each fold. ``rows``: ``code`` (class number), ``fold``, ``x``. A fold scores only classes its
    training part has seen; a fold without such rows is left out. All folds are fitted together: every step of their
    searches is one pass over the rows, so the number of jobs does not grow with the folds."""
    size = rows.agg(F.max("code").alias("top"), F.max(F.size("x")).alias("width"), F.sum(F.size("x")).alias("n")).first()
    if size["top"] is None:
        return []
    classes, width = int(size["top"]) + 1, int(size["width"])
    blocks = _packed(rows, int(size["n"]), k)
    try:
        return _crossval(blocks, k, _Classes(kind, width, classes), balanced, seed)
    finally:
        blocks.unpersist()


def _crossval(blocks, k: int, net: _Classes, balanced: bool, seed: int) -> list[float]:
    folds = range(k)

    def counted(code, fold, x):
        return {m: np.concatenate([np.bincount(code[fold == m], minlength=net.classes), x[fold == m].sum(axis=0)]) for m in folds}

    held = np.stack([v for _, v in sorted(_summed(blocks, counted).items())])
    inside = held.sum(axis=0) - held
    held, count, mu = held[:, : net.classes], inside[:, : net.classes], inside[:, net.classes :]
    n, seen = count.sum(axis=1), count > 0
    mu = mu / np.maximum(n, 1.0)[:, None]
    squares = _summed(blocks, lambda code, fold, x: {m: ((x[fold != m] - mu[m]) ** 2).sum(axis=0) for m in folds})
    sd = np.sqrt(np.stack([squares[m] for m in folds]) / np.maximum(n, 1.0)[:, None])
    sd = np.where(sd > 1e-12, sd, 1.0)
    weight = np.ones(count.shape)
    if balanced:
        weight = n[:, None] / np.maximum(count, 1.0) / np.maximum(seen.sum(axis=1), 1)[:, None]
    total = (weight * count).sum(axis=1)
    scored = [m for m in folds if n[m] and (held[m] * seen[m]).any()]

    def evaluate(asked: dict) -> dict:
        def part(code, fold, x):
            out = {}
            for m, coef in asked.items():
                pick = fold != m
                out[m] = net.loss((x[pick] - mu[m]) / sd[m], code[pick], weight[m][code[pick]], coef, seen[m])
            return out

        told = {}
        for m, s in _summed(blocks, part).items():
            s = s / total[m]
            if net.linear:
                # unit penalty on the coefficients, none on the intercepts
                penalised = np.where(np.arange(net.size) < net.width * net.classes, asked[m], 0.0) / n[m]
                s[0] += 0.5 * penalised @ asked[m]
                s[1:] += penalised
            told[m] = float(s[0]), s[1:]
        return told

    steps, tol = (100, 1e-6) if net.linear else (200, 1e-6)
    at_once, coefs = max(1, FITTED // net.size), {}
    for i in range(0, len(scored), at_once):
        coefs |= _lockstep({m: _lbfgs(net.start(seed), steps, tol) for m in scored[i : i + at_once]}, evaluate)

    def hits(code, fold, x):
        out = {}
        for m, coef in coefs.items():
            pick = fold == m
            right = net.scores((x[pick] - mu[m]) / sd[m], coef, seen[m])[1].argmax(axis=1) == code[pick]
            out[m] = np.bincount(code[pick][right], minlength=net.classes)
        return out

    found = _summed(blocks, hits) if coefs else {}
    return [float((found[m] / np.maximum(held[m], 1))[(held[m] > 0) & seen[m]].mean()) for m in scored]


def _class_codes(rows: DataFrame, column: str) -> DataFrame:
    from .selecting import encode_labels

    return encode_labels(rows, column, "code")


def subject_probe(
    features: DataFrame,
    kind: str = "linear",
    cap: int | None = None,
    n_splits: int = 5,
    seed: int = 42,
    subject: str = "subject_id",
    row: str = "row_id",
    vec: str = "x",
) -> tuple[float | None, int]:
    """Cross-validated identity probe: balanced accuracy over subjects (None with fewer than two) and their number.

    All rows, or up to ``cap`` per subject; subjects with fewer than ``n_splits`` dropped, rows dealt into stratified folds.
    """
    kept = sampling.cap_per_key(features.select(subject, row, A.as_double(vec).alias("x")), subject, cap, n_splits, seed, [row])
    folded = _class_codes(sampling.stratified_folds(kept, subject, n_splits, seed, [row]), subject).persist()
    try:
        n = folded.select("code").distinct().count()
        if n < 2:
            return None, n
        scores = crossval_multiclass(folded.select("code", "fold", "x"), n_splits, kind, seed=seed)
        return float(np.mean(scores)), n
    finally:
        folded.unpersist()


# ---- per-depth probes ------------------------------------------------------------------------------------------------------------


def label_probe(features: DataFrame, n_folds: int = 3, seed: int = 0, depths: Sequence[int] = (0,), subject: str = "subject_id", label: str = "label") -> dict[int, tuple[float, float]]:
    """Mean and deviation over folds of label balanced accuracy with subjects held out, per depth.

    Two labels: all depths and folds are fitted together. More labels: one multinomial model per fold.
    """
    nan = (float("nan"), float("nan"))
    labels = [r[0] for r in features.select(label).distinct().limit(3).collect()]
    groups = features.select(subject, label).distinct().groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    if len(labels) < 2 or groups is None or groups < n_folds:
        return {d: nan for d in depths}
    one_depth = features.where(F.col("depth") == depths[0]) if "depth" in features.columns else features
    folds = sampling.stratified_group_folds(one_depth, subject, label, n_folds, seed)
    if len(labels) > 2:
        out = {}
        for d in depths:
            rows = features.where(F.col("depth") == d) if "depth" in features.columns else features
            coded = _class_codes(rows.join(folds, subject), label)
            found = crossval_multiclass(coded.select("code", "fold", A.as_double("x").alias("x")), n_folds, balanced=True, seed=seed)
            out[d] = (float(np.mean(found)), float(np.std(found))) if found else nan
        return out
    top = max(labels)
    job = F.array_position(F.lit(list(depths)), F.col("depth")).cast("int") - 1 if "depth" in features.columns else F.lit(0)
    rows = features.select(subject, A.as_double("x").alias("x"), (F.col(label) == top).cast("int").alias("y"), job.alias("j"))
    rows = rows.join(folds, subject)
    number = lambda i: F.col("j") * n_folds + i
    every = F.sequence(F.lit(0), F.lit(n_folds - 1))
    rows = rows.withColumn("test", F.array(number(F.col("fold"))).cast("array<int>")).withColumn(
        "train", F.transform(F.filter(every, lambda i: i != F.col("fold")), number).cast("array<int>")
    )
    models = fit_binary_models(rows, n_folds * len(depths))
    probs = predict_binary_models(rows, models, ["y"]).withColumn("p", (F.col("prob") > 0.5).cast("int"))
    scored = metrics.balanced_accuracy(probs, "y", "p", ["m"]).collect()
    by_depth: dict[int, list[float]] = {d: [] for d in depths}
    for r in scored:
        by_depth[depths[r["m"] // n_folds]].append(r["balanced_accuracy"])
    return {d: ((float(np.mean(v)), float(np.std(v))) if v else nan) for d, v in by_depth.items()}


def reidentification_probe(features: DataFrame, n_folds: int = 3, subject: str = "subject_id", recording: str = "recording_id", seed: int = 0) -> tuple[float, float]:
    """Identity accuracy on held-out recordings of subjects with at least two; NaN with fewer than two such subjects."""
    several = (
        features.groupBy(subject).agg(F.count_distinct(recording).alias("k")).where(F.col("k") >= 2).select(subject)
    )
    kept = features.join(several, subject, "left_semi")
    if several.limit(2).count() < 2:
        return float("nan"), float("nan")
    k = min(n_folds, kept.select(recording).distinct().count())
    folds = sampling.group_folds(kept, recording, k)
    rows = _class_codes(kept.join(folds, recording), subject).select("code", "fold", A.as_double("x").alias("x"))
    found = crossval_multiclass(rows, k, balanced=True, seed=seed)
    return (float(np.mean(found)), float(np.std(found))) if found else (float("nan"), float("nan"))


def layer_probe(features: DataFrame, n_layers: int | None = None, n_folds: int = 3, seed: int = 0) -> DataFrame:
    """``depth, depth_fraction, label_ba, label_ba_std, subject_ba, subject_ba_std`` for features with a ``depth``."""
    depths = sorted(r[0] for r in features.select("depth").distinct().collect())
    total = n_layers or (max(depths) + 1)
    label = label_probe(features, n_folds, seed, depths)
    rows = []
    for d in depths:
        sub = reidentification_probe(features.where(F.col("depth") == d), n_folds, seed=seed)
        rows.append((int(d), (d + 1) / total, *label[d], *sub))
    return features.sparkSession.createDataFrame(
        rows, "depth int, depth_fraction double, label_ba double, label_ba_std double, subject_ba double, subject_ba_std double"
    )


def ablation_role(original: DataFrame, ablated: DataFrame, n_folds: int = 3, seed: int = 0) -> DataFrame:
    """Loss of label and subject accuracy when a spectral component is removed (features of both versions given)."""
    a, b = label_probe(original, n_folds, seed)[0][0], label_probe(ablated, n_folds, seed)[0][0]
    c, d = reidentification_probe(original, n_folds, seed=seed)[0], reidentification_probe(ablated, n_folds, seed=seed)[0]
    return original.sparkSession.createDataFrame(
        [(a - b, c - d, a, b, c, d)],
        "state_drop_mean double, subject_drop_mean double, orig_label_ba double, ablated_label_ba double, "
        "orig_subject_ba double, ablated_subject_ba double",
    )
