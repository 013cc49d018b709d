"""Cohorts: labelled recordings as tables of windows, from trials, traits, stimuli or in-memory tuples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..contracts import ContractError, require_rows
from ..functions import arrays as A
from ..operators import pooling, segment, selecting
from ..plans.ordered import HOT_ROWS


def read_participants(spark: SparkSession, path: str) -> DataFrame:
    """A participants TSV, every column as text, in file order by ``_row``."""
    return (
        spark.read.option("sep", "\t").option("header", True).csv(path).withColumn("_row", F.monotonically_increasing_id())
    )


def participant_labels(spark: SparkSession, path: str, classes: Sequence[str], column: str = "indication") -> DataFrame:
    """``subject_id, label`` for participants whose ``column`` is one of ``classes``; the first session wins."""
    return selecting.trait_labels(read_participants(spark, path), classes, column, ["_row"])


def in_memory_cohort(spark: SparkSession, recordings) -> DataFrame:
    """Windows from ``(subject, label, windows[n, C, T])`` tuples, one recording each. For small inputs and examples;
    large cohorts are read as tables."""
    rows = []
    for rec, (subject, label, windows) in enumerate(recordings):
        for w, window in enumerate(np.asarray(windows, dtype=float)):
            rows.append((int(subject), rec, w, int(label), [[float(v) for v in ch] for ch in window]))
    if not rows:
        raise ContractError("cohort has no windows")
    return spark.createDataFrame(
        rows, "subject_id long, recording_id long, window_idx int, label int, signal array<array<double>>"
    )


def trial_cohort(trials: DataFrame, clamp: float = 15.0, vec: str = "x") -> DataFrame:
    """Windows from trials ``(subject_id, cls, trial, ch, x)``: one recording per subject and class, class index by
    sorted name, each subject's channels scaled by statistics over all of its trials."""
    coded = selecting.encode_labels(trials, "cls", "label")
    scaler = segment.fit_epoch_scaler(coded, ["subject_id", "ch"], vec)
    scaled = segment.apply_epoch_scaler(coded, scaler, ["subject_id", "ch"], vec, clamp)
    return scaled.withColumn("recording_id", F.struct("subject_id", "label"))


def trait_cohort(samples: DataFrame, labels: DataFrame, win: int, channels: Sequence[str] | None = None, max_per_class: int | None = None, clamp: float = 15.0, hot_rows=HOT_ROWS) -> DataFrame:
    """Windows from one resting recording per labelled subject: ``samples(subject_id, ch, sample_idx, v)``.

    Subjects that lack a channel or a full window are not usable; the class cap counts usable subjects only. Each
    recording is scaled by its own statistics. No usable subject at all is an error.
    """
    rows = samples.join(labels, "subject_id")
    if channels is not None:
        wanted = [c.strip().upper() for c in channels]
        rows = rows.where(F.upper(F.trim("ch")).isin(wanted))
        full = rows.groupBy("subject_id").agg(F.count_distinct(F.upper(F.trim("ch"))).alias("_k")).where(F.col("_k") == len(set(wanted)))
        rows = rows.join(full.select("subject_id"), "subject_id", "left_semi")
    windows = segment.fixed_windows(rows, ["subject_id", "label", "ch"], win)
    usable = windows.select("subject_id", "label").distinct()
    if max_per_class is not None:
        from ..operators.sampling import cap_in_order

        usable = cap_in_order(usable, "label", "subject_id", max_per_class, hot_rows)
    require_rows(usable, "no usable recordings")
    kept = windows.join(usable.select("subject_id"), "subject_id", "left_semi")
    scaler = segment.fit_epoch_scaler(kept, ["subject_id", "ch"])
    return segment.apply_epoch_scaler(kept, scaler, ["subject_id", "ch"], clamp=clamp).withColumn("recording_id", F.col("subject_id"))


def stimulus_cohort(epochs: DataFrame, stimuli: DataFrame, label: str = "super_category", check: bool = True, hot_rows=HOT_ROWS) -> DataFrame:
    """One subject's stimulus cohort: the i-th epoch belongs to the i-th kept stimulus row, repeats of an image are
    averaged, the label is the category of the image's first row, signals are z-scored per epoch.

    ``epochs(epoch, ch, x)``, ``stimuli(row, image_path, <label>)``."""
    order = epochs.select("epoch").distinct()
    aligned = selecting.join_positions(order, stimuli, "epoch", "row", check, hot_rows)
    named = epochs.join(aligned.select("epoch", F.col("image_path").alias("image")), "epoch")
    averaged = segment.zscore_arrays(pooling.average_repeats(named))
    first = selecting.first_per_key(stimuli.select("image_path", "row", F.col(label).cast("string").alias("cls")), ["image_path"], ["row"])
    coded = selecting.encode_labels(first.select(F.col("image_path").alias("image"), "cls"), "cls", "label")
    return averaged.join(coded, "image").withColumn("subject_id", F.lit(0).cast("bigint"))


# ---- feature extraction ------------------------------------------------------------------------------------------------------


_EXTRACTORS: dict[str, Callable] = {}


def register_extractor(name: str, make: Callable) -> None:
    """``make()`` returns the function ``(B, C, T) -> (B, D)``; it is called once per task."""
    _EXTRACTORS[name] = make


def get_extractor(name: str) -> Callable:
    if name not in _EXTRACTORS:
        raise ContractError(f"unknown extractor {name!r}; known: {sorted(_EXTRACTORS)}")
    return _EXTRACTORS[name]


def extract_features(windows: DataFrame, extractor: str | Callable, dim: int, batch: int = 16, signal: str = "signal", layers: bool = False) -> DataFrame:
    """Apply a user function to every window in batches: ``x array`` of width ``dim``, or, with ``layers``, one row per
    ``depth`` from a function that returns ``(n_layers, B, D)``. A different width fails."""
    make = get_extractor(extractor) if isinstance(extractor, str) else (lambda: extractor)
    keep = [c for c in windows.columns if c != signal]
    schema = windows.select(*keep).schema
    if layers:
        schema = schema.add("depth", "integer")
    schema = T.StructType([*schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make()
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                block = np.stack([np.stack([np.asarray(c, dtype=float) for c in w]) for w in part[signal]])
                out = np.asarray(fn(block), dtype=float)
                if out.shape[-1] != dim:
                    raise ValueError(f"extractor returned width {out.shape[-1]}, expected {dim}")
                rest = part[keep].reset_index(drop=True)
                if layers:
                    for d, layer in enumerate(out):
                        yield rest.assign(depth=d, x=list(layer))
                else:
                    yield rest.assign(x=list(out))

    return windows.mapInPandas(scan, schema)


def register_layered_extractor(spark: SparkSession, name: str, extractor: str | Callable, dim: int, batch: int = 16, signal: str = "signal") -> None:
    """Make a layered extractor callable from SQL: ``SELECT * FROM name(TABLE(windows) PARTITION BY recording_id)``.

    The result has the table's columns without ``signal``, then ``depth`` and ``x``; its schema is worked out from the
    table when the query is analysed. A partition is fed to the function ``batch`` windows at a time, so it may be of any
    size. A table without ``signal`` is refused before anything runs.
    """
    make = get_extractor(extractor) if isinstance(extractor, str) else (lambda: extractor)

    class Layered:
        def __init__(self):
            self.fn, self.held = None, []

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable or signal not in table.dataType.fieldNames():
                raise ContractError(f"{name} takes a table with a column {signal!r}")
            kept = [f for f in table.dataType.fields if f.name != signal]
            return AnalyzeResult(T.StructType([*kept, T.StructField("depth", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))]))

        def _flush(self) -> Iterator[tuple]:
            if self.held:
                self.fn = self.fn or make()
                out = np.asarray(self.fn(np.stack([np.asarray(s, dtype=float) for _, s in self.held])), dtype=float)
                if out.shape[-1] != dim:
                    raise ValueError(f"extractor returned width {out.shape[-1]}, expected {dim}")
                for i, (kept, _) in enumerate(self.held):
                    for depth, layer in enumerate(out):
                        yield (*kept, depth, layer[i].tolist())
                self.held = []

        def eval(self, row: Row) -> Iterator[tuple]:
            fields = row.asDict()
            self.held.append((tuple(v for k, v in fields.items() if k != signal), fields[signal]))
            if len(self.held) >= batch:
                yield from self._flush()

        def terminate(self) -> Iterator[tuple]:
            yield from self._flush()

    spark.udtf.register(name, F.udtf(Layered))


def feature_table(extracted: DataFrame) -> DataFrame:
    """Extracted windows as features with a row id, the 64-bit digest of recording (of any type) and window."""
    return extracted.withColumn("row_id", F.xxhash64("recording_id", "window_idx"))


def channel_windows_to_signal(windows: DataFrame, keys: Sequence[str], order: str = "ch", vec: str = "x") -> DataFrame:
    """Channel rows of a window gathered into one ``signal`` (channels x samples), channels by name."""
    packed = windows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, vec))).alias("_s"))
    return packed.select(*keys, F.transform("_s", lambda s: A.as_double(s[vec])).alias("signal"))
