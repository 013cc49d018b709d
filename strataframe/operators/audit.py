"""The full audit of a feature table, and a sweep over many."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.sql import DataFrame, Row, functions as F

from ..contracts import ContractError
from . import direction, erasure, pooling, probes, variance
from .report import with_verdict

NAN = float("nan")
#: Characters of a failure's message that a row keeps.
FAILURE_TEXT = 200


@dataclass
class AuditConfig:
    cell_name: str = "cell"
    cell_layout: str | None = None
    n_null_seeds: int = 10
    run_erasure: bool = True
    erasure_gate: float = 0.55
    erasure_seeds: Sequence[int] = (42, 123, 2024)
    erasure_cv: str = "stratified-kfold"
    subject_cap: int | None = None
    mlp: bool = True
    layer_summary: Mapping | None = None
    ablation: Mapping | None = None
    seed: int = 0


def erasure_audit(features: DataFrame, config: AuditConfig | None = None, with_label: bool = True, degenerate_frac: float = 0.95) -> dict:
    """Identity and label probes before and after erasing the linear subject axis, on all rows unless ``subject_cap`` is set.

    The label part needs exactly two labels with at least two recordings each; the difference is paired by seed and
    counts as interpretable when the raw accuracy reaches the gate.
    """
    config = config or AuditConfig()
    whitening = erasure.fit_whitening(features)
    eraser = erasure.fit_eraser(features, whitening)
    erased = erasure.apply_eraser(features, eraser)
    width = len(eraser.mu)
    n_subjects = features.select("subject_id").distinct().count()
    raw = free = delta = np.array([NAN])
    labels = [r[0] for r in features.select("label").distinct().limit(3).collect()] if with_label else []
    recs = features.select("recording_id", "label").distinct().groupBy("label").count()
    probe_label = len(labels) == 2 and recs.agg(F.min("count")).first()[0] >= 2

    def identity(table: DataFrame, kind: str):
        return lambda: probes.subject_probe(table, kind, config.subject_cap)[0]

    def label_scores(table: DataFrame):
        rows = lambda: probes.linear_probe(table, config.erasure_seeds, cv=config.erasure_cv).collect()
        return lambda: {r["seed"]: r["balanced_accuracy"] for r in rows()}

    work = {"before": identity(features, "linear"), "after": identity(erased, "linear")}
    if config.mlp:
        work["mlp"] = identity(erased, "mlp")
    if probe_label:
        work.update(raw=label_scores(features), free=label_scores(erased))
    # the probes are independent jobs: the scheduler interleaves them
    with ThreadPool(len(work)) as threads:
        done = dict(zip(work, threads.map(lambda job: job(), work.values())))
    before, after, mlp = done["before"], done["after"], done.get("mlp")
    if probe_label:
        raw = np.array([done["raw"][k] for k in done["raw"]])
        free = np.array([done["free"][k] for k in done["raw"]])
        delta = free - raw
    gate = bool(raw.mean() >= config.erasure_gate)
    return {
        "erasure_rank_subject_axis": eraser.rank,
        "erasure_degenerate": bool(eraser.rank >= degenerate_frac * width),
        "erasure_cond_shrunk": whitening.cond,
        "erasure_chance": 1.0 / n_subjects,
        "erasure_subj_ba_linear_pre": NAN if before is None else before,
        "erasure_subj_ba_linear_post": NAN if after is None else after,
        "erasure_subj_ba_mlp_post": NAN if mlp is None else mlp,
        "erasure_label_ba_raw": float(raw.mean()),
        "erasure_label_ba_erased": float(free.mean()),
        "erasure_label_ba_delta": float(delta.mean()),
        "erasure_label_ba_raw_std": float(raw.std()),
        "erasure_label_ba_erased_std": float(free.std()),
        "erasure_label_ba_delta_std": float(delta.std()),
        "erasure_gate": config.erasure_gate,
        "erasure_interpretable": gate,
    }


def audit_cell(features: DataFrame, config: AuditConfig | None = None) -> DataFrame:
    """One numeric row: variance shares of recordings, excess over the null of windows, direction consistency (not for
    trait layouts), optional layer and ablation numbers, erasure."""
    config = config or AuditConfig()
    spark = features.sparkSession
    recordings = pooling.mean_pool(features, ["recording_id", "subject_id", "label"])
    ss = variance.crossed_ss(recordings).first()
    null = variance.null_control(features, config.n_null_seeds, config.seed).first()
    row = {
        "cell": config.cell_name,
        "layout": None if config.cell_layout is None else f"({config.cell_layout.replace(',', ', ')})",
        "label_frac": ss["label_frac"],
        "subject_frac": ss["subject_frac"],
        "residual_frac": ss["residual_frac"],
        "null_label_frac_mean": null["null_label_mean"],
        "null_subject_frac_mean": null["null_subject_mean"],
        "excess_label_ratio": null["excess_label"],
        "excess_subject_ratio": null["excess_subject"],
        "c_bar_value": NAN,
        "c_bar_iqr_low": NAN,
        "c_bar_iqr_high": NAN,
        "c_bar_n_subjects_paired": 0,
        "n_subjects": null["n_subjects"],
        "n_recordings": ss["n_rows"],
        "n_windows": null["n_rows"],
    }
    if config.cell_layout is None or not config.cell_layout.startswith("T,"):
        c = direction.direction_consistency(direction.unit_directions(features)).first()
        if np.isfinite(c["c_bar"]):
            row.update(
                c_bar_value=c["c_bar"],
                c_bar_iqr_low=c["iqr_low"],
                c_bar_iqr_high=c["iqr_high"],
                c_bar_n_subjects_paired=c["n_subjects_paired"],
            )
    layer, ablation = config.layer_summary or {}, config.ablation or {}
    for name, key in (("first", "label_ba_first"), ("last", "label_ba_last"), ("max", "label_ba_max")):
        row[f"layer_label_ba_{name}"] = float(layer.get(key, NAN))
    row["layer_argmax_depth"] = float(layer.get("argmax_depth", NAN))
    row["state_drop"] = float(ablation.get("state_drop_mean", NAN))
    row["subject_drop"] = float(ablation.get("subject_drop_mean", NAN))
    row["layer_probe_supplied"] = config.layer_summary is not None
    row["oneoverf_supplied"] = config.ablation is not None
    if config.run_erasure:
        row.update(erasure_audit(features, config))
    row["erasure_supplied"] = config.run_erasure
    return spark.createDataFrame([Row(**{k: v.item() if hasattr(v, "item") else v for k, v in row.items()})], schema=_schema(row))


def _schema(row: Mapping) -> str:
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string", type(None): "string"}
    return ", ".join(f"{k} {kinds[type(v.item() if hasattr(v, 'item') else v)]}" for k, v in row.items())


def sweep(features: DataFrame, dataset: str = "dataset", n_null_seeds: int = 10, seed: int = 0) -> DataFrame:
    """Variance shares, null excess, mean and median direction cosine of every data set in the same jobs: the data set is a
    grouping column. Data sets with fewer than two subjects or labels come out as failed rows."""
    null = variance.null_control(features, n_null_seeds, seed, by=[dataset])
    directions = direction.unit_directions(features, by=[dataset])
    cosine = direction.mean_cosine(directions, by=[dataset])
    median = direction.direction_consistency_by(directions, dataset)
    joined = null.join(cosine.select(dataset, "mean_cosine"), dataset, "left")
    joined = joined.join(median.select(dataset, F.col("c_bar").alias("median_cosine")), dataset, "left").fillna(NAN, ["median_cosine"])
    status = (
        F.when(F.col("n_subjects") < 2, "failed: fewer than two subjects")
        .when(F.col("n_labels") < 2, "failed: fewer than two labels")
        .otherwise("ok")
    )
    return joined.withColumn("mean_cosine", F.coalesce("mean_cosine", F.lit(NAN))).withColumn("status", status)


def sweep_leaderboard(tables: Mapping[str, DataFrame], config: AuditConfig | None = None) -> DataFrame:
    """Full audit rows of several data sets with their verdicts; one that fails, in whatever way,
    becomes a failed row (the message cut at ``FAILURE_TEXT`` characters)."""
    if not tables:
        raise ContractError("no data sets")
    done, spark = None, next(iter(tables.values())).sparkSession
    for name, features in tables.items():
        try:
            row = audit_cell(features, config).withColumn("dataset", F.lit(name)).withColumn("status", F.lit("ok"))
        except Exception as error:  # noqa: BLE001  a failed job of one data set must not end the sweep
            row = spark.createDataFrame([(name, f"failed: {str(error)[:FAILURE_TEXT]}")], "dataset string, status string")
        done = row if done is None else done.unionByName(row, allowMissingColumns=True)
    if "erasure_label_ba_raw" not in done.columns:
        return done
    renamed = (
        done.withColumn("raw_label_ba", F.col("erasure_label_ba_raw"))
        .withColumn("identity_free_label_ba", F.col("erasure_label_ba_erased"))
        .withColumn("erasure_delta", F.col("erasure_label_ba_delta"))
    )
    return with_verdict(renamed)
