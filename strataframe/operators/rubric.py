"""Decision rules over diagnostic numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Thresholds:
    """Cut-offs of the signs and roles."""

    delta_label_positive: float = 0.005
    layer_label_above_chance: float = 0.60
    layer_label_below_chance: float = 0.45
    layer_early_fraction: float = 0.35
    layer_early_drop_min: float = 0.04
    c_bar_positive: float = 0.05
    state_drop_threshold: float = 0.03
    subject_drop_threshold: float = 0.05


DEFAULT = Thresholds()

# Outcome by layout, with the signs each outcome asks for (change of label share, layer sign, direction).
OUTCOMES = {
    "W,C": ("Cross-subject-aligned", "+", "+", ("+",)),
    "T,C": ("Label-subject coupled", "+", "+", ("+", "-", "0")),
    "W,N": ("Idiosyncratic within-subject", "-", "-", ("-", "0")),
    "T,N": ("Below linear-probe resolution", "-", "-", ("+", "-", "0")),
}


def positive_sign(value: Column, threshold: float) -> Column:
    """``+`` at or above the threshold, else ``-``; a missing mean is ``-``."""
    return F.when(value >= threshold, "+").otherwise("-")


def layer_sign(first: Column, last: Column, best: Column, depth: Column, t: Thresholds = DEFAULT) -> Column:
    """Sign of the depth profile with its ``early`` or ``deep`` qualifier."""
    early = (depth <= t.layer_early_fraction) & (best - last >= t.layer_early_drop_min)
    above = F.when(early, "+ early").otherwise("+")
    below = F.when(last <= t.layer_label_below_chance, "- deep").otherwise("-")
    return F.when(best >= t.layer_label_above_chance, above).otherwise(below)


def layer_flags(last: Column, best: Column, depth: Column) -> Column:
    """The leaderboard's variant: any of ``+early`` and ``-deep``, comma separated, NaN counting for neither."""
    t = DEFAULT
    known = ~F.isnan(best) & ~F.isnan(last) & ~F.isnan(depth)
    early = known & (depth <= t.layer_early_fraction) & (best - last >= t.layer_early_drop_min)
    deep = ~F.isnan(last) & (last <= t.layer_label_below_chance)
    return F.concat_ws(",", F.when(early, "+early"), F.when(deep, "-deep"))


def spectral_role(state_drop: Column, subject_drop: Column, within_subject: Column, t: Thresholds = DEFAULT) -> Column:
    """What the 1/f component carries: one role per cell."""
    confound = (subject_drop > t.subject_drop_threshold) & within_subject
    return F.when(state_drop > t.state_drop_threshold, "state signal").when(confound, "subject confound").otherwise("subject axis")


def spectral_roles(state_drop: Column, subject_drop: Column) -> Column:
    """The leaderboard's variant: every role that applies, semicolon separated."""
    t = DEFAULT
    subject = ~F.isnan(subject_drop) & (subject_drop > t.subject_drop_threshold)
    state = ~F.isnan(state_drop) & (state_drop > t.state_drop_threshold)
    return F.concat_ws(";", F.when(subject, "subject confound"), F.when(state, "state signal"))


def outcome(layout: Column, delta_sign: Column, layer: Column, direction: Column) -> Column:
    """Outcome of a cell from its layout and signs, ``Uncategorized`` when they do not fit the layout's pattern."""
    base = F.split(layer, " ")[0]
    out = None
    for name, (label, delta, depth, directions) in OUTCOMES.items():
        fits = (layout == name) & (delta_sign == delta) & (base == depth) & direction.isin(*directions)
        out = F.when(fits, label) if out is None else out.when(fits, label)
    return out.otherwise("Uncategorized")


def leaderboard_verdict(label_frac: Column, subject_frac: Column, raw_ba: Column, free_ba: Column) -> Column:
    """``TRAP`` when identity outweighs the label and removing it does not hurt; NaN anywhere is ``n/a``."""
    missing = F.lit(False)
    for c in (label_frac, subject_frac, raw_ba, free_ba):
        missing = missing | F.isnan(c) | c.isNull()
    heavy = subject_frac > label_frac
    return (
        F.when(missing, "n/a")
        .when(heavy & (free_ba >= raw_ba - 1e-9), "TRAP")
        .when(heavy, "identity-reliant")
        .otherwise("task-carried")
    )


def verdict_matrix(signals: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """One row per cell from one row per (cell, model): means over models, signs, role, outcome, and for each diagnostic
    how many models agree with the cell.

    ``signals(cell, layout, model, delta_label, ba_first, ba_last, ba_max, ba_depth, c_bar, state_drop, subject_drop)``;
    a diagnostic a model lacks is NULL. Trait layouts report direction ``0``.
    """
    trait = F.startswith("layout", F.lit("T,"))
    within = F.startswith("layout", F.lit("W,"))
    cell = signals.groupBy("cell", "layout").agg(
        F.avg("delta_label").alias("delta_label_value"),
        F.avg("ba_first").alias("ba_first"),
        F.avg("ba_last").alias("layer_last_ba"),
        F.avg("ba_max").alias("layer_max_ba"),
        F.avg("ba_depth").alias("layer_argmax_depth"),
        F.avg("c_bar").alias("_c_bar"),
        F.avg("state_drop").alias("state_drop"),
        F.avg("subject_drop").alias("subject_drop"),
    )
    lay = F.when(
        F.col("layer_max_ba").isNotNull(),
        layer_sign(F.col("ba_first"), F.col("layer_last_ba"), F.col("layer_max_ba"), F.col("layer_argmax_depth"), t),
    ).otherwise("0")
    cell = cell.select(
        "*",
        positive_sign(F.col("delta_label_value"), t.delta_label_positive).alias("delta_label_sign"),
        lay.alias("layer_probe"),
        F.when(trait, "0")
        .when(F.col("_c_bar").isNull(), "0")
        .otherwise(positive_sign(F.col("_c_bar"), t.c_bar_positive))
        .alias("c_bar"),
        spectral_role(F.col("state_drop"), F.col("subject_drop"), within, t).alias("spectral_role"),
    )
    signs = cell.select("cell", "delta_label_sign", "layer_probe", F.col("c_bar").alias("c_bar_sign"), "spectral_role")
    signed = signals.join(signs, "cell")
    base = lambda c: F.split(c, " ")[0]
    one_layer = layer_sign(F.col("ba_first"), F.col("ba_last"), F.col("ba_max"), F.col("ba_depth"), t)
    one_role = spectral_role(F.col("state_drop"), F.col("subject_drop"), within, t)
    has_c = F.col("c_bar").isNotNull()
    agree = signed.groupBy("cell").agg(
        F.count_if(positive_sign(F.col("delta_label"), t.delta_label_positive).eqNullSafe(F.col("delta_label_sign")) & F.col("delta_label").isNotNull()).alias("delta_agree"),
        F.count("delta_label").alias("delta_total"),
        F.count_if((base(one_layer) == base(F.col("layer_probe"))) & F.col("ba_max").isNotNull()).alias("layer_agree"),
        F.count("ba_max").alias("layer_total"),
        F.count_if(has_c & (trait | (positive_sign(F.col("c_bar"), t.c_bar_positive) == F.col("c_bar_sign")))).alias("c_bar_agree"),
        F.count("c_bar").alias("c_bar_total"),
        F.count_if((one_role == F.col("spectral_role")) & F.col("state_drop").isNotNull()).alias("role_agree"),
        F.count("state_drop").alias("role_total"),
    )
    out = cell.join(agree, "cell")
    return out.select(
        "cell",
        F.concat(F.lit("("), F.replace("layout", F.lit(","), F.lit(", ")), F.lit(")")).alias("layout"),
        "delta_label_sign",
        "layer_probe",
        "c_bar",
        "spectral_role",
        outcome(F.col("layout"), F.col("delta_label_sign"), F.col("layer_probe"), F.col("c_bar")).alias("outcome"),
        "delta_label_value",
        "layer_max_ba",
        "layer_last_ba",
        "layer_argmax_depth",
        F.when(trait, float("nan")).otherwise(F.coalesce("_c_bar", F.lit(float("nan")))).alias("c_bar_value"),
        "state_drop",
        "subject_drop",
        "delta_agree",
        "delta_total",
        "layer_agree",
        "layer_total",
        "c_bar_agree",
        "c_bar_total",
        "role_agree",
        "role_total",
    )
