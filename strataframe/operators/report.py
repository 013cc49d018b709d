"""Report tables: leaderboard, master table, erasure and variance comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import fixed_signed
from . import rubric

# Column order of the leaderboard file.
LEADERBOARD_FIELDS = (
    "dataset",
    "paradigm",
    "n_subjects",
    "n_recordings",
    "n_windows",
    "label_frac",
    "subject_frac",
    "residual_frac",
    "excess_label_ratio",
    "excess_subject_ratio",
    "c_bar_value",
    "raw_label_ba",
    "identity_free_label_ba",
    "erasure_delta",
    "erasure_interpretable",
    "layer_label_ba_first",
    "layer_label_ba_last",
    "layer_label_ba_max",
    "layer_argmax_depth",
    "layer_sign",
    "state_drop",
    "subject_drop",
    "oneoverf_role",
    "verdict",
    "layer",
    "model",
    "status",
)


def number(text: str | Column) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return column.cast("string").try_cast("double")


def leaderboard(rows: DataFrame) -> DataFrame:
    """Finished rows with their lift (identity-free minus raw accuracy), largest first, rows without a number last."""
    lift = number("identity_free_label_ba") - number("raw_label_ba")
    ok = rows.where(F.col("status") == "ok").withColumn("lift", lift)
    return ok.orderBy(F.col("lift").desc_nulls_last(), "dataset")


def leaderboard_diagnostics(rows: DataFrame) -> DataFrame:
    """Finished rows for which a depth or 1/f diagnostic was run."""
    present = lambda c: number(c).isNotNull() & ~F.isnan(number(c))
    some = F.coalesce(present("layer_label_ba_max"), F.lit(False)) | F.coalesce(present("state_drop"), F.lit(False))
    some = some | (F.coalesce("layer_sign", F.lit("")) != "") | (F.coalesce("oneoverf_role", F.lit("")) != "")
    return rows.where((F.col("status") == "ok") & some)


def leaderboard_failures(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.col("status") != "ok", F.lit(True))).select("dataset", "status")


def leaderboard_columns(rows: DataFrame) -> DataFrame:
    """All leaderboard columns in file order, missing ones NULL."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in LEADERBOARD_FIELDS])


def with_verdict(rows: DataFrame) -> DataFrame:
    """Add the verdict, depth sign and 1/f role columns to audit rows."""
    d = lambda c: F.col(c).cast("double")
    return (
        rows.withColumn(
            "verdict",
            rubric.leaderboard_verdict(d("label_frac"), d("subject_frac"), d("raw_label_ba"), d("identity_free_label_ba")),
        )
        .withColumn("layer_sign", rubric.layer_flags(d("layer_label_ba_last"), d("layer_label_ba_max"), d("layer_argmax_depth")))
        .withColumn("oneoverf_role", rubric.spectral_roles(d("state_drop"), d("subject_drop")))
    )


def render_markdown(table: DataFrame, columns: Sequence[str], digits: int = 3, limit: int = 10_000) -> str:
    """A report table as Markdown. Only the report itself is collected; one longer than ``limit`` rows is refused."""
    rows = table.select(*columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"report has more than {limit} rows")

    def text(v):
        if v is None or (isinstance(v, float) and v != v):
            return "—"
        return f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(text(v) for v in r) + " |" for r in rows]) + "\n"


def mean_pm_std(mean: Column, std: Column, digits: int = 3) -> Column:
    """``0.123 ± 0.045``; a dash when there is no mean."""
    body = F.format_string(f"%.{digits}f", mean)
    full = F.concat(body, F.lit(" ± "), F.format_string(f"%.{digits}f", std))
    return F.when(mean.isNull(), "—").when(std.isNull(), body).otherwise(full)


def best_in_tier(scores: DataFrame, tier: str = "tier", cell: str = "cell", mean: str = "mean", order: str = "method_ord") -> DataFrame:
    """Mark the best method of each tier and cell, the first listed on ties."""
    best = scores.where(F.col(mean).isNotNull()).groupBy(tier, cell).agg(
        F.min_by(order, F.struct(-F.col(mean), F.col(order))).alias("_best")
    )
    return scores.join(best, [tier, cell], "left").withColumn("is_best", F.coalesce(F.col(order) == F.col("_best"), F.lit(False))).drop("_best")


def master_table(scores: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Methods by cells as ``mean ± sd`` text, the best of each tier and cell in asterisks. ``scores(tier, method,
    method_ord, cell, value, seed)``."""
    stats = scores.groupBy("tier", "method", "method_ord", "cell").agg(
        F.avg("value").alias("mean"), F.when(F.count("value") > 1, F.stddev_samp("value")).otherwise(0.0).alias("std")
    )
    marked = best_in_tier(stats)
    body = mean_pm_std(F.col("mean"), F.col("std"))
    text = marked.withColumn("_t", F.when(F.col("is_best"), F.concat(F.lit("**"), body, F.lit("**"))).otherwise(body))
    wide = text.groupBy("tier", "method", "method_ord").pivot("cell", list(cells)).agg(F.first("_t"))
    return wide.select("tier", "method", "method_ord", *[F.coalesce(F.col(f"`{c}`"), F.lit("—")).alias(c) for c in cells])


def frozen_vs_tuned(fractions: DataFrame) -> DataFrame:
    """Frozen and tuned variance shares of each (model, cell) in percent with their difference in points.

    ``fractions(model, cell, source, label_frac, subject_frac, residual_frac)`` with source frozen or ft; the tuned side
    may be missing."""
    side = lambda s, c: (F.max(F.when(F.col("source") == s, F.col(c))) * 100.0)
    wide = fractions.groupBy("model", "cell").agg(
        *[side(s, c).alias(f"{s}_{c}") for s in ("frozen", "ft") for c in ("label_frac", "subject_frac", "residual_frac")]
    )
    wide = wide.where(F.col("frozen_label_frac").isNotNull())
    return wide.withColumn("delta_label", F.col("ft_label_frac") - F.col("frozen_label_frac")).withColumn(
        "delta_subject", F.col("ft_subject_frac") - F.col("frozen_subject_frac")
    )


def with_null_reference(fractions: DataFrame, nulls: DataFrame) -> DataFrame:
    """Shares in percent beside the null subject share of the same (model, cell) and the mean null of the cell."""
    pct = nulls.select("model", "cell", (F.col("null_subject_frac_mean") * 100.0).alias("null_subject_pct"))
    panel = pct.groupBy("cell").agg(F.avg("null_subject_pct").alias("panel_null_pct"))
    shares = fractions.select(
        "model", "cell", (F.col("label_frac") * 100.0).alias("label_pct"), (F.col("subject_frac") * 100.0).alias("subject_pct")
    )
    return shares.join(pct, ["model", "cell"], "left").join(panel, "cell", "left")


def ablation_deltas(scores: DataFrame) -> DataFrame:
    """State and subject accuracy on the original signal and the change under each ablation. ``scores(cell, model,
    condition, state_ba, subject_ba)``."""
    value = lambda c, v: F.max(F.when(F.col("condition") == c, F.col(v)))
    wide = scores.groupBy("cell", "model").agg(
        *[
            value(c, f"{v}_ba").alias(f"{v}_{n}")
            for v in ("state", "subject")
            for c, n in (("original", "orig"), ("aperiodic_removed", "aper"), ("periodic_removed", "per"))
        ]
    )
    out = ["cell", "model"]
    for v in ("state", "subject"):
        out += [
            F.col(f"{v}_orig"),
            (F.col(f"{v}_aper") - F.col(f"{v}_orig")).alias(f"{v}_d_aper"),
            (F.col(f"{v}_per") - F.col(f"{v}_orig")).alias(f"{v}_d_per"),
        ]
    return wide.select(*out)


def erasure_table(rows: DataFrame, models: Sequence[str], paired: str = "paired") -> DataFrame:
    """Per cell: range of the raw accuracy over models (percent) and one signed difference per model; cells without a
    within-subject contrast show no difference."""
    delta = F.when(F.col(paired), F.col("label_ba_delta") * 100.0)
    per = rows.groupBy("cell").agg(
        F.round(F.min("label_ba_raw") * 100.0, 0).cast("int").alias("raw_min"),
        F.round(F.max("label_ba_raw") * 100.0, 0).cast("int").alias("raw_max"),
        *[F.max(F.when(F.col("model") == m, delta)).alias(f"_{m}") for m in models],
    )
    span = F.format_string("%d--%d", "raw_min", "raw_max").alias("raw_range")
    shown = [F.when(F.col(f"_{m}").isNull(), "—").otherwise(fixed_signed(F.col(f"_{m}"), 1)).alias(m) for m in models]
    return per.select("cell", span, *shown)

