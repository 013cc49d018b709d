"""Scores and summaries: correlations, AUC, R^2, accuracy, spread over seeds, health bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ordered import HOT_ROWS, ranked, running


def balanced_accuracy(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the classes present in the truth."""
    recall = df.groupBy(*by, truth).agg(F.avg((F.col(truth) == F.col(prediction)).cast("double")).alias("_r"))
    return recall.groupBy(*by).agg(F.avg("_r").alias("balanced_accuracy"), F.count(F.lit(1)).alias("n_classes"))


def pearson_by_subject(df: DataFrame, pairs: Sequence[tuple[str, str]], subject: str = "subject_id") -> DataFrame:
    """``target, r`` on subject means; NaN when either side has (almost) no spread."""
    columns = sorted({c for p in pairs for c in p})
    means = df.groupBy(subject).agg(*[F.avg(c).alias(c) for c in columns])
    entries = [
        F.struct(F.lit(truth).alias("target"), F.col(pred).alias("p"), F.col(truth).alias("y")) for pred, truth in pairs
    ]
    long = means.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    flat = (F.stddev_pop("p") < 1e-8) | (F.stddev_pop("y") < 1e-8)
    r = F.try_divide(F.covar_pop("p", "y"), F.stddev_pop("p") * F.stddev_pop("y"))
    return long.groupBy("target").agg(
        F.when(flat, float("nan")).otherwise(r).alias("r"), F.count(F.lit(1)).alias("n_subjects")
    )


def rank_auc(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    label: str,
    ties: str = "average",
    order: str = "row_id",
    hot_rows=HOT_ROWS,
) -> DataFrame:
    """Rank-sum AUC per key, 0.5 when a class is empty.

    ``average`` counts ties half and first folds rows of equal score into one; ``ordinal`` breaks ties by ``order``.
    """
    keys = list(keys)
    if ties == "ordinal":
        rows = ranked(df, keys, [score, order], "_rank", hot_rows=hot_rows)
        sums = rows.groupBy(*keys).agg(
            F.sum(F.when(F.col(label) == 1, F.col("_rank"))).cast("double").alias("_s"),
            F.count_if(F.col(label) == 1).cast("double").alias("_p"),
            F.count_if(F.col(label) == 0).cast("double").alias("_q"),
        )
        value = (F.col("_s") - F.col("_p") * (F.col("_p") + 1.0) / 2.0) / (F.col("_p") * F.col("_q"))
    else:
        folded = df.groupBy(*keys, F.col(score).alias("_score")).agg(
            F.count_if(F.col(label) == 1).cast("double").alias("_pos"),
            F.count_if(F.col(label) == 0).cast("double").alias("_neg"),
        )
        return auc_from_counts(folded, keys, hot_rows)
    return _auc(sums, keys, value)


def auc_from_counts(folded: DataFrame, keys: Sequence[str], hot_rows=HOT_ROWS) -> DataFrame:
    """AUC from ``keys, _score, _pos, _neg``: one row per distinct score with its class counts; ties count half."""
    rows = running(folded, keys, ["_score"], {"_upto": F.col("_neg")}, rank=None, hot_rows=hot_rows)
    sums = rows.groupBy(*keys).agg(
        F.sum(F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2.0)).alias("_s"),
        F.sum("_pos").alias("_p"),
        F.sum("_neg").alias("_q"),
    )
    return _auc(sums, keys, F.col("_s") / (F.col("_p") * F.col("_q")))


def _auc(sums: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    empty = (F.col("_p") == 0) | (F.col("_q") == 0)
    return sums.select(*keys, F.when(empty, 0.5).otherwise(value).alias("auc"), F.col("_p").cast("bigint").alias("n_pos"), F.col("_q").cast("bigint").alias("n_neg"))


def r2(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """1 - SS_res / (SS_tot + 1e-12); negative for a prediction worse than the mean."""
    err = F.col(truth) - F.col(prediction)
    return df.groupBy(*by).agg(
        (1.0 - F.sum(err * err) / (F.var_pop(truth) * F.count(truth) + 1e-12)).alias("r2"), F.count(F.lit(1)).alias("n")
    )


def seed_summary(df: DataFrame, value: str, by: Sequence[str] = (), seed: str = "seed", first: Sequence[int] = (42, 123, 2024)) -> DataFrame:
    """Spread over seeds: mean, both standard deviations, range, and mean and deviation over the ``first`` seeds."""
    chosen = F.when(F.col(seed).isin(list(first)), F.col(value))
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(0.0).alias("std_ddof1"),
        F.stddev_pop(value).alias("std_ddof0"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(value).alias("n_seeds"),
        F.avg(chosen).alias("mean_first"),
        F.when(F.count(chosen) > 1, F.stddev_samp(chosen)).otherwise(0.0).alias("std_first_ddof1"),
    )


def _bands(alpha: str, exact_median: bool) -> list[Column]:
    a = F.col(alpha)
    median = F.percentile(a, 0.5) if exact_median else F.percentile_approx(a, 0.5, 10_000).cast("double")
    return [
        F.count(F.lit(1)).alias("n_matrices"),
        F.avg(a).alias("alpha_mean"),
        median.alias("alpha_median"),
        F.min(a).alias("alpha_min"),
        F.max(a).alias("alpha_max"),
        F.avg((a < 2).cast("double")).alias("fraction_lt_2"),
        F.avg(((a >= 2) & (a <= 6)).cast("double")).alias("fraction_2_6"),
    ]


def health_bands(alphas: DataFrame, by: Sequence[str], alpha: str = "alpha", exact_median: bool = True) -> DataFrame:
    """Exponent summary per group: mean, median, range and the shares below 2, in 2..6 and above 6."""
    above = F.avg((F.col(alpha) > 6).cast("double")).alias("fraction_gt_6")
    return alphas.groupBy(*by).agg(*_bands(alpha, exact_median), above)


def block_of(longname: str | Column) -> Column:
    """Block number in a dotted module name, NULL when there is none."""
    column = F.col(longname) if isinstance(longname, str) else longname
    return F.regexp_extract(column, r"layers\.(\d+)\.", 1).try_cast("int")


def block_summary(alphas: DataFrame, by: Sequence[str], alpha: str = "alpha", weight: str = "log_norm") -> DataFrame:
    """``health_bands`` without the upper share, plus the weighted mean sum(alpha w) / sum(w), NaN when the weights
    cancel."""
    weighted = F.try_divide(F.sum(F.col(alpha) * F.col(weight)), F.sum(weight))
    return alphas.groupBy(*by).agg(
        *_bands(alpha, True), F.coalesce(weighted, F.lit(float("nan"))).alias("alpha_weighted_mean")
    )


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width bin, empty bins included; the last bin is closed on the right."""
    v = F.col(value)
    width = (high - low) / bins
    cell = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where((v >= low) & (v <= high)).groupBy(*by, cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    axis = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        groups = df.select(*by).distinct()
        axis = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = axis.join(counts, [*by, "bin"], "left")
    return out.select(
        *by, "bin", (F.lit(low) + F.col("bin") * width).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def annotation_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Rows and distinct values per annotation column."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[count(c).alias(f"n_{c}") for c in columns])


def layer_summary(per_depth: DataFrame, by: Sequence[str] = (), ba: str = "label_ba", depth: str = "depth", fraction: str = "depth_fraction") -> DataFrame:
    """First, last and best label accuracy over depth, and the depth fraction of the best (shallowest on ties); NaN
    depths count for first and last only."""
    v = F.col(ba)
    live = ~F.isnan(v) & v.isNotNull()
    return per_depth.groupBy(*by).agg(
        F.min_by(ba, depth).alias("label_ba_first"),
        F.max_by(ba, depth).alias("label_ba_last"),
        F.max(F.when(live, v)).alias("label_ba_max"),
        F.max_by(F.when(live, F.col(fraction)), F.when(live, F.struct(v, -F.col(depth)))).alias("argmax_depth"),
    ).where(F.col("label_ba_max").isNotNull())


def calibration_report(trials: DataFrame, gallery: DataFrame, code: str = "code", gid: str = "id") -> DataFrame:
    """Trials, trials and images in the gallery, mean repeats per image."""
    known = gallery.select(F.col(gid).alias(code)).distinct().withColumn("_known", F.lit(1))
    per = trials.groupBy(code).agg(F.count(F.lit(1)).alias("_c")).join(known, code, "left")
    hit = F.col("_known").isNotNull()
    return per.agg(
        F.sum("_c").alias("n_trials"),
        F.count(F.when(hit, F.col("_c"))).alias("n_fit_samples"),
        F.count(F.when(hit, F.lit(1))).alias("n_images"),
        F.avg(F.when(hit, F.col("_c"))).alias("mean_trials_per_image"),
    )


def select_run(runs: DataFrame, by: Sequence[str], ev: str = "explained_var", dead: str = "dead_fraction", slack: float = 0.02, tie: str = "lr") -> DataFrame:
    """Per group: among runs within ``slack`` of the best explained variance, the least dead, then the best explained."""
    best = runs.groupBy(*by).agg(F.max(ev).alias("_best"))
    rows = runs.join(best, list(by)).where(F.col(ev) >= F.col("_best") - slack).drop("_best")
    rest = [c for c in rows.columns if c not in by]
    picked = rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(F.col(dead), -F.col(ev), F.col(tie))).alias("_p"))
    return picked.select(*by, "_p.*")


def best_by(runs: DataFrame, by: Sequence[str], value: str, tie: str) -> DataFrame:
    """Per group the row with the largest ``value`` (smallest ``tie`` on ties)."""
    rest = [c for c in runs.columns if c not in by]
    picked = runs.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(-F.col(value), F.col(tie))).alias("_p"))
    return picked.select(*by, "_p.*")


def compare_runs(left: DataFrame, right: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Two runs by name: value in each and right minus left."""
    a = left.select(*key, *[F.col(v).alias(f"{v}_a") for v in values])
    b = right.select(*key, *[F.col(v).alias(f"{v}_b") for v in values])
    out = a.join(b, list(key))
    return out.withColumns({f"{v}_delta": F.col(f"{v}_b") - F.col(f"{v}_a") for v in values})


def standardise_targets(df: DataFrame, targets: Sequence[str], split: str = "split", eps: float = 1e-8) -> DataFrame:
    """z-score targets with mean and population deviation of the training rows."""
    train = F.col(split) == "train"
    stats = df.agg(
        *[F.avg(F.when(train, F.col(t))).alias(f"_m_{t}") for t in targets],
        *[F.stddev_pop(F.when(train, F.col(t))).alias(f"_s_{t}") for t in targets],
    )
    out = df.join(F.broadcast(stats))
    out = out.withColumns({t: (F.col(t) - F.col(f"_m_{t}")) / (F.col(f"_s_{t}") + eps) for t in targets})
    return out.drop(*[f"_m_{t}" for t in targets], *[f"_s_{t}" for t in targets])
