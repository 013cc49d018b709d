"""Order-dependent operators: runs, windows, referencing, epochs around markers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..contracts import require_empty
from ..functions import arrays as A
from ..plans.moments import attach
from ..plans.ordered import HOT_ROWS, lagged, running


def segment_runs(
    df: DataFrame, session: Sequence[str], order: str, keys: Sequence[str], name: str = "run", hot_rows=HOT_ROWS
) -> DataFrame:
    """Number (from 0) the maximal runs of constant ``keys`` along ``order`` within a session."""
    previous = {f"_prev_{k}": k for k in keys}
    seen = lagged(df.withColumn("_seen", F.lit(1)), session, order, {**previous, "_prev_seen": "_seen"}, hot_rows=hot_rows)
    same = F.col("_prev_seen").isNotNull()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_prev_{k}"))
    starts = seen.withColumn("_start", F.when(same, 0).otherwise(1).cast("bigint"))
    numbered = running(starts, session, [order], {name: F.col("_start")}, rank=None, hot_rows=hot_rows)
    return numbered.withColumn(name, F.col(name) - 1).drop("_start", "_seen", "_prev_seen", *previous)


def runs_to_recordings(df: DataFrame, session: Sequence[str], order: str, keys: Sequence[str], hot_rows=HOT_ROWS) -> DataFrame:
    """One row per run: its keys, first and last position and length."""
    runs = segment_runs(df, session, order, keys, hot_rows=hot_rows)
    return runs.groupBy(*session, "run", *keys).agg(
        F.min(order).alias("first_row"), F.max(order).alias("last_row"), F.count(F.lit(1)).alias("n_rows")
    )


def index_samples(samples: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows=HOT_ROWS) -> DataFrame:
    """0-based sample index per recording and channel, for tables that only carry time stamps."""
    out = running(samples, keys, list(order), {}, rank="sample_idx", hot_rows=hot_rows)
    return out.withColumn("sample_idx", F.col("sample_idx") - 1)


def fixed_windows(samples: DataFrame, keys: Sequence[str], win: int, value: str = "v", index: str = "sample_idx") -> DataFrame:
    """Non-overlapping windows of ``win`` samples as arrays; a partial tail is dropped."""
    cut = samples.withColumn("epoch", F.floor(F.col(index) / win).cast("bigint"))
    packed = cut.groupBy(*keys, "epoch").agg(
        F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(F.struct(index, value))).alias("_s")
    )
    return packed.where(F.col("_n") == win).select(
        *keys, "epoch", F.transform("_s", lambda s: s[value].cast("double")).alias("x")
    )


def window_stats(samples: DataFrame, keys: Sequence[str], win: int, value: str = "v", index: str = "sample_idx") -> DataFrame:
    """Count, mean and population deviation of full windows, without building arrays."""
    cut = samples.withColumn("epoch", F.floor(F.col(index) / win).cast("bigint"))
    return (
        cut.groupBy(*keys, "epoch")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
        .where(F.col("n") == win)
    )


def estimate_windows(headers: DataFrame, win: int, sfreq_out: float, n_times: str = "n_times", sfreq: str = "sfreq") -> DataFrame:
    """Windows a set of recordings will give, from headers alone."""
    resampled = F.floor(F.col(n_times) * sfreq_out / F.col(sfreq))
    return headers.agg(
        F.count(F.lit(1)).alias("n_recordings"),
        F.sum(F.floor(resampled / win)).alias("n_windows"),
        F.sum(F.col(n_times) / F.col(sfreq)).alias("seconds"),
    )


# ---- referencing and per-epoch normalisation in long form ------------------------------------------------------------------


def rereference(samples: DataFrame, instant: Sequence[str], channels: Sequence[str] | None = None, value: str = "v", ch: str = "ch") -> DataFrame:
    """Subtract, at each instant, the mean over all channels or over the named ones."""
    at = Window.partitionBy(*instant)
    if channels is None:
        reference = F.avg(value).over(at)
    else:
        wanted = [c.strip().upper() for c in channels]
        reference = F.avg(F.when(F.upper(F.trim(ch)).isin(wanted), F.col(value))).over(at)
    return samples.withColumn(value, F.col(value) - reference)


def zscore_epochs(samples: DataFrame, epoch: Sequence[str], value: str = "v", clamp: float = 15.0) -> DataFrame:
    """Per-epoch z-score (population deviation + 1e-8) clipped at ``clamp``; ``epoch`` names one epoch and channel."""
    inside = Window.partitionBy(*epoch)
    z = (F.col(value) - F.avg(value).over(inside)) / (F.stddev_pop(value).over(inside) + 1e-8)
    return samples.withColumn(value, A.clamp(z, clamp))


# ---- frozen scaler ----------------------------------------------------------------------------------------------------------


def fit_scaler(samples: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Per-channel mean and population deviation + 1e-8 over all trials and instants: a small table to keep."""
    return samples.groupBy(*keys).agg(F.avg(value).alias("mu"), (F.stddev_pop(value) + 1e-8).alias("sigma"))


def apply_scaler(samples: DataFrame, scaler: DataFrame, keys: Sequence[str], value: str = "v", clamp: float = 15.0) -> DataFrame:
    """z-score and clip with a fitted scaler; the same function serves batches and streams. A channel the scaler has
    not seen fails."""
    known = scaler.withColumn("_known", F.lit(True))
    joined = samples.join(known, list(keys), "left")
    unseen = F.raise_error(F.concat(F.lit("channel not fitted: "), F.to_json(F.struct(*keys)))).cast("double")
    z = F.when(F.col("_known"), A.clamp((F.col(value) - F.col("mu")) / F.col("sigma"), clamp)).otherwise(unseen)
    return joined.withColumn(value, z).drop("mu", "sigma", "_known")


def fit_epoch_scaler(epochs: DataFrame, keys: Sequence[str], vec: str = "x") -> DataFrame:
    """``fit_scaler`` for epochs held as arrays: merged from per-row sums of squares, no explode."""
    n = F.size(vec).cast("double")
    rows = epochs.select(*keys, n.alias("n"), A.mean(F.col(vec)).alias("m"), (A.variance_pop(F.col(vec)) * n).alias("ss"))
    merged = rows.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"),
        F.sum("ss").alias("ss"),
        F.var_pop("m").alias("_vm"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_nm2"),
    )
    between = F.greatest(F.col("_nm2") - F.col("n") * F.col("mu") * F.col("mu"), F.lit(0.0))
    return merged.select(*keys, "mu", (F.sqrt((F.col("ss") + between) / F.col("n")) + 1e-8).alias("sigma"))


def apply_epoch_scaler(epochs: DataFrame, scaler: DataFrame, keys: Sequence[str], vec: str = "x", clamp: float = 15.0) -> DataFrame:
    known = scaler.withColumn("_known", F.lit(True))
    joined = epochs.join(known, list(keys), "left")
    unseen = F.raise_error(F.concat(F.lit("channel not fitted: "), F.to_json(F.struct(*keys)))).cast("array<double>")
    z = F.transform(vec, lambda v: A.clamp((v - F.col("mu")) / F.col("sigma"), clamp))
    return joined.withColumn(vec, F.when(F.col("_known"), z).otherwise(unseen)).drop("mu", "sigma", "_known")


def zscore_arrays(epochs: DataFrame, vec: str = "x", clamp: float = 15.0) -> DataFrame:
    """Per-epoch z-score on arrays."""
    scale = F.struct(A.mean(F.col(vec)).alias("mu"), (F.sqrt(A.variance_pop(F.col(vec))) + 1e-8).alias("sd"))
    z = A.let(scale, lambda s: F.transform(vec, lambda v: A.clamp((v - s["mu"]) / s["sd"], clamp)))
    return epochs.withColumn(vec, z)


# ---- epochs around markers -----------------------------------------------------------------------------------------------


def epoch_samples(
    samples: DataFrame,
    markers: DataFrame,
    tmin: float,
    tmax: float,
    session: str = "recording_id",
    ts: str = "ts",
    onset: str = "onset",
    slot: float | None = None,
) -> DataFrame:
    """Samples with ``onset + tmin <= ts < onset + tmax`` in the marker's session, times in seconds.

    The range join is an equality join: a sample falls into one time slot, a marker meets the slots its window covers.
    Slots as wide as the window keep this to at most two per marker and spread one busy session over many tasks.
    """
    width = float(slot or max(tmax - tmin, 1e-9))
    s = samples.withColumn("_slot", F.floor(F.col(ts) / width).cast("bigint"))
    m = markers.withColumn(
        "_slot",
        F.explode(
            F.sequence(
                F.floor((F.col(onset) + tmin) / width).cast("bigint"), F.floor((F.col(onset) + tmax) / width).cast("bigint")
            )
        ),
    )
    joined = m.join(s, [session, "_slot"])
    return joined.where((F.col(ts) >= F.col(onset) + tmin) & (F.col(ts) < F.col(onset) + tmax)).drop("_slot")


def epoch_summary(
    samples: DataFrame,
    markers: DataFrame,
    tmin: float,
    tmax: float,
    max_gap: float | None = None,
    session: str = "recording_id",
    ts: str = "ts",
    onset: str = "onset",
    code: str = "code",
    order: str = "row_id",
    value: str = "v",
    hot_rows=HOT_ROWS,
) -> DataFrame:
    """One row per marker (code 0 is no marker): samples, value mean, largest gap and a status.

    Status: ``ok``, ``empty``, ``dropout`` (a gap above ``max_gap``), ``not_ready`` (the session ends before the window
    does) or ``aged_out`` (the session starts after it). Gaps are taken once along the session, before the join, so the
    join needs no window over its output.
    """
    real = markers.where(F.col(code) != 0)
    timed = lagged(samples, [session], ts, {"_prev": ts}, hot_rows=hot_rows) if order is None else _lag_by(
        samples, session, ts, order, hot_rows
    )
    span = samples.groupBy(session).agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"))
    hits = epoch_samples(timed.select(session, ts, value, "_prev"), real.select(session, code, onset), tmin, tmax, session, ts, onset)
    gap = F.when(F.col("_prev") >= F.col(onset) + tmin, F.col(ts) - F.col("_prev"))
    agg = hits.groupBy(session, code, onset).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg(value).alias("mean_v"), F.max(gap).alias("max_gap")
    )
    out = real.select(session, code, onset).join(agg, [session, code, onset], "left").join(span, session, "left")
    status = (
        F.when(F.col("_to").isNull() | (F.col("_to") < F.col(onset) + tmax), "not_ready")
        .when(F.col("_from") > F.col(onset) + tmin, "aged_out")
        .when(F.col("n_samples").isNull(), "empty")
    )
    if max_gap is not None:
        status = status.when(F.col("max_gap") > max_gap, "dropout")
    return out.select(
        session,
        code,
        onset,
        F.coalesce("n_samples", F.lit(0)).alias("n_samples"),
        "mean_v",
        "max_gap",
        status.otherwise("ok").alias("status"),
    )


def _lag_by(samples: DataFrame, session: str, ts: str, order: str, hot_rows) -> DataFrame:
    return lagged(samples, [session], order, {"_prev": ts}, hot_rows=hot_rows)


def epoch_matrix(
    samples: DataFrame,
    markers: DataFrame,
    tmin: float,
    tmax: float,
    session: str = "recording_id",
    ts: str = "ts",
    onset: str = "onset",
    code: str = "code",
    order: str = "row_id",
    value: str = "v",
    ch: str = "ch",
) -> DataFrame:
    """Epochs as one array per marker and channel, in arrival order."""
    hits = epoch_samples(samples, markers.where(F.col(code) != 0), tmin, tmax, session, ts, onset)
    packed = hits.groupBy(session, code, onset, ch).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_s"))
    return packed.select(session, code, onset, ch, F.transform("_s", lambda s: s[value].cast("double")).alias("x"))


# ---- channels -------------------------------------------------------------------------------------------------------------


def select_channels(epochs: DataFrame, want: Sequence[str], ch: str = "ch", key: Sequence[str] = (), header: DataFrame | None = None) -> DataFrame:
    """Keep and renumber channels by case-insensitive name. A wanted name absent from a recording is an error.

    ``header`` (key, ch) lists the channels of each recording, as a device tells them before its first sample. With it
    the check is part of the plan: the first row of a recording that lacks a channel, or of one that no header has,
    fails the query and names it. So it works on a stream; without it all names are looked up first, in a job.
    """
    spark = epochs.sparkSession
    wanted = spark.createDataFrame([(i, n.strip().upper(), n) for i, n in enumerate(want)], "pos int, _name string, want string")
    named = epochs.withColumn("_name", F.upper(F.trim(ch)))
    names = F.lit([n.strip().upper() for n in want])
    if header is not None:
        have = header.groupBy(*key).agg(F.array_except(names, F.collect_set(F.upper(F.trim(ch)))).alias("_missing"))
        named = named.join(have, list(key), "left") if key else attach(named, have)
        lacking = F.coalesce(F.array_join("_missing", ", "), F.lit("no header"))
        error = F.raise_error(F.concat(F.lit("requested channels not in recording: "), lacking))
        named = named.where(F.when(F.coalesce(F.size("_missing"), F.lit(1)) > 0, error.cast("boolean")).otherwise(True)).drop("_missing")
    elif key:
        have = named.groupBy(*key).agg(F.collect_set("_name").alias("_have"))
        short = have.withColumn("missing", F.array_except(names, "_have"))
        require_empty(short.where(F.size("missing") > 0).select(*key, "missing"), "requested channels not in recording")
    else:
        require_empty(
            wanted.join(named.select("_name").distinct(), "_name", "left_anti").select("want"),
            "requested channels not in recording",
        )
    return named.join(F.broadcast(wanted), "_name").drop("_name", ch).withColumnRenamed("want", ch)


def running_rate(trials: DataFrame, run: Sequence[str], order: str, hit: Column, hot_rows=HOT_ROWS) -> DataFrame:
    """Trials so far, hits so far and hit rate after each online trial."""
    out = running(trials, run, [order], {"hits": hit.cast("bigint")}, rank="n_trials", hot_rows=hot_rows)
    return out.withColumn("rate", F.col("hits") / F.col("n_trials"))
