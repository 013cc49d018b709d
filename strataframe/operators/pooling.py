"""Mean pooling: windows to recordings, tokens to subjects, repeats to images, hidden states to vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import arrays as A
from ..plans.moments import cell_moments


def mean_pool(df: DataFrame, keys: Sequence[str], vec: str = "x") -> DataFrame:
    """``keys, n, x``: mean vector per key."""
    return cell_moments(df, keys, vec).select(*keys, "n", F.col("mean").alias(vec))


def pool_recordings(df: DataFrame, run: str = "run", subject: str = "subject_id", label: str = "label", vec: str = "x", session: Sequence[str] = ()) -> DataFrame:
    """One feature vector per recording run."""
    return mean_pool(df, [*session, run, subject, label], vec)


def average_repeats(epochs: DataFrame, image: str = "image", ch: str = "ch", vec: str = "x") -> DataFrame:
    """Mean epoch per image and channel, with the number of trials averaged."""
    return mean_pool(epochs, [image, ch], vec).withColumnRenamed("n", "n_trials")


def average_repeats_long(samples: DataFrame, image: str = "image", ch: str = "ch", t: str = "t", value: str = "v") -> DataFrame:
    """The same over long samples."""
    return samples.groupBy(image, ch, t).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n_trials"))


def pool_sparse(latents: DataFrame, rows: DataFrame, row: str = "row_id", subject: str = "subject_id", feature: str = "feature", value: str = "value") -> DataFrame:
    """Mean activation per subject and feature from sparse latents: the divisor is the subject's token count, not the
    number of non-zero entries. Only non-zero means are returned."""
    tokens = rows.groupBy(subject).agg(F.count(F.lit(1)).alias("n_tokens"))
    sums = latents.join(rows.select(row, subject), row).groupBy(subject, feature).agg(F.sum(value).alias("_s"))
    return sums.join(tokens, subject).select(subject, feature, (F.col("_s") / F.col("n_tokens")).alias(value))


def pool_hidden(states: DataFrame, hidden: str = "h", vec: str = "x", rank: int = 2) -> DataFrame:
    """Mean over all but the last axis of nested hidden states held in one row (``rank`` array levels, the last the
    feature axis); rank 1 passes through."""
    h = F.col(hidden)
    for _ in range(max(0, rank - 2)):
        h = F.flatten(h)
    if rank == 1:
        return states.withColumn(vec, h).drop(hidden) if vec != hidden else states
    summed = F.aggregate(F.slice(h, 2, F.size(h)), A.as_double(h[0]), lambda acc, t: A.add(acc, A.as_double(t)))
    return states.withColumn(vec, A.scale(summed, 1.0 / F.size(h))).drop(*([hidden] if hidden != vec else []))


def pool_channel_tokens(
    tokens: DataFrame, n_channels: int, steps: int, group: int = 4, keys: Sequence[str] = ("row_id",), pos: str = "pos", vec: str = "x"
) -> DataFrame:
    """Channel vectors from a token stream that carries one register token before every ``group`` real ones.

    Registers and the padding behind the last channel are dropped, then the ``steps`` coarse times of a channel are
    averaged."""
    unit = group + 1
    real = F.col(pos) - F.floor(F.col(pos) / unit) - 1
    whole = F.floor((F.max(pos) + 1) / unit) * unit
    bounds = tokens.groupBy(*keys).agg(whole.alias("_whole"))
    kept = (
        tokens.where(F.col(pos) % unit != 0)
        .join(bounds, list(keys))
        .where(F.col(pos) < F.col("_whole"))
        .withColumn("_real", real)
        .where(F.col("_real") < n_channels * steps)
        .withColumn("channel", F.floor(F.col("_real") / steps).cast("int"))
    )
    return mean_pool(kept, [*keys, "channel"], vec)


def tokenize(windows: DataFrame, fine: int = 32, ch_pos: str = "ch_pos", vec: str = "x") -> DataFrame:
    """Cut each channel window into tokens of ``fine`` samples, channel-major. A length that does not divide fails."""
    n = F.size(vec)
    bad = F.raise_error(F.lit(f"window length must be a multiple of {fine}")).cast("int")
    steps = F.when(n % fine == 0, (n / fine).cast("int")).otherwise(bad)
    cut = F.transform(F.sequence(F.lit(0), F.col("_steps") - 1), lambda i: F.slice(vec, i * fine + 1, F.lit(fine)))
    rest = [c for c in windows.columns if c != vec]
    return (
        windows.withColumn("_steps", steps)
        .select(*rest, "_steps", F.posexplode(cut).alias("t_coarse", vec))
        .withColumn("token", F.col(ch_pos) * F.col("_steps") + F.col("t_coarse"))
        .drop("_steps")
    )


def pad_windows(windows: DataFrame, length: int, vec: str = "x") -> DataFrame:
    """Zero-pad short windows on the right to one patch."""
    return windows.withColumn(vec, A.pad_right(A.as_double(vec), length))
