"""Exact, linearly interpolated percentiles over groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one buffer. Here a quantile sketch first brackets
each wanted order statistic (its rank error is bounded by 1/accuracy); a second pass counts the values below the bracket
and keeps only those inside it. Groups of up to half the accuracy are kept whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..contracts import BROADCAST_LIMIT, fits_broadcast
from ..session import checkpoint
from .ordered import running


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """``keys, p, q``: one row per group and probability. NULL and NaN values are ignored."""
    keys, probs = list(keys), [float(p) for p in probs]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(~F.isnan("_v") & F.col("_v").isNotNull())
    # sketch error, and one rank for the difference between its ranks and interpolated positions
    slack = 4.0 / accuracy
    whole = F.col("_n") <= accuracy // 2
    low = [max(0.0, p - slack) for p in probs]
    high = [min(1.0, p + slack) for p in probs]
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", low, accuracy).alias("_lo"),
        F.percentile_approx("_v", high, accuracy).alias("_hi"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.count(F.lit(1)).alias("_n"),
    )
    sketch = checkpoint(sketch)
    wanted = sketch.select(
        *keys,
        "_n",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(p).alias("p"),
                        (F.lit(p) * (F.col("_n") - 1)).alias("pos"),
                        (F.col("_min") if low[i] == 0.0 else F.when(whole, F.col("_min")).otherwise(F.col("_lo")[i])).alias("lo"),
                        (F.col("_max") if high[i] == 1.0 else F.when(whole, F.col("_max")).otherwise(F.col("_hi")[i])).alias("hi"),
                    )
                    for i, p in enumerate(probs)
                ]
            )
        ).alias("w"),
    ).select(*keys, "w.*")
    brackets = wanted.groupBy(*keys).agg(F.collect_list(F.struct("p", "lo", "hi")).alias("_w"))
    # few groups go to the rows: sorted by key, all rows of a large group would meet in one task
    few = not keys or fits_broadcast(sketch, 64 * (len(probs) + len(keys) + 1), BROADCAST_LIMIT)
    told = F.broadcast(brackets) if few else brackets
    held = rows.join(told, keys) if keys else rows.join(told)
    # one row per (group, probability, kept value); values below a bracket collapse into one counted row
    tagged = held.select(*keys, "_v", F.explode("_w").alias("w")).where(F.col("_v") <= F.col("w.hi"))
    counted = (
        tagged.select(
            *keys, F.col("w.p").alias("p"), F.when(F.col("_v") >= F.col("w.lo"), F.col("_v")).alias("_v")
        )
        .groupBy(*keys, "p", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    cum = running(counted, [*keys, "p"], ["_v"], {"_upto": F.col("_c")}, rank=None)
    positions = wanted.select(*keys, "p", "pos")
    joined = cum.join(positions, [*keys, "p"])
    lower, upper = F.floor("pos"), F.ceil("pos")
    before = F.col("_upto") - F.col("_c")
    inside = F.col("_v").isNotNull()
    picked = joined.groupBy(*keys, "p").agg(
        F.max("pos").alias("pos"),
        F.max(F.when(inside & (before <= lower) & (lower < F.col("_upto")), F.col("_v"))).alias("_a"),
        F.max(F.when(inside & (before <= upper) & (upper < F.col("_upto")), F.col("_v"))).alias("_b"),
    )
    exact = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("pos") - F.floor("pos"))
    missed = F.raise_error(F.lit("percentile bracket missed its rank; raise accuracy"))
    return picked.select(
        *keys, "p", F.when(F.col("_a").isNull() | F.col("_b").isNull(), missed.cast("double")).otherwise(exact).alias("q")
    )
