"""Exact choices by hash order: seeded shuffles, samples of a fixed size, splits.

Rows are ordered by a digest of (seed, id). Digests spread evenly, so their leading hex digits cut any table, or any
hot group, into equal buckets: a small table of bucket counts gives the offsets and no task sees more than a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import draws
from .ordered import match


def hash_ranked(
    df: DataFrame,
    seed,
    ids: Sequence[str],
    part: Sequence[str] = (),
    name: str = "rank",
    digits: int = 3,
    hashed: Column | None = None,
) -> DataFrame:
    """1-based rank along the digest of ``seed:ids`` within ``part``."""
    part = list(part)
    keyed = df.withColumn("_h", hashed if hashed is not None else draws.digest(seed, *[F.col(c) for c in ids]))
    keyed = keyed.withColumn("_b", F.substring("_h", 1, digits))
    before = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*part, "_b")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(*part, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    )
    inside = Window.partitionBy(*part, "_b").orderBy("_h", *ids)
    ranked = keyed.withColumn(name, F.row_number().over(inside).cast("bigint"))
    joined = match(ranked, offsets, [*part, "_b"])  # null is a part of its own
    return joined.withColumn(name, F.col(name) + F.col("_o")).drop("_h", "_b", "_o")


def take_hashed(df: DataFrame, seed, ids: Sequence[str], n: int, digits: int = 3) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), chosen by hash order: whole buckets pass, only the last is ranked."""
    keyed = df.withColumn("_h", draws.digest(seed, *[F.col(c) for c in ids]))
    keyed = keyed.withColumn("_b", F.substring("_h", 1, digits))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        keyed.groupBy("_b")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .where(F.col("_o") < n)
    )
    joined = keyed.join(F.broadcast(edges), "_b")
    whole = joined.where(F.col("_o") + F.col("_c") <= n)
    partly = joined.where(F.col("_o") + F.col("_c") > n).withColumn(
        "_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", *ids))
    )
    kept = partly.where(F.col("_o") + F.col("_r") <= n).drop("_r")
    return whole.unionByName(kept).drop("_h", "_b", "_o", "_c")
