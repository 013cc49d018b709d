"""Ranks, running sums and lags over groups of any size.

A plain window puts each group into one task. Here groups above ``hot_rows`` are first cut into ranges of the ordering
value (bounds from a sample, the cut rows stored so that reruns agree); the window then runs inside a range
and a small per-range summary carries the state across ranges. Groups below the limit take the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint

HOT_ROWS = 4_000_000
#: Ranges that hot groups are cut into, as long as a range stays far below HOT_ROWS: each is a task, a file and a sample.
MOST_RANGES = 512


def with_ranges(
    df: DataFrame, part: Sequence[str], order: Sequence[Column | str], hot_rows: int | None = HOT_ROWS
) -> tuple[DataFrame, bool]:
    """Add ``_range``: 0 for ordinary groups, else the range along ``order`` of a group above ``hot_rows``; and whether
    any group was cut. Null is a group of its own.

    Ranges are those of a range partitioning by (part, order), whatever the type of the columns, about half of
    ``hot_rows`` rows each, or larger beyond MOST_RANGES of them (but not above half of HOT_ROWS); they are stored, since their bounds come from a sample. ``hot_rows=None`` skips the count
    for callers whose groups are bounded.
    """
    if hot_rows is None:
        return df.withColumn("_range", F.lit(0)), False
    part = list(part)
    hot = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > hot_rows)
    total = hot.agg(F.sum("_c")).first()[0]
    if total is None:
        return df.withColumn("_range", F.lit(0)), False
    marked, rest = df, None
    if part:
        named = F.broadcast(hot.select(*[F.col(c).alias(f"_k_{c}") for c in part]))  # at most rows / hot_rows groups
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in part])
        marked, rest = df.join(named, same, "left_semi"), df.join(named, same, "left_anti")
    pieces = min(int(2 * total // hot_rows) + 2, max(MOST_RANGES, int(2 * total // HOT_ROWS) + 2))
    cut = checkpoint(marked.repartitionByRange(pieces, *part, *order).withColumn("_range", F.spark_partition_id() + 1))
    return (cut if rest is None else rest.withColumn("_range", F.lit(0)).unionByName(cut)), True


def running(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
    rank: str | None = "rank",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Row number (1-based) and inclusive running sums along ``order`` within ``part``.

    ``order`` must be unique within a group.
    """
    part = list(part)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    values = dict(sums)
    if rank:
        values[rank] = F.lit(1).cast("bigint")
    cut, split = with_ranges(df, part, order, hot_rows)
    cut = cut.withColumns({f"_v_{n}": v for n, v in values.items()})
    inside = Window.partitionBy(*part, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in values})
    if not split:
        return out.drop("_range", *[f"_v_{n}" for n in values])
    before = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*part, "_range")
        .agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in values])
        .select(*part, "_range", *[F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    )
    joined = match(out, offsets, [*part, "_range"])
    for n in values:
        joined = joined.withColumn(n, F.col(n) + F.col(f"_o_{n}"))
    return joined.drop("_range", *[f"_v_{n}" for n in values], *[f"_o_{n}" for n in values])


def ranked(df, part, order, name="rank", hot_rows=HOT_ROWS) -> DataFrame:
    return running(df, part, order, {}, rank=name, hot_rows=hot_rows)


def lagged(
    df: DataFrame,
    part: Sequence[str],
    order: str,
    columns: Mapping[str, str],
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Value of the previous row along ``order`` within ``part``: ``{new column: source column}``."""
    part = list(part)
    cut, split = with_ranges(df, part, [order], hot_rows)
    inside = Window.partitionBy(*part, "_range").orderBy(order)
    out = cut.withColumns({new: F.lag(src).over(inside) for new, src in columns.items()})
    if not split:
        return out.drop("_range")
    across = Window.partitionBy(*part).orderBy("_range")
    tail = cut.groupBy(*part, "_range").agg(
        F.max_by(F.struct(*[F.col(s).alias(n) for n, s in columns.items()]), F.col(order)).alias("_tail"),
        F.min(order).alias("_first"),
    )
    tail = tail.withColumn("_prev", F.lag("_tail").over(across)).drop("_tail")
    joined = match(out, tail, [*part, "_range"])
    first = F.col(order) == F.col("_first")
    for new in columns:
        joined = joined.withColumn(new, F.when(first, F.col(f"_prev.{new}")).otherwise(F.col(new)))
    return joined.drop("_range", "_first", "_prev")


def match(rows: DataFrame, per_range: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys in which null equals null."""
    condition = None
    renamed = per_range.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in per_range.columns])
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        condition = term if condition is None else condition & term
    return rows.join(renamed, condition).drop(*[f"_k_{k}" for k in keys])
