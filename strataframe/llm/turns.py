"""Rows of conversations in one stored global order, cut into ranges, so that no conversation has to fit into a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stash

#: Bits of a row number below the number of its range.
RANGE_BITS = 33


def numbered(df: DataFrame, order: Sequence[str | Column], ties: Sequence[str | Column], name: str, drop: Sequence[str] = ()) -> DataFrame:
    """``df`` with a column ``rid`` that grows along ``order``, then ``ties``; stored, as the ranges come from a sample.

    Ranges are cut by ``order``; rows equal in it lie in one range. ``rid >> RANGE_BITS`` is the range. Columns of
    ``drop`` serve the order only.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order, *ties)
    return stash(ranged.withColumn("rid", F.monotonically_increasing_id()).drop(*drop), name)


def turn_order(role: str = "role", text: str = "text") -> tuple[list, list]:
    """Order of turns within ``conv``: by turn (nulls first), ties by role and text; ranges see only a text's beginning."""
    return ["conv", "turn", role, F.substring(text, 1, 32)], [text]


def carried(rows: DataFrame, key: str, counts: dict[str, Column], xors: dict[str, Column]) -> DataFrame:
    """Running counts and running XORs of longs along ``rid`` within ``key``, for rows of ``numbered`` in an order that
    begins with ``key``; null is a key of its own.

    A window runs inside each part of a key that lies in one range. What earlier ranges held is added: only the first
    key of a range can have begun in an earlier one, so there is at most one such row a range.
    """
    rows = rows.withColumn("_range", F.shiftright("rid", RANGE_BITS))
    inside = Window.partitionBy(key, "_range").orderBy("rid").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.count(F.when(c, 1)).alias(n) for n, c in counts.items()]
    folds = [F.bit_xor(c).alias(n) for n, c in xors.items()]
    parts = rows.groupBy(key, "_range").agg(*sums, *folds)
    ends = parts.groupBy(key).agg(F.min("_range").alias("_first"), F.max("_range").alias("_last")).where("_first < _last")
    long = parts.join(ends, parts[key].eqNullSafe(ends[key]), "left_semi")
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = long.select(
        F.col(key).alias("_key"), F.col("_range").alias("_at"),
        *[F.sum(n).over(before).alias(f"_o_{n}") for n in counts], *[F.bit_xor(n).over(before).alias(f"_o_{n}") for n in xors],
    )
    offsets = stash(offsets.where(F.coalesce(*[F.col(f"_o_{n}") for n in [*counts, *xors]]).isNotNull()), "offsets")
    run = rows.select(
        "*", *[F.count(F.when(c, 1)).over(inside).alias(f"_r_{n}") for n, c in counts.items()],
        *[F.bit_xor(c).over(inside).alias(f"_r_{n}") for n, c in xors.items()],
    )
    met = run[key].eqNullSafe(offsets["_key"]) & (run["_range"] == offsets["_at"])
    out = run.join(F.broadcast(offsets), met, "left")  # at most one row a range
    zero = F.lit(0).cast("long")
    return out.select(
        *[c for c in rows.columns if c != "_range"],
        *[(F.col(f"_r_{n}") + F.coalesce(f"_o_{n}", zero)).alias(n) for n in counts],
        *[F.col(f"_r_{n}").bitwiseXOR(F.coalesce(f"_o_{n}", zero)).alias(n) for n in xors],
    )
