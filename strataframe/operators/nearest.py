"""Nearest neighbour in space by a grid: equality joins on cells, wider cells for the points that are still open."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint

AXES = ("x", "y", "z")
#: Target positions that a cell of the first round holds, on average.
PER_CELL = 4


def _cell_size(extents: list[float], cells: float) -> float:
    """Edge of cubes of which about so many fill a box."""
    high = max(extents)
    if high <= 0:
        return 1.0
    low = high * 1e-9
    for _ in range(60):
        middle = math.sqrt(low * high)
        if math.prod(max(1.0, e / middle) for e in extents) > cells:
            low = middle
        else:
            high = middle
    return high


def nearest(points: DataFrame, targets: DataFrame, key: str, order: str, per_cell: int = PER_CELL) -> DataFrame:
    """``key, found``: for each point (key, x, y, z) the nearest target (order, x, y, z, …) as a struct of its columns, of
    equally near ones that with the least ``order``. Without targets the result is empty.

    A round joins each open point with the targets of its own cell and the 26 around it. Whatever lies outside is at
    least a cell's edge away, so a nearest target closer than that is final; the other points go on with cells twice as
    wide. Targets at the same place count once. Nothing is broadcast and no point meets all targets.
    """
    rest = [c for c in targets.columns if c not in (order, *AXES)]
    struct = F.struct(order, *rest)
    spots = checkpoint(targets.groupBy(*[F.col(a).cast("double").alias(a) for a in AXES]).agg(F.min(struct).alias("_t")))
    ends = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))]
    box = spots.agg(F.count(F.lit(1)).alias("n"), *ends).first()
    found_kind = targets.select(F.struct(order, *rest, *AXES).alias("found"))
    if not box["n"]:
        return points.select(key).limit(0).join(found_kind.limit(0))
    wide = points.agg(*ends).first()
    low, high = ({a: min(pick * r[f"{n}_{a}"] for r in (box, wide) if r[f"{n}_{a}"] is not None) * pick for a in AXES} for n, pick in (("low", 1), ("high", -1)))
    reach = math.dist(list(low.values()), list(high.values()))
    edge = _cell_size([box[f"high_{a}"] - box[f"low_{a}"] for a in AXES], max(1.0, box["n"] / per_cell))
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"_d{a}") for a, v in zip(AXES, (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    cell = lambda a: F.floor((F.col(a) - low[a]) / edge)
    left, done = checkpoint(points.select(key, *[F.col(a).cast("double").alias(a) for a in AXES])), None
    while True:
        near = left.select(key, *[F.col(a).alias(f"_{a}") for a in AXES], F.inline(steps), *[cell(a).alias(f"_c{a}") for a in AXES])
        near = near.select(key, *[f"_{a}" for a in AXES], *[(F.col(f"_c{a}") + F.col(f"_d{a}")).alias(f"_c{a}") for a in AXES])
        there = spots.select("_t", *AXES, *[cell(a).alias(f"_c{a}") for a in AXES])
        square = sum(((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in AXES[1:]), (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")))
        met = near.join(there, [f"_c{a}" for a in AXES]).select(key, F.struct(square.alias("d2"), F.col(f"_t.{order}").alias("o"), "_t", *AXES).alias("_m"))
        best = met.groupBy(key).agg(F.min_by("_m", F.struct("_m.d2", "_m.o")).alias("_m"))
        last = edge > reach
        state = checkpoint(left.join(best, key, "left").withColumn("_ok", F.coalesce(F.col("_m.d2") < edge * edge, F.lit(False)) | F.lit(last)))
        final = state.where("_ok").select(key, F.struct(F.col(f"_m._t.{order}").alias(order), *[F.col(f"_m._t.{c}").alias(c) for c in rest], *[F.col(f"_m.{a}").alias(a) for a in AXES]).alias("found"))
        done = final if done is None else done.unionByName(final)
        left = state.where("not _ok").select(key, *AXES)
        if last or left.isEmpty():
            return done
        edge *= 2
