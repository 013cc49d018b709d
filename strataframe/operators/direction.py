"""How far subjects share one label direction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import arrays as A, draws
from ..plans.hashed import hash_ranked
from ..plans.moments import attach, cell_moments
from ..session import checkpoint


def unit_directions(
    features: DataFrame,
    subject: str = "subject_id",
    label: str = "label",
    min_rows: int = 2,
    eps: float = 1e-12,
    by: Sequence[str] = (),
    vec: str = "x",
) -> DataFrame:
    """``subject, d, magnitude``: unit vector from the label-0 mean to the label-1 mean, for subjects with ``min_rows``
    rows of each label and a difference longer than ``eps``."""
    cells = cell_moments(features.where(F.col(label).isin(0, 1)), [*by, subject, label], vec)
    cells = cells.where(F.col("n") >= min_rows)
    sides = cells.groupBy(*by, subject).agg(
        F.max_by("mean", -F.col(label)).alias("low"), F.max_by("mean", label).alias("high"), F.count(F.lit(1)).alias("k")
    )
    diff = sides.where(F.col("k") == 2).select(*by, subject, A.subtract(F.col("high"), F.col("low")).alias("diff"))
    sized = diff.withColumn("magnitude", A.norm(F.col("diff"))).where(F.col("magnitude") > eps)
    return sized.select(*by, subject, A.scale(F.col("diff"), 1.0 / F.col("magnitude")).alias("d"), "magnitude")


def pooled_directions(
    features: DataFrame,
    recording: str = "recording_id",
    subject: str = "subject_id",
    label: str = "label",
    vec: str = "x",
) -> DataFrame:
    """Directions from recordings pooled first, one recording per label being enough."""
    pooled = cell_moments(features, [recording, subject, label], vec).select(subject, label, F.col("mean").alias("x"))
    return unit_directions(pooled, subject, label, min_rows=1, eps=0.0)


# ---- median pairwise cosine --------------------------------------------------------------------------------------------


def _tiles(directions: DataFrame, subject: str, rows: int, tile: int) -> DataFrame:
    """Rows of every pair of tiles: each direction goes once to the tiles it meets, as left or right side."""
    n_tiles = max(1, -(-rows // tile))
    tagged = directions.select(
        F.col(subject).alias("id"), "d", F.pmod(F.xxhash64(subject), F.lit(n_tiles)).cast("int").alias("t")
    )
    every = F.sequence(F.lit(0), F.lit(n_tiles - 1))
    left = tagged.select("id", "d", F.lit(0).alias("side"), "t", F.explode(F.filter(every, lambda o: o >= F.col("t"))).alias("o"))
    right = tagged.select("id", "d", F.lit(1).alias("side"), "t", F.explode(F.filter(every, lambda o: o < F.col("t"))).alias("o"))
    return left.select("id", "d", "side", F.col("t").alias("a"), F.col("o").alias("b")).unionByName(
        right.select("id", "d", "side", F.col("o").alias("a"), F.col("t").alias("b"))
    )


def _tile_cosines(pdf: pd.DataFrame) -> np.ndarray:
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if pdf["a"].iloc[0] == pdf["b"].iloc[0]:
        m = np.stack(left["d"].to_numpy())
        return (m @ m.T)[np.triu_indices(len(m), k=1)]
    if not len(left) or not len(right):
        return np.zeros(0)
    return (np.stack(left["d"].to_numpy()) @ np.stack(right["d"].to_numpy()).T).ravel()


def _order_statistics(tiles: DataFrame, ranks: list[int], bins: int, passes: int) -> dict[int, float]:
    """Values at the given 0-based ranks among all tile cosines, by counting into ever finer bins.

    A tile emits bin counts, never pairs. After ``passes`` the bins are narrower than 2 / bins**passes.
    """
    spans = {r: (-1.0 - 1e-9, 1.0 + 1e-9, r) for r in ranks}
    for _ in range(passes):
        wanted = sorted({(lo, hi) for lo, hi, _ in spans.values()})

        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            values = _tile_cosines(pdf)
            out = []
            for s, (lo, hi) in enumerate(wanted):
                cell = np.floor((values[(values >= lo) & (values < hi)] - lo) / (hi - lo) * bins).astype(int)
                c, n = np.unique(np.clip(cell, 0, bins - 1), return_counts=True)
                out.append(pd.DataFrame({"s": s, "c": c, "n": n}))
            return pd.concat(out)

        rows = (
            tiles.groupBy("a", "b").applyInPandas(count, "s int, c int, n long").groupBy("s", "c").agg(F.sum("n").alias("n"))
        ).collect()
        hist = {s: np.zeros(bins, dtype=np.int64) for s in range(len(wanted))}
        for r in rows:
            hist[r["s"]][r["c"]] = r["n"]
        for rank, (lo, hi, inside) in spans.items():
            upto = np.cumsum(hist[wanted.index((lo, hi))])
            cell = int(np.searchsorted(upto, inside, side="right"))
            step = (hi - lo) / bins
            spans[rank] = (lo + cell * step, lo + (cell + 1) * step, inside - (int(upto[cell - 1]) if cell else 0))
    return {rank: (lo + hi) / 2.0 for rank, (lo, hi, _) in spans.items()}


def direction_consistency(
    directions: DataFrame, subject: str = "subject_id", tile: int = 4096, bins: int = 1 << 14
) -> DataFrame:
    """Median and quartiles of the pairwise cosines of unit directions; NaN below two subjects.

    Tiles return counts only and the order statistics are found by refinement, to far below the last reported digit.
    """
    spark = directions.sparkSession
    rows = directions.count()
    if rows < 2:
        return spark.createDataFrame(
            [(float("nan"), float("nan"), float("nan"), rows)],
            "c_bar double, iqr_low double, iqr_high double, n_subjects_paired long",
        )
    tiles = _tiles(checkpoint(directions), subject, rows, tile)  # read by every pass
    pairs = rows * (rows - 1) // 2
    points = {p: p * (pairs - 1) for p in (0.25, 0.5, 0.75)}
    ranks = sorted({int(np.floor(v)) for v in points.values()} | {int(np.ceil(v)) for v in points.values()})
    found = _order_statistics(tiles, ranks, bins, 3)

    def at(p):
        lo, hi = int(np.floor(points[p])), int(np.ceil(points[p]))
        return found[lo] + (found[hi] - found[lo]) * (points[p] - lo)

    return spark.createDataFrame(
        [(at(0.5), at(0.25), at(0.75), rows)],
        "c_bar double, iqr_low double, iqr_high double, n_subjects_paired long",
    )


def direction_consistency_by(directions: DataFrame, by: str, subject: str = "subject_id", tile: int = 4096, bins: int = 1 << 14) -> DataFrame:
    """``direction_consistency`` of every data set ``by`` in the same passes: ``by, c_bar, iqr_low, iqr_high,
    n_subjects_paired``, NaN below two subjects. The driver holds a histogram of the open bins for each data set."""
    spark = directions.sparkSession
    directions = checkpoint(directions.select(by, subject, "d"))
    sizes = [(r[0], int(r["n"])) for r in directions.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()]
    kind = directions.schema[by]
    numbers = spark.createDataFrame(
        [(name, g, max(1, -(-n // tile))) for g, (name, n) in enumerate(sizes)], T.StructType([kind]).add("g", "integer").add("_tiles", "integer")
    ).withColumnRenamed(by, "_by")
    tagged = directions.join(F.broadcast(numbers), directions[by].eqNullSafe(F.col("_by"))).select(
        "g", F.col(subject).alias("id"), "d", "_tiles", F.pmod(F.xxhash64(subject), F.col("_tiles").cast("long")).cast("int").alias("t")
    )
    every = F.sequence(F.lit(0), F.col("_tiles") - 1)
    left = tagged.select("g", "id", "d", F.lit(0).alias("side"), F.col("t").alias("a"), F.explode(F.filter(every, lambda o: o >= F.col("t"))).alias("b"))
    right = tagged.select("g", "id", "d", F.lit(1).alias("side"), F.explode(F.filter(every, lambda o: o < F.col("t"))).alias("a"), F.col("t").alias("b"))
    tiles = left.unionByName(right)
    points, spans = {}, {}
    for g, (_, n) in enumerate(sizes):
        if n >= 2:
            points[g] = {p: p * (n * (n - 1) // 2 - 1) for p in (0.25, 0.5, 0.75)}
            for v in points[g].values():
                for rank in (int(np.floor(v)), int(np.ceil(v))):
                    spans[g, rank] = (-1.0 - 1e-9, 1.0 + 1e-9, rank)
    for _ in range(3):
        wanted = {g: sorted({x[:2] for (of, _), x in spans.items() if of == g}) for g in points}

        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            g, out = int(pdf["g"].iloc[0]), [pd.DataFrame({"g": [], "s": [], "c": [], "n": []})]
            values = _tile_cosines(pdf) if g in wanted else np.zeros(0)
            for s, (lo, hi) in enumerate(wanted.get(g, ())):
                cell = np.floor((values[(values >= lo) & (values < hi)] - lo) / (hi - lo) * bins).astype(int)
                c, n = np.unique(np.clip(cell, 0, bins - 1), return_counts=True)
                out.append(pd.DataFrame({"g": g, "s": s, "c": c, "n": n}))
            return pd.concat(out)

        counted = tiles.groupBy("g", "a", "b").applyInPandas(count, "g int, s int, c int, n long").groupBy("g", "s", "c").agg(F.sum("n").alias("n"))
        hist: dict[tuple[int, int], list] = {}
        for r in counted.collect():
            hist.setdefault((r["g"], r["s"]), []).append((r["c"], r["n"]))
        for (g, rank), (lo, hi, inside) in spans.items():
            cells, n = (np.array(x) for x in zip(*sorted(hist[g, wanted[g].index((lo, hi))])))
            upto = np.cumsum(n)
            at = int(np.searchsorted(upto, inside, side="right"))
            step = (hi - lo) / bins
            spans[g, rank] = (lo + cells[at] * step, lo + (cells[at] + 1) * step, inside - int(upto[at] - n[at]))

    def value(g: int, p: float) -> float:
        if g not in points:
            return float("nan")
        at = points[g][p]
        low, high = (sum(spans[g, int(r)][:2]) / 2.0 for r in (np.floor(at), np.ceil(at)))
        return float(low + (high - low) * (at - np.floor(at)))

    rows = [(name, value(g, 0.5), value(g, 0.25), value(g, 0.75), n) for g, (name, n) in enumerate(sizes)]
    schema = T.StructType([kind])
    for name in ("c_bar", "iqr_low", "iqr_high"):
        schema = schema.add(name, "double")
    return spark.createDataFrame(rows, schema.add("n_subjects_paired", "long"))


# ---- mean pairwise cosine: closed form, no pairs -------------------------------------------------------------------------


def mean_cosine(directions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean pairwise cosine as (|sum d|^2 - S) / (S (S - 1))."""
    by = list(by)
    sums = directions.groupBy(*by).agg(
        Summarizer.metrics("sum").summary(array_to_vector("d")).alias("s"), F.count(F.lit(1)).alias("n_subjects")
    )
    s2 = A.sum_squares(vector_to_array("s.sum"))
    n = F.col("n_subjects").cast("double")
    value = F.when(F.col("n_subjects") >= 2, (s2 - n) / (n * (n - 1.0))).otherwise(float("nan"))
    return sums.select(*by, value.alias("mean_cosine"), "n_subjects")


def mean_cosine_interval(
    directions: DataFrame, n_boot: int = 2000, seed: int = 0, subject: str = "subject_id"
) -> DataFrame:
    """Mean pairwise cosine with a bootstrap over subjects; draws that hit one subject only are skipped.

    A repeated subject contributes its own pairs at cosine 1, as in a resampled array.
    """
    n_subjects = directions.count()
    position = hash_ranked(directions, "position", [subject], name="pos").select("pos", "d")
    picks = (
        directions.sparkSession.range(n_boot * n_subjects)
        .select((F.floor(F.col("id") / n_subjects) + 1).cast("int").alias("boot"), (F.col("id") % n_subjects).alias("i"))
        .select("boot", (draws.below(draws.digest(seed, F.col("boot"), F.col("i")), F.lit(n_subjects)) + 1).alias("pos"))
        .groupBy("boot", "pos")
        .agg(F.count(F.lit(1)).cast("double").alias("mult"))
        .groupBy("pos")
        .agg(F.collect_list(F.struct("boot", "mult")).alias("reps"))
    )

    def partial(batches):
        acc, distinct = None, np.zeros(n_boot + 1)
        for pdf in batches:
            for start in range(0, len(pdf), 512):
                part = pdf.iloc[start : start + 512]
                weights = np.zeros((n_boot + 1, len(part)))
                for j, reps in enumerate(part["reps"]):
                    for r in reps:
                        weights[r["boot"], j] += r["mult"]
                product = weights @ np.stack(part["d"].to_numpy())
                acc = product if acc is None else acc + product
                distinct += (weights > 0).sum(axis=1)
        if acc is not None:
            yield pd.DataFrame({"boot": np.arange(n_boot + 1), "s": list(acc), "distinct": distinct})

    sums = position.join(picks, "pos").select("d", "reps").mapInPandas(partial, "boot long, s array<double>, distinct double")
    n = float(n_subjects)
    draws_df = (
        sums.groupBy("boot")
        .agg(Summarizer.metrics("sum").summary(array_to_vector("s")).alias("s"), F.sum("distinct").alias("distinct"))
        .where((F.col("distinct") >= 2) & (F.col("boot") > 0))
        .select(((A.sum_squares(vector_to_array("s.sum")) - n) / (n * (n - 1.0))).alias("v"))
    )
    interval = draws_df.agg(
        F.percentile("v", 0.025).alias("ci_low"), F.percentile("v", 0.975).alias("ci_high"), F.count("v").alias("n_valid")
    )
    return attach(mean_cosine(directions), interval)


def subject_angles(directions: DataFrame, subject: str = "subject_id", by: Sequence[str] = ()) -> DataFrame:
    """Angle in degrees between each subject's direction and the normalised mean direction."""
    by = list(by)
    mean = directions.groupBy(*by).agg(Summarizer.metrics("mean").summary(array_to_vector("d")).alias("m"))
    mean = mean.select(*by, A.unit(vector_to_array("m.mean"), 1e-12).alias("_consensus"))
    cos = F.least(F.greatest(A.dot(F.col("d"), F.col("_consensus")), F.lit(-1.0)), F.lit(1.0))
    return attach(directions, mean, by).select(*by, subject, F.degrees(F.acos(cos)).alias("angle"))


def contrast_snr(directions: DataFrame, by: Sequence[str] = (), ddof: int = 0) -> DataFrame:
    """Mean, spread and mean/spread of the per-subject contrast magnitude."""
    spread = F.stddev_pop("magnitude") if ddof == 0 else F.stddev_samp("magnitude")
    return directions.groupBy(*by).agg(
        F.avg("magnitude").alias("mean_diff_mag"),
        spread.alias("std_diff_mag"),
        F.try_divide(F.avg("magnitude"), spread).alias("snr"),
        F.count(F.lit(1)).alias("n_subj"),
    )
