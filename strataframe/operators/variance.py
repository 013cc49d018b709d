"""Where the variance of a feature table sits: by label, by subject, within subjects.

All operators take rows ``(subject, label, x array)`` and reduce them to cells once; ``by`` adds grouping columns
(data set, depth, ...), so a sweep over many tables is one job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import arrays as A, draws
from ..functions.scalars import excess_ratio, floor_ratio
from ..plans.moments import attach, cell_moments, gram, mean_vector, pool
from ..plans.ordered import ranked
from ..session import checkpoint


# ---- crossed sums of squares ---------------------------------------------------------------------------------------


def crossed_ss(
    features: DataFrame, subject: str = "subject_id", label: str = "label", by: Sequence[str] = (), vec: str = "x"
) -> DataFrame:
    """Label and subject sums of squares, each against the grand mean, as fractions of the total (ratio of sums over
    dimensions). The two overlap when labels are nested in subjects; the residual is then clipped at 0 and flagged."""
    return crossed_from_cells(cell_moments(features, [*by, subject, label], vec), subject, label, by)


def crossed_from_cells(cells: DataFrame, subject: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    levels = cells.select(
        *by,
        "n",
        "mean",
        "within",
        F.explode(
            F.array(
                F.struct(F.lit("label").alias("factor"), F.col(label).cast("string").alias("level")),
                F.struct(F.lit("subject").alias("factor"), F.col(subject).cast("string").alias("level")),
            )
        ).alias("f"),
    ).select(*by, "n", "mean", "within", "f.factor", "f.level")
    margins = pool(levels, [*by, "factor", "level"])
    margins = margins.withColumn("within", A.add(F.col("within"), F.col("between")))
    factors = pool(margins, [*by, "factor"])
    scalar = factors.select(
        *by,
        "factor",
        "n",
        "n_cells",
        A.total(F.col("between")).alias("ss"),
        (A.total(F.col("between")) + A.total(F.col("within"))).alias("total"),
    )
    wide = scalar.groupBy(*by).agg(
        F.max("n").alias("n_rows"),
        F.max(F.when(F.col("factor") == "subject", F.col("n_cells"))).alias("n_subjects"),
        F.max(F.when(F.col("factor") == "label", F.col("n_cells"))).alias("n_labels"),
        F.max(F.when(F.col("factor") == "label", F.col("total"))).alias("ss_total"),
        F.max(F.when(F.col("factor") == "label", F.col("ss"))).alias("ss_label"),
        F.max(F.when(F.col("factor") == "subject", F.col("ss"))).alias("ss_subject"),
    )
    return _fractions(wide)


def _fractions(wide: DataFrame) -> DataFrame:
    shared = F.col("label_frac") + F.col("subject_frac")
    return (
        wide.withColumn("label_frac", floor_ratio(F.col("ss_label"), F.col("ss_total"), 1e-18))
        .withColumn("subject_frac", floor_ratio(F.col("ss_subject"), F.col("ss_total"), 1e-18))
        .withColumn("residual_frac", F.greatest(1.0 - shared, F.lit(0.0)))
        .withColumn("raw_sum_exceeds_one", shared > 1.0 + 1e-9)
    )


# ---- nested sums of squares ----------------------------------------------------------------------------------------


def pure_cells(
    features: DataFrame, subject: str = "subject_id", label: str = "label", by: Sequence[str] = (), vec: str = "x"
) -> DataFrame:
    """Subject cells, each with its one label; a subject with two labels fails the job."""
    cells = cell_moments(
        features, [*by, subject], vec, extra=[F.min(label).alias("_low"), F.max(label).alias("_high")]
    )
    message = F.concat(F.lit("subject "), F.col(subject).cast("string"), F.lit(" has more than one label"))
    kind = features.schema[label].dataType
    checked = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.raise_error(message).cast(kind))
    return cells.withColumn(label, checked).drop("_low", "_high")


def nested_ss(
    features: DataFrame, subject: str = "subject_id", label: str = "label", by: Sequence[str] = (), vec: str = "x"
) -> DataFrame:
    """Additive decomposition with subjects nested in labels: one row with a vector per component and the degrees of
    freedom. ``ss_label + ss_subject + ss_residual = ss_total`` in every dimension."""
    return nested_from_cells(pure_cells(features, subject, label, by, vec), label, by)


def nested_from_cells(cells: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    labels = pool(cells, [*by, label], sums=["within"])
    labels = labels.withColumnRenamed("n_cells", "n_subjects").withColumnRenamed("between", "swl")
    top = pool(labels, by, sums=["within", "swl"], counts=["n_subjects"])
    return top.select(
        *by,
        F.col("between").alias("ss_label"),
        F.col("swl").alias("ss_subject"),
        F.col("within").alias("ss_residual"),
        A.add(A.add(F.col("between"), F.col("swl")), F.col("within")).alias("ss_total"),
        (F.col("n_cells") - 1).alias("df_label"),
        (F.col("n_subjects") - F.col("n_cells")).alias("df_subject"),
        (F.col("n") - F.col("n_subjects")).alias("df_residual"),
        F.col("n").alias("n_rows"),
        "n_subjects",
    )


def per_dimension(nested: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per dimension of a nested decomposition."""
    vectors = ["ss_label", "ss_subject", "ss_residual", "ss_total"]
    rest = [c for c in nested.columns if c not in vectors]
    return nested.select(*rest, F.posexplode(F.arrays_zip(*vectors)).alias("dim", "_z")).select(*rest, "dim", "_z.*")


def omega_squared(nested: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bias-corrected effect sizes, clipped at 0 per dimension and averaged over dimensions; plain fractions beside."""
    dims = per_dimension(nested, by)
    too_few = F.raise_error(F.lit("no residual degrees of freedom: not enough rows per subject")).cast("double")
    ms = F.when(F.col("df_residual") > 0, F.col("ss_residual") / F.col("df_residual")).otherwise(too_few)
    dims = dims.withColumn("ms", ms)

    def effect(ss: str, df: str):
        return F.greatest(
            floor_ratio(F.col(ss) - F.col(df) * F.col("ms"), F.col("ss_total") + F.col("ms"), 1e-12), F.lit(0.0)
        )

    averaged = dims.groupBy(*by).agg(
        F.avg(effect("ss_label", "df_label")).alias("omega2_label"),
        F.avg(effect("ss_subject", "df_subject")).alias("omega2_subject"),
        F.avg(floor_ratio(F.col("ss_label"), F.col("ss_total"), 1e-12)).alias("frac_label"),
        F.avg(floor_ratio(F.col("ss_subject"), F.col("ss_total"), 1e-12)).alias("frac_subject"),
        F.avg(floor_ratio(F.col("ss_residual"), F.col("ss_total"), 1e-12)).alias("frac_residual"),
    )
    return averaged.withColumn(
        "subject_to_label", floor_ratio(F.col("omega2_subject"), F.col("omega2_label"), 1e-9)
    )


# ---- variance components -------------------------------------------------------------------------------------------


def variance_components(
    features: DataFrame,
    subject: str = "subject_id",
    label: str = "label",
    by: Sequence[str] = (),
    vec: str = "x",
    max_dims: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Random intercept per subject with a fixed numeric label, per dimension, by the ANOVA method of moments.

    With the slope b of the label from the cell means: sigma2_label = b^2 var(label); sigma2_subject =
    max((MS_subject|label - MS_residual) / n0, 0); sigma2_residual = MS_residual. For balanced data with two labels and a
    positive estimate these are the REML values; for unbalanced data they are a consistent alternative.
    Returns one row of means over dimensions, with the mean and median intraclass correlation.
    """
    by = list(by)
    cells = pure_cells(features, subject, label, by, vec)
    y = F.col(label).cast("double")
    cells = cells.withColumn("_n2", F.col("n").cast("double") * F.col("n")).withColumn("_y", y)
    sizes = cells.groupBy(*by, label).agg(F.sum("_n2").alias("_n2"), F.sum("n").alias("n_l"))
    n0 = sizes.groupBy(*by).agg(
        F.sum("n_l").alias("_N"),
        F.sum(F.col("_n2") / F.col("n_l")).alias("_within_n2"),
        (F.sum(F.col("n_l") * F.col(label)) / F.sum("n_l")).alias("_ybar"),
        F.sum(F.col("n_l") * F.col(label).cast("double") * F.col(label)).alias("_yy"),
    )
    # the slope of the label per dimension: weighted cross moments of the label means
    labels = pool(cells, [*by, label], sums=["within"]).withColumnRenamed("between", "swl")
    centred = labels.join(n0, by) if by else attach(labels, n0)
    dev = F.col(label).cast("double") - F.col("_ybar")
    centred = centred.withColumn("_xy", A.scale(F.col("mean"), F.col("n") * dev))
    slope = centred.groupBy(*by).agg(
        Summarizer.metrics("sum").summary(array_to_vector("_xy")).alias("_s"), F.sum(F.col("n") * dev * dev).alias("syy")
    )
    slope = slope.select(*by, vector_to_array("_s.sum").alias("sxy"), "syy")
    nested = nested_from_cells(cells.drop("_n2", "_y"), label, by)
    joined = nested.join(n0, by).join(slope, by) if by else attach(attach(nested, n0), slope)
    dims = joined.select(
        *by,
        "df_subject",
        "df_residual",
        "syy",
        "_N",
        "_within_n2",
        F.posexplode(F.arrays_zip("ss_subject", "ss_residual", "sxy")).alias("dim", "_z"),
    ).select("*", "_z.*")
    if max_dims is not None:
        kept = Window.partitionBy(*by).orderBy(draws.digest(seed, F.col("dim")), "dim")
        dims = dims.withColumn("_r", F.row_number().over(kept)).where(F.col("_r") <= max_dims)
    ms_r = F.col("ss_residual") / F.col("df_residual")
    ms_s = F.col("ss_subject") / F.col("df_subject")
    n_eff = (F.col("_N") - F.col("_within_n2")) / F.col("df_subject")
    beta = F.when(F.col("syy") > 0, F.col("sxy") / F.col("syy")).otherwise(0.0)
    dims = dims.select(
        *by,
        F.greatest((ms_s - ms_r) / n_eff, F.lit(0.0)).alias("vs"),
        (beta * beta * F.col("syy") / F.col("_N")).alias("vl"),
        ms_r.alias("vr"),
    ).where(F.col("vs") + F.col("vr") > 1e-12)
    icc = F.col("vs") / (F.col("vs") + F.col("vr"))
    total = F.col("vs") + F.col("vl") + F.col("vr")
    return dims.groupBy(*by).agg(
        F.avg(icc).alias("icc_subject_mean"),
        F.percentile(icc, 0.5).alias("icc_subject_median"),
        F.avg("vs").alias("var_subject_mean"),
        F.avg("vl").alias("var_label_mean"),
        F.avg("vr").alias("var_residual_mean"),
        F.avg(floor_ratio(F.col("vs"), total, 1e-12)).alias("frac_subject_mean"),
        F.avg(floor_ratio(F.col("vl"), total, 1e-12)).alias("frac_label_mean"),
        F.avg(floor_ratio(F.col("vr"), total, 1e-12)).alias("frac_residual_mean"),
        floor_ratio(F.avg("vs"), F.avg("vl"), 1e-12).alias("subject_to_label"),
        F.count(F.lit(1)).alias("n_dims"),
    )


# ---- resampled sums: the shared kernel of bootstrap and permutation ---------------------------------------------------


def _replicate_sums(cells: DataFrame, vectors: Sequence[str], scalars: Sequence[str], n_reps: int, width: int):
    """Weighted sums of cell vectors and scalars per (replicate, group).

    ``cells`` carries ``slot array<int>`` (replicate * width + group) and ``mult array<double>``, at most one entry per
    replicate. Inside a task this is one matrix product per batch; a task emits one row per (replicate, group), merged
    by a vector sum.
    """

    def partial(batches):
        acc = None
        for pdf in batches:
            for start in range(0, len(pdf), 512):
                part = pdf.iloc[start : start + 512]
                matrix = np.hstack(
                    [np.stack(part[v].to_numpy()).astype(float) for v in vectors]
                    + [part[list(scalars)].to_numpy(dtype=float)]
                )
                slots = np.concatenate(part["slot"].to_numpy())
                column = np.repeat(np.arange(len(part)), part["slot"].map(len))
                weights = np.zeros((n_reps * width, len(part)))
                np.add.at(weights, (slots, column), np.concatenate(part["mult"].to_numpy()))
                product = weights @ matrix
                acc = product if acc is None else acc + product
        if acc is not None:
            flat = np.arange(n_reps * width)
            yield pd.DataFrame({"rep": (flat // width).astype("int32"), "g": flat % width, "s": list(acc)})

    parts = cells.select(*vectors, *scalars, "slot", "mult").mapInPandas(partial, "rep int, g long, s array<double>")
    merged = parts.groupBy("rep", "g").agg(Summarizer.metrics("sum").summary(array_to_vector("s")).alias("s"))
    return merged.select("rep", "g", vector_to_array("s.sum").alias("s"))


def _dealing(sizes: dict, n_perm: int, seed) -> tuple[list, np.ndarray, np.ndarray, int]:
    """Labels in order, upper ends of their places among all subjects, keys of the permutations, number of subjects."""
    labels = sorted(sizes)
    ends = np.cumsum([sizes[y] for y in labels])
    return labels, ends, draws.bijection_keys(seed, n_perm, int(ends[-1])), int(ends[-1])


def permutation_labels(subjects: DataFrame, n_perm: int, seed: int, subject: str = "subject_id", label: str = "label") -> DataFrame:
    """``subject, perm, label``: the multiset of subject labels dealt out anew in each permutation.

    Subjects are numbered in their order; permutation p sends the number to a place by a keyed bijection. The first c1
    places have the smallest label, the next c2 the second, and so on, with c the label counts over subjects. Any task
    can tell the label of a subject it holds in every permutation, so nothing is sorted.
    """
    sizes = {r[0]: r["c"] for r in subjects.groupBy(label).agg(F.count(F.lit(1)).alias("c")).collect()}
    labels, ends, keys, size = _dealing(sizes, n_perm, seed)
    numbered = ranked(subjects.select(subject), [], [subject], "_i")

    @F.pandas_udf("array<int>")
    def places(i: pd.Series) -> pd.Series:
        at = np.searchsorted(ends, draws.bijected(i.to_numpy() - 1, keys, size), "right")
        return pd.Series(list(at.T.astype(np.int32)))

    dealt = numbered.select(subject, F.posexplode(places("_i")).alias("perm", "code"))
    kind = subjects.schema[label].dataType
    return dealt.select(subject, (F.col("perm") + 1).alias("perm"), F.element_at(F.lit(labels), F.col("code") + 1).cast(kind).alias(label))


def _permuted_sums(subjects: DataFrame, ends: np.ndarray, keys: np.ndarray, width: int) -> DataFrame:
    """``among, a`` of every permutation from ``subjects`` (i, z: sum of standardised rows, n).

    A task works out the places of its subjects in all permutations and adds their sums up by label; what tasks hold is
    merged as arrays of a few permutations each.
    """
    n_perm, labels, size = len(keys), len(ends), int(ends[-1])
    chunk = max(1, 4096 // (labels * (width + 1)))
    shared = subjects.sparkSession.sparkContext.broadcast((ends, keys))

    def partial(batches):
        upto, held = shared.value
        acc = np.zeros((n_perm, labels, width + 1))
        for pdf in batches:
            for start in range(0, len(pdf), 512):
                part = pdf.iloc[start : start + 512]
                matrix = np.hstack([np.stack(part["z"].to_numpy()).astype(float), part[["n"]].to_numpy(float)])
                code = np.searchsorted(upto, draws.bijected(part["i"].to_numpy(), held, size), "right")
                for y in range(labels):
                    acc[:, y] += (code == y).astype(float) @ matrix
        for first in range(0, n_perm, chunk):
            yield pd.DataFrame({"first": [first], "s": [acc[first : first + chunk].ravel()]})

    def finish(batches):
        for pdf in batches:
            for s in pdf["s"]:
                s = np.asarray(s).reshape(-1, labels, width + 1)
                weight = s[..., -1]
                square = (s[..., :-1] ** 2).sum(axis=-1)
                there = weight > 0
                among = np.where(there, square / np.where(there, weight, 1.0), 0.0).sum(axis=1)
                yield pd.DataFrame({"among": among, "a": there.sum(axis=1)})

    parts = subjects.select("i", "z", "n").mapInPandas(partial, "first long, s array<double>")
    merged = parts.groupBy("first").agg(Summarizer.metrics("sum").summary(array_to_vector("s")).alias("s"))
    return merged.select(vector_to_array("s.sum").alias("s")).mapInPandas(finish, "among double, a long")


def permanova(
    features: DataFrame,
    n_perm: int = 999,
    seed: int = 0,
    subject: str = "subject_id",
    label: str = "label",
    vec: str = "x",
) -> DataFrame:
    """Multivariate pseudo-F on standardised features with labels permuted by subject.

    Sums of squared distances within a group equal sums of squares about its centroid, so no distances are formed: per
    permutation only the label sums of subject means are needed. A subject counts with its smallest label.
    """
    cells = checkpoint(cell_moments(features, [subject, label], vec))  # the rows are read once
    total = pool(cells, []).first()
    n, mu, ss = int(total["n"]), np.array(total["mean"]), np.array(total["within"]) + np.array(total["between"])
    sd = np.maximum(np.sqrt(ss / n), 1e-12)
    ss_total = float((ss / sd**2).sum())
    center, scale = F.lit([float(v) for v in mu]), F.lit([float(v) for v in sd])
    standard = lambda c: F.zip_with(A.subtract(F.col(c), center), scale, lambda v, s: v / s)
    # rows of an observed label group of any subject keep their own label; permuted ones take the subject's
    observed = pool(cells, [label]).withColumn("z", standard("mean")).agg(
        F.sum(F.col("n") * A.sum_squares(F.col("z"))).alias("among"), F.count(F.lit(1)).alias("a")
    )
    first = cells.groupBy(subject).agg(F.min(label).alias(label))
    sizes = {r[0]: r["c"] for r in first.groupBy(label).agg(F.count(F.lit(1)).alias("c")).collect()}
    _, ends, keys, _ = _dealing(sizes, n_perm, seed)
    numbered = ranked(first.select(subject), [], [subject], "_i").select(subject, (F.col("_i") - 1).alias("i"))
    sized = pool(cells, [subject]).join(numbered, subject)
    sized = sized.select("i", A.scale(standard("mean"), F.col("n").cast("double")).alias("z"), F.col("n").cast("double").alias("n"))
    per_rep = _permuted_sums(sized, ends, keys, len(mu))

    def pseudo_f(among, a):
        within = F.lit(ss_total) - among
        df_a, df_w = F.greatest(a - 1, F.lit(1)), F.greatest(F.lit(n) - a, F.lit(1))
        return F.when(within <= 0, F.lit(float("inf"))).otherwise((among / df_a) / (within / df_w))

    permuted = per_rep.select(pseudo_f(F.col("among"), F.col("a")).alias("f"))
    point = observed.select(
        pseudo_f(F.col("among"), F.col("a")).alias("pseudo_f"),
        floor_ratio(F.col("among"), F.lit(ss_total), 1e-12).alias("r2"),
    )
    # a relative tolerance keeps ties between the observed and an identical permuted arrangement
    hits = permuted.join(F.broadcast(point)).agg(
        F.count_if(F.col("f") >= F.col("pseudo_f") * (1.0 - 1e-12)).alias("hits")
    )
    return attach(point, hits).select(
        "pseudo_f", "r2", ((F.col("hits") + 1) / F.lit(n_perm + 1)).alias("p_value"), F.lit(n_perm).alias("n_perm")
    )


BOOT_STATS = ("label_frac", "subject_frac", "omega2_label", "omega2_subject", "subject_to_label")


def bootstrap_replicates(
    features: DataFrame,
    n_boot: int = 1000,
    seed: int = 0,
    subject: str = "subject_id",
    label: str = "label",
    vec: str = "x",
) -> DataFrame:
    """Sufficient statistics of cluster-bootstrap replicates: one row per (boot, label), boot 0 being the data itself.

    Draw i of boot b picks the subject at hash position ``floor(u(seed, b, i) * S)``; a subject drawn twice counts as two
    subjects. Columns: ``boot, label, n, subjects, sx, sxx_cell, sxx_subject, sw`` (vectors about the grand mean).
    """
    from ..plans.hashed import hash_ranked

    cells = checkpoint(cell_moments(features, [subject, label], vec))  # the rows are read once
    total = pool(cells, []).first()
    center = F.lit([float(v) for v in total["mean"]])
    cells = cells.withColumn("mean", A.subtract(F.col("mean"), center))
    subjects = pool(cells, [subject]).select(
        subject, F.col("n").alias("_ns"), F.col("mean").alias("_ms"), F.col("n_cells").alias("_k")
    )
    ids = subjects.select(subject)
    position = hash_ranked(ids, "position", [subject], name="pos")
    n_subjects = ids.count()
    picks = (
        features.sparkSession.range(n_boot * n_subjects)
        .select(
            (F.floor(F.col("id") / n_subjects) + 1).cast("int").alias("boot"), (F.col("id") % n_subjects).alias("i")
        )
        .select(
            "boot",
            (draws.below(draws.digest(seed, F.col("boot"), F.col("i")), F.lit(n_subjects)) + 1).alias("pos"),
        )
        .groupBy("pos", "boot")
        .agg(F.count(F.lit(1)).cast("double").alias("mult"))
        .groupBy("pos")
        .agg(F.collect_list(F.struct("boot", "mult")).alias("reps"))
    )
    drawn = position.join(picks, "pos", "left").drop("pos")
    groups = [r[0] for r in cells.select(label).distinct().orderBy(label).collect()]
    code = (F.array_position(F.lit(groups), F.col(label)) - 1).cast("int")
    picked = F.coalesce("reps", F.array().cast("array<struct<boot:int,mult:double>>"))
    slot = F.transform(picked, lambda r: (r["boot"] * len(groups) + code).cast("int"))
    n = F.col("n").cast("double")
    rows = (
        cells.join(subjects, subject)
        .join(drawn, subject)
        .select(
            A.scale(F.col("mean"), n).alias("sx"),
            F.transform("mean", lambda v: v * v * n).alias("sxx_cell"),
            F.transform("_ms", lambda v: v * v * n).alias("sxx_subject"),
            F.col("within").alias("sw"),
            n.alias("n"),
            (F.lit(1.0) / F.col("_k")).alias("subjects"),
            F.concat(F.array(code), slot).alias("slot"),
            F.concat(F.array(F.lit(1.0)), F.transform(picked, lambda r: r["mult"])).alias("mult"),
        )
    )
    vectors = ["sx", "sxx_cell", "sxx_subject", "sw"]
    sums = _replicate_sums(rows, vectors, ["n", "subjects"], n_boot + 1, len(groups))
    width = len(total["mean"])
    cut = [F.slice("s", 1 + i * width, width).alias(v) for i, v in enumerate(vectors)]
    level = F.element_at(F.lit(groups), (F.col("g") + 1).cast("int")).alias("label")
    return sums.select(
        F.col("rep").alias("boot"), level, *cut, F.element_at("s", -2).alias("n"), F.element_at("s", -1).alias("subjects")
    ).where(F.col("n") > 0)


def register_subject_statistic(spark, name: str, stat: Callable[[np.ndarray, np.ndarray], float]) -> None:
    """Make ``stat(means, sizes)`` of the subjects of a group an aggregate in SQL: ``SELECT …, name(mean, n) … GROUP BY …``
    over ``cell_moments`` by subject. Arrow hands a task one group's subject means (not their rows) at a time."""

    @F.pandas_udf("double")
    def aggregate(mean: pd.Series, n: pd.Series) -> float:
        return float(stat(np.stack(mean.to_numpy()).astype(float), n.to_numpy(float)))

    spark.udf.register(name, aggregate)


def replicate_statistics(replicates: DataFrame) -> DataFrame:
    """The built-in statistics of every replicate: ``boot`` and one column per name in ``BOOT_STATS``."""
    vectors = ("sx", "sxx_cell", "sxx_subject", "sw", "sl")
    replicates = replicates.withColumn("sl", F.transform("sx", lambda v: v * v / F.col("n")))
    sums = replicates.groupBy("boot").agg(
        F.sum("n").alias("n"),
        F.sum("subjects").alias("subjects"),
        F.count(F.lit(1)).alias("labels"),
        *[Summarizer.metrics("sum").summary(array_to_vector(v)).alias(f"_{v}") for v in vectors],
    )
    flat = sums.select(
        "boot",
        "n",
        "subjects",
        "labels",
        *[vector_to_array(f"_{v}.sum").alias(v) for v in vectors],
    )
    dims = flat.select(
        "boot",
        "n",
        "subjects",
        "labels",
        F.explode(F.arrays_zip(*vectors)).alias("z"),
    ).select("boot", "n", "subjects", "labels", "z.*")
    grand = F.col("sx") * F.col("sx") / F.col("n")
    dims = dims.select(
        "boot",
        "n",
        "subjects",
        "labels",
        (F.col("sw") + F.col("sxx_cell") - grand).alias("total"),
        (F.col("sl") - grand).alias("label_ss"),
        (F.col("sxx_subject") - grand).alias("subject_ss"),
        (F.col("sxx_cell") - F.col("sl")).alias("nested_ss"),
        F.col("sw").alias("residual"),
    )
    ms = F.col("residual") / (F.col("n") - F.col("subjects"))

    def omega(ss, df):
        return F.greatest(floor_ratio(ss - df * ms, F.col("total") + ms, 1e-12), F.lit(0.0))

    out = dims.groupBy("boot").agg(
        floor_ratio(F.sum("label_ss"), F.sum("total"), 1e-18).alias("label_frac"),
        floor_ratio(F.sum("subject_ss"), F.sum("total"), 1e-18).alias("subject_frac"),
        F.avg(omega(F.col("label_ss"), F.col("labels") - 1)).alias("omega2_label"),
        F.avg(omega(F.col("nested_ss"), F.col("subjects") - F.col("labels"))).alias("omega2_subject"),
    )
    return out.withColumn("subject_to_label", floor_ratio(F.col("omega2_subject"), F.col("omega2_label"), 1e-9))


def custom_statistics(replicates: DataFrame, stat: Callable[[pd.DataFrame], float]) -> DataFrame:
    """A user statistic per replicate: ``stat`` sees the (few) label rows of one replicate. A draw that raises is NaN."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            value = float(stat(pdf))
        except (ValueError, ZeroDivisionError, ArithmeticError):
            value = float("nan")
        return pd.DataFrame({"boot": [key[0]], "value": [value]})

    return replicates.groupBy("boot").applyInPandas(one, "boot int, value double")


def bootstrap_interval(statistics: DataFrame, value: str = "value", log: bool = False) -> DataFrame:
    """Point (boot 0), mean and 2.5/97.5 percentiles over finite draws; on the log scale if at least 10 are positive."""
    v = F.col(value)
    finite = (F.col("boot") > 0) & ~F.isnan(v) & (F.abs(v) != float("inf"))
    drawn = F.when(finite, v)
    logged = F.when(finite & (v > 0), F.log(v))
    sums = statistics.agg(
        F.max(F.when(F.col("boot") == 0, v)).alias("point"),
        F.avg(drawn).alias("mean"),
        F.percentile(drawn, 0.025).alias("ci_low"),
        F.percentile(drawn, 0.975).alias("ci_high"),
        F.count(drawn).alias("n_valid"),
        F.count(logged).alias("_positive"),
        F.exp(F.avg(logged)).alias("_mean"),
        F.exp(F.percentile(logged, 0.025)).alias("_low"),
        F.exp(F.percentile(logged, 0.975)).alias("_high"),
    )
    use_log = F.lit(log) & (F.col("_positive") >= 10)
    nan = F.lit(float("nan"))
    return sums.select(
        "point",
        F.coalesce(F.when(use_log, F.col("_mean")).otherwise(F.col("mean")), nan).alias("mean"),
        F.coalesce(F.when(use_log, F.col("_low")).otherwise(F.col("ci_low")), nan).alias("ci_low"),
        F.coalesce(F.when(use_log, F.col("_high")).otherwise(F.col("ci_high")), nan).alias("ci_high"),
        "n_valid",
    )


def cluster_bootstrap(
    features: DataFrame,
    stat: str | Callable[[pd.DataFrame], float] = "subject_frac",
    n_boot: int = 1000,
    seed: int = 0,
    log: bool = False,
    subject: str = "subject_id",
    label: str = "label",
    vec: str = "x",
) -> DataFrame:
    """Percentile interval of a statistic under resampling of whole subjects. Rows are read once."""
    reps = bootstrap_replicates(features, n_boot, seed, subject, label, vec)
    if callable(stat):
        return bootstrap_interval(custom_statistics(reps, stat), "value", log)
    if stat not in BOOT_STATS:
        raise ValueError(f"unknown statistic {stat!r}; known: {BOOT_STATS}")
    return bootstrap_interval(replicate_statistics(reps), stat, log)


# ---- random-noise null ----------------------------------------------------------------------------------------------


def null_fractions(
    counts: DataFrame, n_dims: int, n_seeds: int, seed: int, subject: str, label: str, by: Sequence[str] = ()
) -> DataFrame:
    """Crossed fractions of white noise laid over the same annotations, one row per draw.

    Noise of n rows has a N(0, I/n) cell mean and an independent chi-square residual, so a draw needs the cell counts
    only: no row of the table is touched and the cost does not grow with the number of rows.
    """
    by = list(by)
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]  # groups draw independently
    cells = counts.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_seeds))).alias("draw"))
    z = F.transform(
        F.sequence(F.lit(0), F.lit(n_dims - 1)),
        lambda d: draws.normal(draws.digest(seed, *groups, F.col("draw"), F.col(subject), F.col(label), d)) / F.sqrt(F.col("n")),
    )
    cells = cells.select(*by, "draw", subject, label, "n", z.alias("mean"))
    cells = cells.withColumn("within", F.array_repeat(F.lit(0.0), n_dims))
    between = crossed_from_cells(cells, subject, label, [*by, "draw"])
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_cells"))
    joined = between.join(sizes, by) if by else attach(between, sizes)
    df = (F.col("_n") - F.col("_cells")) * n_dims
    residual = F.when(df > 0, draws.chi_square(draws.normal(draws.digest(seed, *groups, F.col("draw"), "residual")), df)).otherwise(0.0)
    total = F.greatest(F.col("ss_total") + residual, F.lit(1e-18))
    return joined.select(
        *by,
        "draw",
        (F.col("ss_label") / total).alias("label_frac"),
        (F.col("ss_subject") / total).alias("subject_frac"),
    )


def null_control(
    features: DataFrame,
    n_seeds: int = 20,
    seed: int = 0,
    subject: str = "subject_id",
    label: str = "label",
    by: Sequence[str] = (),
    vec: str = "x",
) -> DataFrame:
    """Real crossed fractions against a white-noise null of the same layout: means, sample spread, excess ratios and the
    prediction from degrees of freedom."""
    by = list(by)
    n_dims = features.select(F.size(vec)).first()[0]
    counts = features.groupBy(*by, subject, label).agg(F.count(F.lit(1)).alias("n"))
    nulls = null_fractions(counts, n_dims, n_seeds, seed, subject, label, by)
    spread = nulls.groupBy(*by).agg(
        F.avg("label_frac").alias("null_label_mean"),
        F.coalesce(F.stddev_samp("label_frac"), F.lit(0.0)).alias("null_label_std"),
        F.avg("subject_frac").alias("null_subject_mean"),
        F.coalesce(F.stddev_samp("subject_frac"), F.lit(0.0)).alias("null_subject_std"),
    )
    real = crossed_ss(features, subject, label, by, vec)
    joined = real.join(spread, by) if by else attach(real, spread)
    rest = F.greatest(F.col("n_rows") - 1, F.lit(1))
    return joined.select(
        *by,
        "n_rows",
        "n_subjects",
        "n_labels",
        "label_frac",
        "subject_frac",
        "residual_frac",
        "null_label_mean",
        "null_label_std",
        "null_subject_mean",
        "null_subject_std",
        excess_ratio(F.col("label_frac"), F.col("null_label_mean")).alias("excess_label"),
        excess_ratio(F.col("subject_frac"), F.col("null_subject_mean")).alias("excess_subject"),
        ((F.col("n_labels") - 1) / rest).alias("df_label_pred"),
        ((F.col("n_subjects") - 1) / rest).alias("df_subject_pred"),
        F.lit(n_seeds).alias("n_null_seeds"),
    )


# ---- how concentrated the label variance is ---------------------------------------------------------------------------


def label_ss_per_axis(features: DataFrame, label: str = "label", by: Sequence[str] = (), vec: str = "x") -> DataFrame:
    """``dim, label_ss, total_ss`` per dimension."""
    top = pool(cell_moments(features, [*by, label], vec), list(by))
    return top.select(
        *by, "n", F.posexplode(F.arrays_zip("between", "within")).alias("dim", "z")
    ).select(*by, "n", "dim", F.col("z.between").alias("label_ss"), (F.col("z.between") + F.col("z.within")).alias("total_ss"))


def concentration(axes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Axes needed for 50/80/95 % of the label variance, and participation ratios, from ``label_ss, total_ss`` rows
    (one per axis, so the window below holds one feature width)."""
    by = list(by)
    along = Window.partitionBy(*by).orderBy(F.desc("label_ss"), "dim")
    whole = Window.partitionBy(*by)
    cum = axes.withColumn("rank", F.row_number().over(along)).withColumn(
        "cum",
        F.try_divide(
            F.sum("label_ss").over(along.rowsBetween(Window.unboundedPreceding, 0)), F.sum("label_ss").over(whole)
        ),
    )
    live = F.sum("label_ss") > 0

    def reach(share):
        hit = F.min(F.when(F.col("cum") >= share, F.col("rank")))
        return F.when(live, F.coalesce(hit, F.max("rank"))).otherwise(F.lit(-1))

    def participation(column):
        value = F.sum(column) * F.sum(column) / F.greatest(F.sum(F.col(column) * F.col(column)), F.lit(1e-18))
        return F.when(live & (F.sum(column) > 0), value).otherwise(float("nan"))

    return cum.groupBy(*by).agg(
        reach(0.5).alias("dims_for_50pct"),
        reach(0.8).alias("dims_for_80pct"),
        reach(0.95).alias("dims_for_95pct"),
        participation("label_ss").alias("pr_label"),
        participation("total_ss").alias("pr_total"),
    )


def top_axes(axes: DataFrame, n: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """``rank, cum_fraction, eta2``: cumulative label share at each rank, and the n-th largest eta squared beside it."""
    by = list(by)
    along = Window.partitionBy(*by).orderBy(F.desc("label_ss"), "dim")
    whole = Window.partitionBy(*by)
    eta = F.col("label_ss") / F.greatest(F.col("total_ss"), F.lit(1e-18))
    cum = axes.withColumn("rank", F.row_number().over(along)).select(
        *by,
        "rank",
        F.when(
            F.sum("label_ss").over(whole) > 0,
            F.try_divide(
                F.sum("label_ss").over(along.rowsBetween(Window.unboundedPreceding, 0)), F.sum("label_ss").over(whole)
            ),
        )
        .otherwise(0.0)
        .alias("cum_fraction"),
    )
    etas = axes.withColumn("eta2", eta).select(
        *by, "eta2", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("eta2"))).alias("rank")
    )
    return cum.where(F.col("rank") <= n).join(etas, [*by, "rank"])


def principal_axes(features: DataFrame, label: str = "label", vec: str = "x") -> DataFrame:
    """``dim, label_ss, total_ss`` on principal axes: eigenvectors of the centred Gram matrix on the driver, label means
    rotated in Spark. Axes come in order of variance."""
    n, mu = mean_vector(features, vec)
    scatter, _, _ = gram(features, vec, center_left=mu)
    values, vectors = np.linalg.eigh(scatter)
    order = np.argsort(values)[::-1][: min(n, len(values))]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    means = cell_moments(features, [label], vec).select("n", "mean")

    def rotate(batches):
        for pdf in batches:
            if len(pdf):
                scores = (np.stack(pdf["mean"].to_numpy()) - mu) @ vectors
                ss = (pdf["n"].to_numpy()[:, None] * scores**2).sum(axis=0)
                yield pd.DataFrame({"dim": np.arange(len(ss), dtype="int32"), "label_ss": ss, "total_ss": values})

    parts = means.mapInPandas(rotate, "dim int, label_ss double, total_ss double")
    return parts.groupBy("dim").agg(F.sum("label_ss").alias("label_ss"), F.max("total_ss").alias("total_ss"))


def label_subspace(features: DataFrame, label: str = "label", vec: str = "x") -> DataFrame:
    """``concentration`` on the raw dimensions and on principal axes: two rows, ``basis`` raw and pc."""
    raw = concentration(label_ss_per_axis(features, label, (), vec)).withColumn("basis", F.lit("raw"))
    pc = concentration(principal_axes(features, label, vec)).withColumn("basis", F.lit("pc"))
    return raw.unionByName(pc)
