"""Filters, encodings, set operations and keyed merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..contracts import ContractError, require_empty, require_rows
from ..functions.scalars import class_index, finite, sex_code, subject_number
from ..plans.moments import attach
from ..plans.ordered import HOT_ROWS, ranked
from ..session import checkpoint
from .nearest import nearest


# ---- recordings -----------------------------------------------------------------------------------------------------------


def usable_recordings(headers: DataFrame, min_seconds: float, modal_channels: bool = True) -> DataFrame:
    """Every recording with a ``reason`` (NULL when usable): unreadable, too short, or not the modal channel count (the
    smallest count on ties)."""
    seconds = F.col("n_times") / F.col("sfreq")
    readable = F.col("n_times").isNotNull() & F.col("sfreq").isNotNull()
    reason = F.when(~readable, "unreadable").when(
        seconds < min_seconds, F.format_string("too short: %.2fs < %.1fs window+margin", seconds, F.lit(float(min_seconds)))
    )
    if not modal_channels:
        return headers.withColumn("reason", reason)
    modal = headers.where(readable).groupBy("n_channels").agg(F.count(F.lit(1)).alias("_c"))
    modal = modal.agg(F.min_by("n_channels", F.struct(-F.col("_c"), F.col("n_channels"))).alias("_mode"))
    rows = headers.join(F.broadcast(modal))
    odd = F.format_string("n_channels=%d != mode %d", F.col("n_channels"), F.col("_mode"))
    return rows.withColumn("reason", reason.when(F.col("n_channels") != F.col("_mode"), odd)).drop("_mode")


def restrict_subjects(df: DataFrame, wanted: DataFrame, subject: str = "subject_id", name: str = "subject") -> DataFrame:
    """Keep the subjects of a list given as ``sub-123`` or ``123``."""
    ids = wanted.select(subject_number(F.col(name).cast("string")).alias(subject)).where(F.col(subject).isNotNull())
    return df.join(ids.distinct(), subject, "left_semi")


def trait_labels(participants: DataFrame, classes: Sequence[str], column: str, order: Sequence[str], participant: str = "participant_id") -> DataFrame:
    """``subject_id, label``: class by position in ``classes``, case-insensitive; a subject's first matching row wins."""
    rows = participants.select(
        subject_number(F.col(participant)).alias("subject_id"), class_index(F.col(column), list(classes)).alias("label"), *order
    )
    rows = rows.where(F.col("label").isNotNull() & F.col("subject_id").isNotNull())
    return rows.groupBy("subject_id").agg(F.min_by("label", F.struct(*order)).alias("label"))


def live_features(values: DataFrame, feature: str = "feature", value: str = "value", n_rows: int | Column | None = None, eps: float = 1e-10) -> DataFrame:
    """Features whose population variance exceeds ``eps``. Sparse tables pass the full row count as ``n_rows``: entries
    that are not there count as zeros."""
    if n_rows is None:
        stats = values.groupBy(feature).agg(F.var_pop(value).alias("variance"))
    else:
        n = n_rows if isinstance(n_rows, Column) else F.lit(float(n_rows))
        mean = F.sum(value) / n
        absent = n - F.count(value)
        ss = F.var_pop(value) * F.count(value) + F.count(value) * F.pow(F.avg(value) - mean, F.lit(2.0)) + absent * mean * mean
        stats = values.groupBy(feature).agg((ss / n).alias("variance"))
    return stats.where(F.col("variance") > eps)


def finite_targets(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Drop rows with any missing or non-finite target."""
    keep = F.lit(True)
    for t in targets:
        keep = keep & finite(F.col(t))
    return df.where(keep)


def concept_table(subjects: DataFrame, continuous: Sequence[str], sex: str | None = "sex", subject: str = "subject_id") -> DataFrame:
    """``subject, concept, kind, y`` in long form, missing values dropped; sex becomes M=1, F=0."""
    entries = [F.struct(F.lit(c).alias("concept"), F.lit("continuous").alias("kind"), F.col(c).cast("double").alias("y")) for c in continuous]
    if sex is not None:
        entries.append(F.struct(F.lit(sex).alias("concept"), F.lit("binary").alias("kind"), sex_code(F.col(sex)).alias("y")))
    long = subjects.select(subject, F.explode(F.array(*entries)).alias("e")).select(subject, "e.*")
    return long.where(finite(F.col("y")))


def keep_known_codes(trials: DataFrame, gallery: DataFrame, code: str = "code", gid: str = "id", minimum: int = 2) -> DataFrame:
    """Trials whose code is in the gallery; fewer than ``minimum`` distinct codes is an error."""
    kept = trials.join(gallery.select(F.col(gid).alias(code)), code, "left_semi")
    found = kept.select(code).distinct().limit(minimum).count()
    if found < minimum:
        raise ContractError(f"only {found} calibration code(s) overlap the gallery; need {minimum}")
    return kept


def select_layers(features: DataFrame, layers: Sequence[int], n_layers: int, depth: str = "depth") -> DataFrame:
    """Keep the asked depths; negative ones count from the end. Empty or out-of-range lists are errors."""
    if not layers:
        raise ContractError("layer subset is empty")
    out = [d for d in layers if not -n_layers <= d < n_layers]
    if out:
        raise ContractError(f"layers {out} out of range for {n_layers}")
    return features.where(F.col(depth).isin(sorted({d % n_layers for d in layers})))


def eligible_datasets(catalog: DataFrame, min_subjects: int = 0, max_subjects: int | None = None, codes: Sequence[str] = (), exclude: str = "fake", limit: int | None = None) -> DataFrame:
    """Data sets within the size limits, named in ``codes`` (if given) and not containing ``exclude``; ``limit`` is the
    per-run budget."""
    keep = (F.col("n_subjects") >= min_subjects) & ~F.lower("dataset").contains(exclude)
    if max_subjects is not None:
        keep = keep & (F.col("n_subjects") <= max_subjects)
    if codes:
        keep = keep & F.col("dataset").isin(list(codes))
    out = catalog.where(keep)
    return out.orderBy("dataset").limit(limit) if limit is not None else out


def check_targets(available: DataFrame, targets: Sequence[str], name: str = "name") -> DataFrame:
    """The wanted names, when all are available exactly; otherwise an error that lists the missing ones."""
    wanted = available.sparkSession.createDataFrame([(t,) for t in targets], f"{name} string")
    require_empty(wanted.join(available.select(name).distinct(), name, "left_anti"), "targets not found")
    return wanted


def vocabulary_channels(channels: DataFrame, vocabulary: DataFrame, ch: str = "ch") -> DataFrame:
    """Channels whose name is in a vocabulary, order kept; none left is an error."""
    kept = channels.join(vocabulary.select(ch), ch, "left_semi")
    require_rows(kept, "no channel is in the vocabulary")
    return kept


# ---- first rows, codes ----------------------------------------------------------------------------------------------------------


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key along ``order``: a min-by aggregate, so no group is sorted or gathered."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, "_first.*")


def best_sampled(trials: DataFrame, code: str, n: int, by: Sequence[str] = (), count: str = "n") -> DataFrame:
    """``by, code, n``: the codes with the most trials, at most ``n`` of each group; the smaller code on ties."""
    counts = trials.groupBy(*by, code).agg(F.count(F.lit(1)).alias(count))
    rows = ranked(counts, list(by), [F.desc(count), code], "_r")
    return rows.where(F.col("_r") <= n).drop("_r")


def encode_labels(df: DataFrame, column: str, name: str = "label_code") -> DataFrame:
    """Index of each distinct value in sorted order, from 0. A null label has no code; its rows stay, with null."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = ranked(values, [], [column], name)
    coded = df.join(codes.withColumn(name, (F.col(name) - 1).cast("int")), column, "left")
    return coded.select(*df.columns, name)


def stimulus_codes(paths: DataFrame, path: str = "path", extensions: Sequence[str] = (".jpg", ".jpeg", ".png", ".bmp", ".webp"), max_images: int | None = None, seed: int = 0, hot_rows=HOT_ROWS) -> DataFrame:
    """``path, basename, code``: images by sorted basename, codes from 1 (0 stays free), after an optional seeded
    subset. No image at all is an error."""
    from ..plans.hashed import take_hashed

    base = F.element_at(F.split(path, "/"), -1)
    lower = F.lower(base)
    image = F.lit(False)
    for e in extensions:
        image = image | F.endswith(lower, F.lit(e))
    found = paths.select(path, base.alias("basename")).where(image)
    require_rows(found, "no images found")
    if max_images is not None:
        found = take_hashed(found, seed, [path], max_images)
    return ranked(found, [], ["basename", path], "code", hot_rows=hot_rows)


# ---- set operations, keyed merges ------------------------------------------------------------------------------------------------


def common_channels(channels: DataFrame, subject: str = "subject_id", ch: str = "ch", pos: str = "pos") -> DataFrame:
    """``ch, pos``: channels every subject has, in the order of the first subject."""
    total = channels.agg(F.count_distinct(subject).alias("_n"), F.min(subject).alias("_first"))
    per = channels.groupBy(ch).agg(F.count_distinct(subject).alias("_k"), F.min_by(pos, F.struct(subject, pos)).alias(pos))
    return per.join(F.broadcast(total)).where(F.col("_k") == F.col("_n")).select(ch, pos)


def pool_trials(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of per-subject trial tables by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).distinct()


def remaining(wanted: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Requested minus available."""
    return wanted.join(done.select(*key).distinct(), list(key), "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], order: DataFrame | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key. With an ``order`` table (key, ord) the known keys
    come first in that order."""
    merged = old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)
    if order is not None:
        merged = merged.join(F.broadcast(order), list(key), "left").orderBy(F.col("ord").asc_nulls_last(), *key).drop("ord")
    return merged


def left_join_all(base: DataFrame, tables: dict[str, DataFrame], key: str, id_names: Sequence[str] = ("participant_id", "Subject", "ID")) -> DataFrame:
    """Left-join several tables on ``key``, each under the first id name it has; clashing columns get the table's name
    as suffix and tables without an id are left out."""
    out = base
    for name, table in tables.items():
        found = next((c for c in id_names if c in table.columns), None)
        if found is None:
            continue
        renamed = table.withColumnRenamed(found, key)
        for c in renamed.columns:
            if c != key and c in out.columns:
                renamed = renamed.withColumnRenamed(c, f"{c}_{name}")
        out = out.join(renamed, key, "left")
    return out


def join_positions(left: DataFrame, right: DataFrame, left_order: str, right_order: str, check: bool = True, hot_rows=HOT_ROWS) -> DataFrame:
    """Join the i-th row of one table with the i-th of another; different lengths are an error."""
    from ..contracts import require_same_count

    if check:
        require_same_count(left, right, "tables of different length cannot be aligned")
    a = ranked(left, [], [left_order], "_pos", hot_rows=hot_rows)
    b = ranked(right, [], [right_order], "_pos", hot_rows=hot_rows)
    return a.join(b, "_pos").drop("_pos")


def subject_lookup(rows: DataFrame, meta: DataFrame, subject: str, numeric: Sequence[str], text: Sequence[str] = ("sex",)) -> DataFrame:
    """Metadata per row with defaults: NaN for numbers that are missing or do not parse, ``NA`` for text; both spellings
    of an id (with and without ``sub-``) match."""
    bare = lambda c: F.regexp_replace(F.col(c).cast("string"), "^sub-", "")
    keyed = meta.withColumn("_id", bare(subject)).drop(subject)
    joined = rows.withColumn("_id", bare(subject)).join(keyed, "_id", "left").drop("_id")
    for c in numeric:
        joined = joined.withColumn(c, F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(float("nan"))))
    for c in text:
        joined = joined.withColumn(c, F.when(F.col(c).isNull() | F.col(c).isin("", "n/a"), "NA").otherwise(F.col(c)))
    return joined


def nearest_electrodes(channels: DataFrame, vocabulary: DataFrame, positions: DataFrame, ch: str = "ch") -> DataFrame:
    """``ch, electrode``: vocabulary names pass through (any case); other names take the nearest vocabulary electrode by
    3-D distance, the first in vocabulary order on ties; a name with no position takes the first electrode.

    ``vocabulary(name, ord, x, y, z)`` and ``positions(ch, x, y, z)`` are joined by name; the nearest electrode comes
    from a grid, so neither table has to fit into a task.
    """
    names = channels.select(ch).distinct().withColumn("_u", F.upper(F.trim(ch)))
    vocab = vocabulary.select(F.upper("name").alias("_u"), F.col("name").alias("_same")).dropDuplicates(["_u"])
    located = positions.select(F.upper(F.trim(ch)).alias("_u"), "x", "y", "z").dropDuplicates(["_u"])
    placed = vocabulary.where(F.col("x").isNotNull())
    first = placed.agg(F.min_by("name", "ord").alias("_first"))
    rows = checkpoint(names.join(vocab, "_u", "left"))
    strange = rows.where(F.col("_same").isNull()).select("_u").distinct().join(located, "_u")
    near = nearest(strange, placed.select("ord", "name", "x", "y", "z"), "_u", "ord").select("_u", F.col("found.name").alias("_near"))
    joined = attach(rows.join(near, "_u", "left"), first)
    return joined.select(ch, F.coalesce("_same", "_near", "_first").alias("electrode"))


def channel_positions(channels: DataFrame, montage: DataFrame, ch: str = "ch", extreme: float = 0.13, bins: int = 100) -> DataFrame:
    """Montage position per channel (``EEG `` prefix and case ignored, unknown at the origin), with integer bins."""
    from ..functions.scalars import position_bin

    key = F.regexp_replace(F.lower(F.trim(ch)), "eeg ", "")
    spots = montage.select(F.lower(ch).alias("_k"), "x", "y", "z")
    rows = channels.withColumn("_k", key).join(F.broadcast(spots), "_k", "left").drop("_k")
    for axis in ("x", "y", "z"):
        value = F.coalesce(F.col(axis), F.lit(0.0))
        rows = rows.withColumn(axis, value).withColumn(f"{axis}_bin", position_bin(value, extreme, bins))
    return rows
