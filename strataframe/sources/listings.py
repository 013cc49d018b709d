"""File listings: recordings in a dataset tree, object keys, sync plans, stimulus images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.selecting import remaining

# Files kept from the root of a dataset.
ROOT_FILES = ("dataset_description.json", "participants.tsv", "participants.json", "README", "CHANGES", "LICENSE")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, size, modified`` of the files below ``root`` whose name matches ``pattern``. Contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    )
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


def recordings_of_task(files: DataFrame, task: str, extension: str = "set", sessions: bool = False) -> DataFrame:
    """``subject, path``: recordings ``sub-S/[ses-X/]eeg/sub-S_[ses-X_]task-T_..._eeg.EXT``, each path once. With
    ``sessions`` the first path of a subject is kept."""
    inner = r"(?:ses-[^/]+/)?" if sessions else ""
    shape = rf"(?:^|/)sub-([^/_]+)/{inner}eeg/sub-[^/]*_task-\Q{task}\E_[^/]*eeg\.{extension}$"
    rows = files.select("path", F.regexp_extract("path", shape, 1).alias("subject")).where(F.col("subject") != "").distinct()
    if sessions:
        return rows.groupBy("subject").agg(F.min("path").alias("path"))
    return rows.select("subject", "path")


def is_relevant(key: str | Column, task: str) -> Column:
    """Object keys worth syncing: known root files, phenotype tables, files of the task. Root means one level deep."""
    column = F.col(key) if isinstance(key, str) else key
    base = basename(column)
    depth = F.size(F.split(column, "/"))
    root = (depth <= 2) & base.isin(*ROOT_FILES)
    deeper = (depth > 2) & (
        F.contains(column, F.lit("/phenotype/")) | F.contains(base, F.lit(f"task-{task}_")) | F.contains(base, F.lit(f"task-{task}."))
    )
    return ~F.endswith(column, F.lit("/")) & (root | deeper)


def sync_plan(remote: DataFrame, local: DataFrame, key: str = "key", size: str = "size") -> DataFrame:
    """Every remote object with ``skip`` (present at equal size) or ``fetch``."""
    here = local.select(key, size).distinct().withColumn("_here", F.lit(True))
    return remote.join(here, [key, size], "left").withColumn("status", F.when(F.col("_here"), "skip").otherwise("fetch")).drop("_here")


def sync_summary(plan: DataFrame, size: str = "size") -> DataFrame:
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("n_keys"), F.sum(size).alias("n_bytes"))


def to_fetch(remote: DataFrame, local: DataFrame, key: str = "key", size: str = "size") -> DataFrame:
    return remaining(remote, local, [key, size])


def catalog_query(manifest: DataFrame, dataset: str, task: str | None = None, subjects: Sequence[str] | None = None) -> DataFrame:
    """Recordings of a catalog by dataset, task and subject list; all three reach the file scan as predicates."""
    rows = manifest.where(F.col("dataset") == dataset)
    if task is not None:
        rows = rows.where(F.col("task") == task)
    if subjects is not None:
        rows = rows.where(F.col("subject").isin(list(subjects)))
    return rows


def match_stimuli(images: DataFrame, stimuli: DataFrame, path: str = "path", image: str = "image") -> DataFrame:
    """Wanted stimuli with their local file, by base name; stimuli without a file are left out."""
    files = images.select(F.col(path).alias("file"), basename(path).alias("_b")).groupBy("_b").agg(F.min("file").alias("file"))
    return stimuli.withColumn("_b", basename(image)).join(files, "_b").drop("_b")
