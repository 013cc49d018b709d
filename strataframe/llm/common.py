"""Pieces that the corpus operators share: word rule, normalising, stored intermediates, global running sums."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strataframe.session import configure, ensure_checkpoint_dir

#: Words are what lies between these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: With this setting the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Stored intermediates: session, path, and the owner they were made for.
_stashed: list[tuple[SparkSession, str, str | None]] = []
_owner: list[str] = []


@contextmanager
def owned(name: str) -> Iterator[None]:
    """Intermediates stored inside belong to ``name``, so that ``release(name)`` deletes them and no others."""
    _owner.append(name)
    try:
        yield
    finally:
        _owner.pop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of words; empty for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, or the folder that stands in for it in local runs."""
    ensure_checkpoint_dir(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, so a lost executor repeats nothing before it.

    What was shuffled for it is no longer needed and goes at once; the files go when the program ends or ``release`` is called.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strataframe-{uuid.uuid4().hex}/{name}"
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    _stashed.append((spark, path, _owner[-1] if _owner else None))
    return spark.read.schema(df.schema).parquet(path)


def release(owner: str | None = None, keep: DataFrame | None = None) -> None:
    """Delete stored intermediates, those of one owner or all; results that still read them must have been written before.

    What ``keep`` reads stays.
    """
    read = "\n".join(keep.inputFiles()) if keep is not None else ""
    for entry in list(_stashed):
        spark, path, of = entry
        folder = path.rpartition("/")[0]
        if (owner is not None and of != owner) or folder.rpartition("/")[2] in read:
            continue
        _stashed.remove(entry)
        try:
            delete(spark, folder)
        except Exception:  # noqa: BLE001  the session is gone: its folder is the cluster's to clear
            return


def discard(df: DataFrame) -> None:
    """Delete the stored intermediates that ``df`` reads; nothing may read them any more."""
    read = "\n".join(df.inputFiles())
    for entry in list(_stashed):
        spark, path, _ = entry
        folder = path.rpartition("/")[0]
        if folder.rpartition("/")[2].startswith("strataframe-") and folder.rpartition("/")[2] in read:
            _stashed.remove(entry)
            delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def register(spark: SparkSession, path: str) -> None:
    """Let ``release`` delete the folder above ``path``, which other code has written."""
    _stashed.append((spark, path, None))


atexit.register(release)


def content(text: Column) -> Column:
    """64-bit XXH64 of a text. With doc_id it says which row is meant, however the table is read."""
    return F.xxhash64(text.cast("string"))


def spare(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't use."""
    used = {c.lower() for c in docs.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def apply_decisions(docs: DataFrame, decisions: DataFrame, how: str, add: dict[str, str] | None = None) -> DataFrame:
    """Join ``docs`` to one row per (doc_id, content) of decisions, null ids included; ``add`` renames what it brings.

    Rows that repeat both doc_id and text can't be told apart, so of these one is left: the decision counts for all.
    """
    key = spare(docs, "_content")
    keyed = docs.withColumn(key, content(docs["text"]))
    names = keyed.select("doc_id", key)
    again = names.groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", key)
    again = stash(again, "repeated")
    if not again.isEmpty():
        same = keyed["doc_id"].eqNullSafe(again["doc_id"]) & (keyed[key] == again[key])
        once = keyed.join(again, same, "left_semi").dropDuplicates(["doc_id", key])
        keyed = keyed.join(again, same, "left_anti").union(once)
    same = keyed["doc_id"].eqNullSafe(decisions["doc_id"]) & (keyed[key] == decisions["content"])
    joined = keyed.join(decisions, same, how)
    extra = [decisions[c].alias(to) for c, to in (add or {}).items()]
    return joined.select(*[keyed[c] for c in docs.columns], *extra)


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """Sums of columns over all rows up to and including this one, in a global order; null counts as 0.

    ``sums`` maps a column to the name of its running sum. Rows are cut into ranges of the whole order key, so no
    value of a leading key forms one task; ranges are stored first, as their bounds come from samples. Rows equal in
    every order column take an arbitrary order among themselves. Columns must not be called ``_range``.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranged = stash(ranged, name)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = totals.select(
        "_range", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(sums))]
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select(
        *df.columns, "_range", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_s{i}") for i, c in enumerate(sums)]
    ).join(F.broadcast(offsets), "_range")
    return out.select(*df.columns, *[(F.col(f"_s{i}") + F.col(f"_o{i}")).alias(to) for i, to in enumerate(sums.values())])
