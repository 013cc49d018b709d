"""Scans and sinks of the library's own tables: activations, dictionaries, galleries, epochs, scores, manifests."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, VariantType

from ..contracts import ContractError, require_columns
from ..functions import arrays as A

ACTIVATION_KEYS = ("row_id", "subject_id")

# Default sampling rate of a stored epoch table, and the subject fields of an activation table.
DEFAULT_SFREQ = 250.0
SUBJECT_FIELDS = ("age", "sex", "p_factor", "internalizing", "externalizing", "attention")


def read_activations(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Activation rows; only the asked columns are read. ``depth`` partitions, where present, are pruned by filters."""
    df = spark.read.parquet(path)
    if columns is not None:
        return require_columns(df, *columns).select(*columns)
    return require_columns(df, *ACTIVATION_KEYS)


def write_activations(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_dictionary(atoms: DataFrame, dec_bias: Sequence[float], k: int, path: str) -> None:
    """Atoms and, as one more row with feature -1, the decoder bias; ``k`` is kept on every row."""
    bias = atoms.sparkSession.createDataFrame(
        [(-1, [float(v) for v in dec_bias], 0.0, [float(v) for v in dec_bias])],
        "feature long, enc array<double>, enc_bias double, dec array<double>",
    )
    rows = atoms.select(
        F.col("feature").cast("bigint").alias("feature"), A.as_double("enc").alias("enc"), F.col("enc_bias").cast("double").alias("enc_bias"), A.as_double("dec").alias("dec")
    )
    rows.unionByName(bias).withColumn("k", F.lit(k)).write.mode("overwrite").parquet(path)


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """The atoms of a stored dictionary as a table: feature, enc, enc_bias, dec, k."""
    return spark.read.parquet(path).where(F.col("feature") >= 0)


def read_dictionary(spark: SparkSession, path: str):
    """The dictionary and its ``k``."""
    from ..operators.dictionary import load_dictionary

    rows = spark.read.parquet(path)
    bias = rows.where(F.col("feature") == -1).first()
    return load_dictionary(rows.where(F.col("feature") >= 0).drop("k"), bias["enc"]), int(bias["k"])


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """Epochs of a subject with the default rate where none is stored."""
    df = spark.read.parquet(path)
    rate = F.coalesce(F.col("sfreq").cast("double"), F.lit(DEFAULT_SFREQ)) if "sfreq" in df.columns else F.lit(DEFAULT_SFREQ)
    return require_columns(df.withColumn("sfreq", rate), "epoch", "ch", "x")


def read_stimuli(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """Stimulus rows of one partition without the rejected ones; the ``dropped`` column is optional."""
    df = spark.read.parquet(path).where(F.col("partition") == partition)
    return df.where(~F.coalesce(F.col("dropped").cast("boolean"), F.lit(False))) if "dropped" in df.columns else df


def write_gallery(gallery: DataFrame, path: str) -> None:
    require_columns(gallery, "id", "emb").write.mode("overwrite").parquet(path)


def read_gallery(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), "id", "emb")


def write_scores(df: DataFrame, path: str, formatted: str = "csv") -> None:
    """Score tables as CSV with header, or Parquet."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if formatted == "csv" else writer.parquet(path)


def _variant(df: DataFrame, column: str) -> Column:
    """A column as VARIANT: JSON text is parsed, a struct or map taken as it is."""
    kind = df.schema[column].dataType
    if isinstance(kind, VariantType):
        return F.col(column)
    return F.parse_json(column) if isinstance(kind, StringType) else F.to_variant_object(column)


def setting(config: str, path: str, kind: str, default: Column | None = None) -> Column:
    """A field of a VARIANT column by its path (``probe.score``); ``default`` where it is missing, null or of another kind."""
    found = F.try_variant_get(config, f"$.{path}", kind)
    return found if default is None else F.coalesce(found, default)


def write_manifest(runs: DataFrame, path: str) -> None:
    """Append a table of runs (run, config) in one job. ``config`` is JSON text, a struct, a map or a VARIANT and is
    stored as VARIANT: runs may have other fields than those stored before, and the table's schema stays the same."""
    rows = require_columns(runs, "run", "config").select("run", _variant(runs, "config").alias("config"))
    rows.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def append_manifest(spark: SparkSession, path: str, name: str, config: Mapping) -> None:
    """One manifest row: name, time, configuration."""
    write_manifest(spark.createDataFrame([(name, json.dumps(dict(config), sort_keys=True))], "run string, config string"), path)


def read_manifest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Manifest rows; with a ``schema`` the configuration becomes a struct with nulls for what a run doesn't have."""
    df = spark.read.parquet(path)
    if not schema:
        return df
    fields = spark.createDataFrame([], schema).schema.fields
    return df.withColumn("config", F.struct(*[setting("config", f.name, f.dataType.simpleString()).alias(f.name) for f in fields]))


def write_leaderboard(rows: DataFrame, path: str) -> None:
    from ..operators.report import leaderboard_columns

    leaderboard_columns(rows).write.mode("overwrite").option("header", True).csv(path)


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.report import LEADERBOARD_FIELDS

    return spark.read.option("header", True).schema(", ".join(f"{c} string" for c in LEADERBOARD_FIELDS)).csv(path)


# ---- aggregate results keyed by (dataset, model) --------------------------------------------------------------------------


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result JSON files laid out as ``dataset=../model=../*.json``; the partition columns prune the listing."""
    return spark.read.option("multiLine", True).json(path)


def write_results(results: DataFrame, path: str, by: Sequence[str] = ("dataset", "model")) -> None:
    """Append results (``by``, parts) of any nesting in one job, ``parts`` as VARIANT."""
    rows = require_columns(results, *by, "parts").select(*by, _variant(results, "parts").alias("parts"))
    rows.write.mode("append").parquet(path)


def read_result_variants(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """``read_results`` with each file's content as one VARIANT ``parts``: files may differ in their fields, none is looked
    at to find a schema. With ``multiline=False`` every line is a result."""
    return spark.read.option("multiLine", multiline).option("singleVariantColumn", "parts").json(path)


def lookup_result(results: DataFrame, **keys: str) -> DataFrame:
    """Rows for the given keys, checked one after the other; an unknown value is an error that lists the known ones."""
    out = results
    for column, value in keys.items():
        found = out.where(F.col(column) == value)
        if found.isEmpty():
            known = sorted(str(r[0]) for r in out.select(column).distinct().limit(200).collect())
            raise ContractError(f"{column} {value!r} not found (available: {known})")
        out = found
    return out
