"""Registry of named queries and, where SQL can say it, the same result as SQL over the raw tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the floating columns and widen the integer ones, so that both engines hash the same values."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append((F.round(F.col(name).cast("double"), digits) + F.lit(0.0)).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def crossed(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings bound as features in which every subject has both labels."""
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        v.alias("row_id"),
        (v % 25).alias("subject_id"),
        (v % 25 * 2 + F.col("label") % 2).alias("recording_id"),
        (F.col("label") % 2).cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def nested(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings bound as features in which every subject has one label."""
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        v.alias("row_id"),
        (F.col("label") * 5 + v % 5).cast("bigint").alias("subject_id"),
        F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


CROSSED = """f AS (SELECT vec_id AS row_id, vec_id % 25 AS subject_id, vec_id % 25 * 2 + label % 2 AS recording_id,
  label % 2 AS label, embedding AS x FROM embeddings),
fl AS (SELECT row_id, subject_id, recording_id, label, unnest(range(len(x))) AS dim, unnest(x)::DOUBLE AS v FROM f)"""

NESTED = """f AS (SELECT vec_id AS row_id, label * 5 + vec_id % 5 AS subject_id, label, embedding AS x FROM embeddings),
fl AS (SELECT row_id, subject_id, label, unnest(range(len(x))) AS dim, unnest(x)::DOUBLE AS v FROM f)"""


def u32(text: str, word: int = 0) -> str:
    """SQL for a 32-bit word of the digest of a text expression."""
    return f"('0x' || substr(md5({text}), {1 + 8 * word}, 8))::BIGINT"
