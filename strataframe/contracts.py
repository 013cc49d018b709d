"""Column contracts, checks that fail loudly, and a size test for broadcast sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

FEATURES = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("subject_id", T.LongType()),
        T.StructField("recording_id", T.LongType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("x", T.ArrayType(T.DoubleType())),
    ]
)

EPOCHS = T.StructType(
    [
        T.StructField("recording_id", T.LongType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("ch", T.StringType()),
        T.StructField("sfreq", T.DoubleType()),
        T.StructField("x", T.ArrayType(T.DoubleType())),
    ]
)

BROADCAST_LIMIT = 64 << 20


class ContractError(ValueError):
    """Input that breaks an operator's contract."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ContractError(f"missing columns {missing}; have {df.columns}")
    return df


def require_empty(df: DataFrame, message: str) -> None:
    """Raise when ``df`` (a table of violations) has a row; at most five rows travel to the driver."""
    bad = df.limit(5).collect()
    if bad:
        raise ContractError(f"{message}: {[tuple(r) for r in bad]}")


def require_rows(df: DataFrame, message: str) -> None:
    if df.isEmpty():
        raise ContractError(message)


def single_label_violations(df: DataFrame, subject: str = "subject_id", label: str = "label") -> DataFrame:
    """Subjects that carry more than one label."""
    return (
        df.groupBy(subject)
        .agg(F.min(label).alias("low"), F.max(label).alias("high"))
        .where(F.col("low") != F.col("high"))
    )


def width_violations(df: DataFrame, width: int, vec: str = "x") -> DataFrame:
    return df.where(F.size(vec) != width)


def require_same_count(left: DataFrame, right: DataFrame, message: str) -> None:
    n, m = left.count(), right.count()
    if n != m:
        raise ContractError(f"{message}: {n} and {m} rows")


def fits_broadcast(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_LIMIT) -> bool:
    """Count the rows of a candidate side, stopping just past the bound."""
    cap = max(1, limit // max(1, bytes_per_row))
    return df.limit(cap + 1).count() <= cap
