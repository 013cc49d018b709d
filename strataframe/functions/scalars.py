"""Small column rules: safe ratios, codes, ids, quantisation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def floor_ratio(a: Column, b: Column, eps: float) -> Column:
    """``a / max(b, eps)``."""
    return a / F.greatest(b, F.lit(eps))


def excess_ratio(real: Column, null_mean: Column, eps: float = 1e-18) -> Column:
    """``real / null_mean``, infinite when the null is practically zero."""
    return F.when(null_mean > eps, real / null_mean).otherwise(F.lit(float("inf")))


def normal_label(name: Column) -> Column:
    return F.upper(F.trim(name))


def subject_number(text: Column) -> Column:
    """``'sub-123'`` or ``'123'`` as 123; anything else as NULL."""
    return F.regexp_replace(F.trim(text), "^sub-", "").try_cast("bigint")


def sex_code(sex: Column) -> Column:
    """M as 1, F as 0, everything else missing."""
    return F.when(sex == "M", 1.0).when(sex == "F", 0.0)


def class_index(value: Column, classes: list[str]) -> Column:
    """Position of ``value`` in ``classes``, ignoring case and outer blanks; NULL when it is none of them."""
    wanted = F.array(*[F.lit(c.strip().upper()) for c in classes])
    position = F.array_position(wanted, normal_label(value))
    return F.when(position > 0, (position - 1).cast("int"))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def position_bin(coordinate: Column, extreme: float = 0.13, bins: int = 100) -> Column:
    """A coordinate in [-extreme, extreme] as one of ``bins`` cells, clipped at both ends."""
    cell = F.floor((coordinate + extreme) / (2.0 * extreme) * bins)
    return F.least(F.greatest(cell, F.lit(0)), F.lit(bins - 1)).cast("int")


def round_half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("bigint")


def nested(column: str, path: str, default: Column) -> Column:
    """Field at a dotted path inside a struct column; ``default`` where it, or a struct on the way, is null."""
    found = F.col(column)
    for name in path.split("."):
        found = found.getField(name)
    return F.coalesce(found, default)


def fixed_signed(value: Column, digits: int) -> Column:
    """``+0.2``: a signed number of fixed digits, rounded from its exact binary value and halves to even, as C's printf
    does. Spark's ``format_string`` rounds the shortest decimal form, halves up."""

    @F.pandas_udf("string")
    def text(v: pd.Series) -> pd.Series:
        return v.map(lambda x: f"{x:+.{digits}f}").astype(object)

    return F.when(value.isNotNull(), text(value))
