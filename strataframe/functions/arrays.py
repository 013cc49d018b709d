"""Vector arithmetic on ``array<double>`` columns, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def as_double(vec: Column | str) -> Column:
    return F.col(vec).cast("array<double>") if isinstance(vec, str) else vec.cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``.

    Column expressions are substituted, not stored: captured in a lambda they would be computed for every element.
    """
    return F.transform(F.array(value), body)[0]


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, v: acc + v)


def mean(vec: Column) -> Column:
    return total(vec) / F.size(vec)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def sum_squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v)


def norm(a: Column) -> Column:
    return F.sqrt(sum_squares(a))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p - q)


def scale(a: Column, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(a, lambda v: v * f))


def unit(a: Column, eps: float = 0.0) -> Column:
    return scale(a, 1.0 / (norm(a) + F.lit(eps)))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(eps)) * (norm(b) + F.lit(eps)))


def variance_pop(a: Column) -> Column:
    """Two-pass population variance of the elements of one array."""
    squares = let(mean(a), lambda mu: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + (v - mu) * (v - mu)))
    return squares / F.size(a)


def pad_right(a: Column, length: int) -> Column:
    """Append zeros up to ``length``; longer arrays are left alone."""
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(a))
    return F.concat(a, F.array_repeat(F.lit(0.0), missing))


def clamp(value: Column, bound: float) -> Column:
    return F.least(F.greatest(value, F.lit(-bound)), F.lit(bound))
