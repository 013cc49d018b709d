"""Random draws as pure functions of (seed, keys).

Each draw is read off an MD5 digest, so it is the same under any partitioning, after a task is run again, and in any
engine that has ``md5``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, functions as F

TWO32 = 4294967296


def digest(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[_text(p) for p in parts]))


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def word(hexdigest: Column, index: int = 0) -> Column:
    """The ``index``-th 32-bit word of a digest as a non-negative bigint."""
    return F.conv(F.substring(hexdigest, 1 + 8 * index, 8), 16, 10).cast("bigint")


def uniform(hexdigest: Column, index: int = 0) -> Column:
    """A draw in (0, 1)."""
    return (word(hexdigest, index) + F.lit(0.5)) / F.lit(float(TWO32))


def below(hexdigest: Column, n: Column) -> Column:
    """An integer draw in 0 .. n-1, for n below 2**31."""
    return F.shiftright(word(hexdigest) * n, 32)


def normal(hexdigest: Column) -> Column:
    """A standard normal draw (Box-Muller on two words of the digest)."""
    return F.sqrt(-2.0 * F.log(uniform(hexdigest, 0))) * F.cos(2.0 * math.pi * uniform(hexdigest, 1))


def chi_square(z: Column, df: Column) -> Column:
    """A chi-square draw from a normal one (Wilson-Hilferty), for the large ``df`` of pooled residuals."""
    h = 2.0 / (9.0 * df)
    return df * F.pow(1.0 - h + z * F.sqrt(h), F.lit(3.0))


#: Modulus of the arithmetic behind the rounds of a bijection, and their number.
PRIME, ROUNDS = 2147483647, 48


def bijection_keys(seed, number: int, size: int) -> np.ndarray:
    """Keys of bijections 1 .. ``number`` on 0 .. size-1, shaped (number, ROUNDS, 3), from digests of seed:bijection:round."""
    digests = [hashlib.md5(f"{seed}:{p}:{r}".encode()).hexdigest() for p in range(1, number + 1) for r in range(ROUNDS)]
    words = np.array([[int(d[8 * i : 8 * i + 8], 16) for i in range(3)] for d in digests], np.int64).reshape(number, ROUNDS, 3)
    return np.stack([words[..., 0] % size, words[..., 1] % (PRIME - 1) + 1, words[..., 2] % PRIME], axis=-1)


def bijected(index: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """Where each bijection of ``keys`` sends each index: (bijection, index).

    Each round pairs j with k - j (mod size) and lets a keyed bit of the pair's larger member say whether the two change
    places ("swap or not"); so it is a bijection for any size below 2**31, told from the index alone.
    """
    at = np.broadcast_to(index.astype(np.int64), (len(keys), len(index))).copy()
    for k, a, b in np.moveaxis(keys, 0, 2)[..., None]:
        other = (k + size - at) % size
        h = (a * np.maximum(at, other) + b) % PRIME
        h = (h * h + a) % PRIME
        at = np.where(h >> 8 & 1, other, at)
    return at
