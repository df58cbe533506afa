"""Vector columns: arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def pair_features(q: Column, c: Column) -> Column:
    """[q, c, |q - c|, q * c, cos, |q|, |c|] for the re-ranker."""
    return F.concat(q, c, F.zip_with(q, c, lambda x, y: F.abs(x - y)), F.zip_with(q, c, lambda x, y: x * y), F.array(cosine(q, c), norm(q), norm(c)))


def rotate(a: Column, by: int, size: int) -> Column:
    """Cyclic shift to the left."""
    return a if by % size == 0 else F.concat(F.slice(a, by + 1, size - by), F.slice(a, 1, by))


def window_only(a: Column, start: int, length: int) -> Column:
    """Zero outside [start, start + length)."""
    return F.transform(a, lambda x, i: F.when((i >= start) & (i < start + length), x).otherwise(F.lit(0.0)))
