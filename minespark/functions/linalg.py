"""Column builders over ARRAY<DOUBLE> vectors and approximate equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sq_dist(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; NULL entries contribute nothing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce((x - y) * (x - y), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def dist(a: Column, b: Column) -> Column:
    return F.sqrt(sq_dist(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """NULL if either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)
