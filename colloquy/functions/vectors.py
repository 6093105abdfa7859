"""Expressions on array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """0 if either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def unit(a) -> Column:
    """Length one; a zero vector stays."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n == 0, _c(a)).otherwise(F.transform(_c(a), lambda x: x / n)))[0]


def clamp(x: Column, low, high) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))
