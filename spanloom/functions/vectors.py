"""Vector expressions over ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NORM_FLOOR = 1e-6


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalise(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(NORM_FLOOR))
    return F.transform(v, lambda x: x.cast("double") / norm)


def cosine_distance(a: Column, b: Column) -> Column:
    """For vectors already of unit length."""
    return F.lit(1.0) - dot(a, b)
