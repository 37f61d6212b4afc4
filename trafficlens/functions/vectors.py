"""Vector columns (array<float>), accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null (a miss) for zero vectors and for vectors of different length."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))
