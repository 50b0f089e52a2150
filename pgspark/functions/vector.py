"""Vector similarity inside generated code: arrays zipped and folded, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for a zero vector; null if the dimensions differ."""
    product = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(product == 0, 0.0).otherwise(dot(a, b) / product))


def euclidean_distance(a: Column, b: Column) -> Column:
    """Null if the dimensions differ."""
    squares = _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    return F.when(F.size(a) == F.size(b), F.sqrt(squares))
