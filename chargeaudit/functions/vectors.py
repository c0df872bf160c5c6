"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in [-1, 1]; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def score(similarity: Column) -> Column:
    """Similarity as reported: four decimals."""
    return F.round(similarity, 4)
