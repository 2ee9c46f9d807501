"""Column expressions on array<float> vectors, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(v: Column) -> Column:
    """The vector in double at length 1; null for a zero vector."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length))


def mean_pool(tokens: Column) -> Column:
    """Mean of the token vectors of one text (array of arrays), position by position."""
    total = F.aggregate(
        tokens,
        F.transform(F.element_at(tokens, 1), lambda x: F.lit(0.0)),
        lambda acc, token: F.zip_with(acc, token, lambda x, y: x + y.cast("double")),
    )
    n = F.size(tokens)
    return F.when(n > 0, F.transform(total, lambda x: x / n))


def mean_pool_nested(sequences: Column) -> Column:
    """Mean over both outer axes of a three-dimensional array."""
    return mean_pool(F.flatten(sequences))
