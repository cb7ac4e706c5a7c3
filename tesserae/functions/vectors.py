"""Vector expressions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def scaled(a: Column, by: Column) -> Column:
    """The vector times a number, which is evaluated once and not for each element."""
    return F.zip_with(a, F.array_repeat(by, F.size(a)), lambda x, y: x.cast("double") * y)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def unit(a: Column) -> Column:
    """The vector at length 1; one without length stays."""
    n = norm(a)
    return F.when(n > 0, scaled(a, 1 / n)).otherwise(F.transform(a, lambda x: x.cast("double")))
