"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """The inner product over the common length, in double precision."""
    n = F.least(F.size(a), F.size(b))
    return _sum(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length; 0 if either side is zero there."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector of length 1 in its direction; null if it has none."""
    n = norm(a)
    return F.when((n > 0) & (n < float("inf")), F.transform(a, lambda x: x.cast("double") / n))


def int8(a: Column) -> Column:
    """A vector as bytes, its largest component as 127, halves rounded up."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.when(top > 0, F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") / top * 127 + 0.5))).cast("tinyint")))


def int8_scale(q: Column) -> Column:
    """What a dot product with a byte vector is multiplied by to be a cosine."""
    return (1 / norm(q)).cast("float")
