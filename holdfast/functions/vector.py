"""Vectors as array<float>, reckoned in double precision on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many dimensions a product with a constant is written out, which stays in generated code.
WRITTEN_OUT = 128


def constant(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def dot_constant(a: Column, v: list[float]) -> Column:
    if len(v) > WRITTEN_OUT:
        return dot(a, constant(v))
    total = F.lit(0.0)
    for i, x in enumerate(v):
        total = total + F.get(a, F.lit(i)).cast("double") * float(x)
    return total


def squared_l2(a: Column, v: list[float]) -> Column:
    """The squared distance to a constant."""
    if len(v) > WRITTEN_OUT:
        parts = F.zip_with(a, constant(v), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
        return F.aggregate(parts, F.lit(0.0), lambda t, x: t + x)
    total = F.lit(0.0)
    for i, x in enumerate(v):
        d = F.get(a, F.lit(i)).cast("double") - float(x)
        total = total + d * d
    return total


def l2(a: Column, v: list[float]) -> Column:
    return F.sqrt(squared_l2(a, v))


def cosine_of_distance(distance: Column) -> Column:
    """Of unit vectors."""
    return 1 - distance * distance / 2


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))
