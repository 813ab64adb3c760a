"""Vector expressions: products, norms, 8-bit codes.  Everything is a Column of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from the first component on."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a.cast("array<double>"), lambda x: x / n)).otherwise(a.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def bio_distance(distance: Column, weight: Column) -> Column:
    """A distance grows by up to twice as the weight falls below 1."""
    return F.when(weight < 1, distance * (2 - weight)).otherwise(distance)


def sq8_encode(vector: Column, scale: Column, offset: Column) -> Column:
    """8-bit codes: round half to even of (x - offset) / scale, kept in 0..255."""
    shifted = F.zip_with(vector.cast("array<double>"), offset, lambda x, o: x - o)
    return F.zip_with(shifted, scale, lambda x, s: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(x / s))).cast("int"))


def sq8_decode(code: Column, scale: Column, offset: Column) -> Column:
    return F.zip_with(F.zip_with(code.cast("array<double>"), scale, lambda c, s: c * s), offset, lambda x, o: x + o)
