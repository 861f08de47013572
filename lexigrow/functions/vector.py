"""Functions on array columns that stand for dense vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def length_normalize(v: Column) -> Column:
    """To unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def softmax(v: Column) -> Column:
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x))
    return F.transform(v, lambda x: F.exp(x) / total)


def project(v: Column, line: Column) -> Column:
    """Onto the line through the origin along ``line``."""
    k = dot(v, line) / dot(line, line)
    return F.transform(line, lambda x: x * k)
