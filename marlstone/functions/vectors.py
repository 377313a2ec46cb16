"""Vectors are array<float>; sums run in double, in element order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import col, fails, function


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _zip(a, b, f) -> Column:
    a, b = col(a), col(b)
    total = _fold(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))
    return F.when(F.size(a) != F.size(b), fails("different vector dimensions")).otherwise(total)


@function("l2_distance")
def l2_distance(a, b) -> Column:
    return F.sqrt(_zip(a, b, lambda x, y: (x - y) * (x - y)))


@function("l1_distance")
def l1_distance(a, b) -> Column:
    return _zip(a, b, lambda x, y: F.abs(x - y))


@function("inner_product")
def inner_product(a, b) -> Column:
    return _zip(a, b, lambda x, y: x * y)


def negative_inner_product(a, b) -> Column:
    """The <#> operator."""
    return -inner_product(a, b)


def _squares(a) -> Column:
    return _fold(F.transform(col(a), lambda x: x.cast("double") * x.cast("double")))


@function("cosine_distance")
def cosine_distance(a, b) -> Column:
    """NaN for a zero vector."""
    norms = F.sqrt(_squares(a) * _squares(b))
    similarity = F.try_divide(inner_product(a, b), norms)
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), similarity)))


@function("vector_dims")
def vector_dims(a) -> Column:
    return F.when(col(a).isNotNull(), F.size(col(a)).cast("bigint"))


@function("vector_norm")
def vector_norm(a) -> Column:
    return F.sqrt(_squares(a))


@function("l2_normalize")
def l2_normalize(a) -> Column:
    """The zero vector stays as it is."""
    norm = vector_norm(a)
    return F.when(norm == 0, col(a)).otherwise(F.transform(col(a), lambda x: (x.cast("double") / norm).cast("float")))


def plus(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def minus(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


METRICS = {"l2": l2_distance, "cosine": cosine_distance, "inner": negative_inner_product, "l1": l1_distance}
