"""coalesce, nullif, greatest, least."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import col, function


@function("coalesce")
def coalesce(*xs) -> Column:
    return F.coalesce(*map(col, xs))


@function("greatest")
def greatest(*xs) -> Column:
    return col(xs[0]) if len(xs) == 1 else F.greatest(*map(col, xs))


@function("least")
def least(*xs) -> Column:
    return col(xs[0]) if len(xs) == 1 else F.least(*map(col, xs))


@function("nullif")
def nullif(x, y) -> Column:
    return F.nullif(col(x), col(y))
