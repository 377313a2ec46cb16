"""UNION, INTERSECT and EXCEPT with type unification: integers meet decimals as decimals and doubles as doubles, all else as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _meet(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(a, whole) and isinstance(b, whole):
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, T.FractionalType) and not isinstance(a, T.DecimalType) or isinstance(b, T.FractionalType) and not isinstance(b, T.DecimalType):
            return T.DoubleType()
        scale = max(getattr(x, "scale", 0) for x in (a, b))
        return T.DecimalType(38, scale)
    if isinstance(a, T.NullType):
        return b
    return a if isinstance(b, T.NullType) else T.StringType()


def unify(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the left one's names and common types."""
    if len(a.columns) != len(b.columns):
        raise ValueError("each set operation query must have the same number of columns")
    kinds = [_meet(x.dataType, y.dataType) for x, y in zip(a.schema, b.schema, strict=True)]
    cast = lambda df: df.toDF(*a.columns).select(*[F.col(f"`{c}`").cast(k) for c, k in zip(a.columns, kinds, strict=True)])
    return cast(a), cast(b)


def union(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:  # noqa: A002
    a, b = unify(a, b)
    return a.unionAll(b) if all else a.unionAll(b).distinct()


def intersect(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:  # noqa: A002
    a, b = unify(a, b)
    return a.intersectAll(b) if all else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:  # noqa: A002
    a, b = unify(a, b)
    return a.exceptAll(b) if all else a.subtract(b)
