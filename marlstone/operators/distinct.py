"""DISTINCT ON and top rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__ms_rank"


def first_per_group(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows per group in each task before it shuffles (window group limit)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(_RANK, rank).where(F.col(_RANK) <= n).drop(_RANK)


def distinct_on(df: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """The first row of each combination of `on`; order's leading keys may repeat them."""
    return first_per_group(df, on, order)
