"""Sort order with PostgreSQL's NULL placement, limits and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order(x: Column | str, desc: bool = False, nulls_first: bool | None = None) -> Column:
    """NULLs last ascending, first descending, unless said otherwise."""
    x = F.col(x) if isinstance(x, str) else x
    first = desc if nulls_first is None else nulls_first
    if desc:
        return x.desc_nulls_first() if first else x.desc_nulls_last()
    return x.asc_nulls_first() if first else x.asc_nulls_last()


def order_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Keys as "a", "-a" (descending) or Columns from order()."""
    return df.orderBy(*[order(k.lstrip("-"), k.startswith("-")) if isinstance(k, str) else k for k in keys])


def top_k(df: DataFrame, k: int, *keys: str | Column, offset: int = 0) -> DataFrame:
    """The first k rows: each task keeps k + offset, one task merges those."""
    rows = order_by(df, *keys)
    return rows.offset(offset).limit(k) if offset else rows.limit(k)
