"""Joins beyond what the planner does unasked: USING, NATURAL, LATERAL, size-checked broadcast, salting, cells, correlated sides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SALT = "__ms_salt"
#: Largest side, by the optimiser's estimate, that broadcast_if_small sends to all executors.
BROADCAST_BYTES = 64 << 20
#: Pairs of rows of a key that full_in_cells makes in one place, about.
CELL_PAIRS = 4 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only behind a check of the estimated size; beyond it the planner's own choice stands."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def using(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """USING: each join column once, from either side in outer joins; they come first."""
    return left.join(right, on, how)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared, how) if shared else left.crossJoin(right)


def salted(left: DataFrame, right: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """For a left side with hot keys and a right side that is small per key: the right is repeated `salts` times.

    Exact for inner, left, semi and anti joins.  The salt is a hash of the row, so that a task that runs again deals its rows
    alike; equal rows share a salt.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} joins can't be salted")
    left = left.withColumn(_SALT, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in left.dtypes if "map<" not in kind]), F.lit(salts)).cast("int"))
    right = right.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, _SALT], how).drop(_SALT)


def _dealt(df: DataFrame, parts: int) -> Column:
    """A part for each row by a hash of it, which a task that runs again repeats."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind]), F.lit(parts)).cast("int")


def full_in_cells(left: DataFrame, right: DataFrame, left_key: str, right_key: str, pairs: int = CELL_PAIRS) -> DataFrame:
    """FULL JOIN ON left_key = right_key for keys with many rows on both sides, whose pairs outgrow the input.

    The rows of a key are dealt to parts on either side, so that a cell, one part by another, has about `pairs` pairs at most.
    Cells are spread over a number of tasks that goes with all pairs; rows without a partner are added.  Both sides are counted
    by key first.  Their columns must have different names.
    """
    key, row, column = cell = ["__ms_key", "__ms_row", "__ms_column"]
    left_keys, right_keys = (df.groupBy(F.col(c).alias(key)).agg(F.count("*").cast("double").alias(n)) for df, c, n in ((left, left_key, "n"), (right, right_key, "m")))
    made = F.coalesce(F.col("n") * F.col("m"), F.lit(0.0))
    most, rows = left_keys.join(right_keys, key, "full").agg(F.max(made), F.sum(made + F.coalesce("n", F.lit(0.0)) + F.coalesce("m", F.lit(0.0)))).first()
    side = max(1, math.ceil(math.sqrt((most or 0) / pairs)))
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, math.ceil((rows or 0) / pairs))
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    a = left.select("*", F.col(left_key).alias(key), _dealt(left, side).alias(row)).withColumn(column, every)
    b = right.select("*", F.col(right_key).alias(key), _dealt(right, side).alias(column)).withColumn(row, every)
    # A stated number of partitions is not coalesced by the size of what goes in, which says little of what comes out.
    both = a.repartition(tasks, *cell).join(b.repartition(tasks, *cell), cell).drop(*cell)
    for df, c, others in ((left, left_key, right_keys), (right, right_key, left_keys)):
        both = both.unionByName(df.join(others.select(key), F.col(c) == F.col(key), "left_anti"), allowMissingColumns=True)
    return both


def lateral_top(left: DataFrame, right: DataFrame, on: Column, left_key: list[str], order: list[Column], n: int, outer: bool = False) -> DataFrame:
    """LATERAL (SELECT ... WHERE on ORDER BY order LIMIT n): a join and a rank, so all left rows run at once.

    left_key must identify left rows.
    """
    rank = F.row_number().over(Window.partitionBy(*left_key).orderBy(*order))
    joined = left.join(right, on, "left" if outer else "inner").withColumn("__ms_rank", rank)
    return joined.where(F.col("__ms_rank") <= n).drop("__ms_rank")


def exists(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    return left.join(right, on, "left_semi")


def not_exists(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Rows with low <= point < high, as an equality join on buckets of `width` that a span overlaps, then a filter.

    A span is repeated for each bucket that it overlaps, so width should be near the usual span.
    """
    bucket = "__ms_bucket"
    p = points.withColumn(bucket, F.floor(F.col(point).cast("double") / width))
    first, last = (F.floor(F.col(c).cast("double") / width) for c in (low, high))
    s = spans.where(F.col(low) < F.col(high)).withColumn(bucket, F.explode(F.sequence(first, last)))
    return p.join(s, (p[bucket] == s[bucket]) & (p[point] >= s[low]) & (p[point] < s[high]), how).drop(bucket)
