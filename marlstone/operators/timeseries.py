"""Time-series tables: date partitions and hashed shards, bucketing, gap filling, retention and row TTL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = "_day"
SHARD = "_shard"


def shard(key: Column | str, shards: int) -> Column:
    """A stable shard of a series."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def laid_out(df: DataFrame, series: str, at: str, shards: int = 1) -> DataFrame:
    """With the partition columns of a time-series table."""
    return df.withColumn(DAY, F.to_date(at)).withColumn(SHARD, shard(series, shards))


def write(df: DataFrame, path: str, series: str, at: str, shards: int = 1, mode: str = "append") -> None:
    """Files by day and shard, sorted by series and time, so that a window of one series reads a few row groups."""
    rows = laid_out(df, series, at, shards)
    rows.repartition(DAY, SHARD).sortWithinPartitions(DAY, SHARD, series, at).write.mode(mode).partitionBy(DAY, SHARD).parquet(path)


def window(df: DataFrame, series: str, at: str, one: str, start: dt.datetime, end: dt.datetime, shards: int | None = None) -> DataFrame:
    """start <= at < end of one series; days and the shard prune partitions."""
    rows = df.where((F.col(series) == one) & (F.col(at) >= F.lit(start)) & (F.col(at) < F.lit(end)))
    if DAY in df.columns:
        rows = rows.where(F.col(DAY).between(F.lit(start.date()), F.lit(end.date())))
    if shards and SHARD in df.columns:
        rows = rows.where(F.col(SHARD) == shard(F.lit(one), shards))
    return rows


def buckets(df: DataFrame, at: str, width: str, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Tumbling windows: bucket (its start), keys, aggregates."""
    return df.groupBy(F.window(at, width).alias("w"), *by).agg(*aggregates).select(F.col("w.start").alias("bucket"), *by, *[c for c in df.limit(0).groupBy(*by).agg(*aggregates).columns if c not in by])


def filled(rolled: DataFrame, seconds: int, by: list[str]) -> DataFrame:
    """Rows for the empty buckets between a key's first and last, with NULL aggregates."""
    span = rolled.groupBy(*by).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    every = span.select(*by, F.explode(F.sequence("a", "b", F.make_dt_interval(secs=F.lit(seconds)))).alias("bucket"))
    return every.join(rolled, ["bucket", *by], "left")


def last_value_carried(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def retained(df: DataFrame, at: str, retention: dt.timedelta, now: dt.datetime) -> DataFrame:
    """What a maintenance rewrite keeps."""
    return df.where(F.col(at) > F.lit(now - retention))


def expired(df: DataFrame, column: str, now: dt.datetime) -> DataFrame:
    """Row TTL: rows whose expiry has come; NULL never expires."""
    return df.where(F.col(column) <= F.lit(now))


def swept(df: DataFrame, column: str, now: dt.datetime) -> DataFrame:
    """The table after the TTL job."""
    return df.where(F.col(column).isNull() | (F.col(column) > F.lit(now)))


def reshard(df: DataFrame, series: str, shards: int) -> DataFrame:
    return df.withColumn(SHARD, shard(series, shards))
