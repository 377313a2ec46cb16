"""Streams of events: tumbling, sliding and session windows with watermarks, deduplication, per-key state, and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema, most_files: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", most_files) if most_files else r).parquet(path)


def _flat(df: DataFrame, by: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in ("w", *by)]
    return df.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *rest)


def tumbling(df: DataFrame, at: str, width: str, by: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    rows = df.withWatermark(at, late) if late else df
    return _flat(rows.groupBy(F.window(at, width).alias("w"), *by).agg(*aggregates), by)


def sliding(df: DataFrame, at: str, width: str, step: str, by: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    rows = df.withWatermark(at, late) if late else df
    return _flat(rows.groupBy(F.window(at, width, step).alias("w"), *by).agg(*aggregates), by)


def sessions(df: DataFrame, at: str, gap: str, by: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    rows = df.withWatermark(at, late) if late else df
    return _flat(rows.groupBy(F.session_window(at, gap).alias("w"), *by).agg(*aggregates), by)


def once(df: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """First arrival of each key within the watermark."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, total after each batch that touches the key: custom state in Arrow batches."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for p in parts:
            n, total = n + len(p), total + float(p[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = dict(df.dtypes)[key]
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def run_to_end(df: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append") -> DataFrame:
    """Everything that is there now, into an in-memory table."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def to_parquet(df: DataFrame, path: str, checkpoint: str):
    """An exactly-once file sink."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
