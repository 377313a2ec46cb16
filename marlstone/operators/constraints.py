"""Constraints as queries that find the rows which break them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Violation(ValueError):
    """A table breaks a constraint."""


def check(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which it is false; NULL passes."""
    return df.where(f"NOT ({condition})")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys of several rows; a key with a NULL is never equal to another."""
    return df.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def primary_key(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are NULL in part or belong to several rows."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1 OR " + " OR ".join(f"`{k}` IS NULL" for k in key))


def foreign_key(df: DataFrame, columns: list[str], parent: DataFrame, key: list[str]) -> DataFrame:
    """Rows without a parent; a NULL in the columns passes."""
    names = parent.select(*[F.col(k).alias(c) for k, c in zip(key, columns, strict=True)])
    return df.dropna(subset=columns).join(names, columns, "left_anti")


def on_delete(children: DataFrame, columns: list[str], deleted: DataFrame, key: list[str], action: str) -> DataFrame:
    """The child table after parents went: RESTRICT, CASCADE or SET NULL."""
    gone = deleted.select(*[F.col(k).alias(c) for k, c in zip(key, columns, strict=True)]).distinct()
    if action in ("RESTRICT", "NO ACTION"):
        if not children.join(gone, columns, "left_semi").isEmpty():
            raise Violation("rows are still referenced")
        return children
    if action == "CASCADE":
        return children.join(gone, columns, "left_anti")
    if action == "SET NULL":
        hit = children.join(gone.withColumn("__ms_gone", F.lit(True)), columns, "left")
        return hit.select(*[F.when(F.col("__ms_gone"), None).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in children.columns])
    raise ValueError(f"unknown action {action}")


def enforce(**found: DataFrame) -> None:
    """Raises for the first constraint that has a row."""
    for name, rows in found.items():
        first = rows.limit(1).collect()
        if first:
            raise Violation(f"constraint {name} is violated by {first[0].asDict()}")


def typed(df: DataFrame, limits: dict[str, tuple]) -> DataFrame:
    """Type modifiers: ("varchar", n), ("char", n), ("decimal", p, s), ("timestamp", p); too long a text raises."""
    out = df
    for c, (kind, *n) in limits.items():
        x = F.col(c)
        if kind in ("varchar", "char"):
            x = F.rtrim(x) if kind == "char" else x
            x = F.when(F.length(x) > n[0], F.raise_error(F.lit(f"value too long for type {kind}({n[0]})")).cast("string")).otherwise(x)
        elif kind == "decimal":
            x = F.bround(x, n[1]).cast(f"decimal({n[0]},{n[1]})")
        elif kind == "timestamp":
            unit = 10 ** (6 - n[0])
            micros = F.unix_micros(x.cast("timestamp"))
            x = F.timestamp_micros((F.bround(micros / unit) * unit).cast("bigint"))
        out = out.withColumn(c, x)
    return out
