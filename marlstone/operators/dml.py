"""INSERT, UPSERT, UPDATE, DELETE and TRUNCATE as copy-on-write: each gives the new table, and the rows for RETURNING."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Changed:
    """The table after a statement, and the rows that it touched."""

    table: DataFrame
    returning: DataFrame


def _shaped(rows: DataFrame, target: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """rows with target's columns and types; a missing column takes its default or NULL."""
    have = set(rows.columns)
    unknown = have - set(target.columns)
    if unknown:
        raise ValueError(f"columns {sorted(unknown)} do not exist")
    value = lambda f: rows[f.name] if f.name in have else defaults.get(f.name, F.lit(None))
    return rows.select(*[value(f).cast(f.dataType).alias(f.name) for f in target.schema])


def insert(target: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> Changed:
    new = _shaped(rows, target, defaults or {})
    return Changed(target.unionAll(new), new)


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str]) -> Changed:
    """ON CONFLICT (key) DO NOTHING; of new rows with one key the first by all columns stays.  NULL keys never conflict."""
    new = _shaped(rows, target, {})
    from .distinct import first_per_group

    bare = " OR ".join(f"`{k}` IS NULL" for k in key)
    one = first_per_group(new.where(f"NOT ({bare})"), key, [F.col(c).asc_nulls_last() for c in target.columns])
    fresh = one.join(target.select(*key), key, "left_anti").select(*target.columns).unionAll(new.where(bare))
    return Changed(target.unionAll(fresh), fresh)


def upsert(target: DataFrame, rows: DataFrame, key: list[str], sets: dict[str, Column] | None = None, where: Column | None = None) -> Changed:
    """ON CONFLICT (key) DO UPDATE.  sets: column -> value over aliases t (the table) and excluded; all other columns of
    `rows` by default.  Two new rows with one key raise, as a statement may not touch a row twice."""
    new = _shaped(rows, target, {})
    twice = new.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.raise_error(F.lit("ON CONFLICT DO UPDATE command cannot affect row a second time")).alias("e"))
    checked = new.withColumn("__ms_new", F.lit(True))
    sets = sets if sets is not None else {c: F.col(f"excluded.{c}") for c in rows.columns if c not in key}
    t, x = target.withColumn("__ms_old", F.lit(True)).alias("t"), checked.alias("excluded")
    on = [F.col(f"t.{k}") == F.col(f"excluded.{k}") for k in key]
    both = t.join(x, on, "full")
    old, fresh = F.col("t.__ms_old").isNotNull(), F.col("excluded.__ms_new").isNotNull()
    hit = old & fresh if where is None else old & fresh & F.coalesce(where, F.lit(False))
    kinds = {f.name: f.dataType for f in target.schema}
    value = lambda c: F.when(hit, sets[c].cast(kinds[c]) if c in sets else F.col(f"t.{c}")).when(old, F.col(f"t.{c}")).otherwise(F.col(f"excluded.{c}")).alias(c)
    out = both.select(*[value(c) for c in target.columns], (hit | ~old).alias("__ms_touched"))
    if not twice.isEmpty():
        raise ValueError("ON CONFLICT DO UPDATE command cannot affect row a second time")
    return Changed(out.drop("__ms_touched"), out.where("__ms_touched").drop("__ms_touched"))


def update(target: DataFrame, sets: dict[str, Column], where: Column | None = None) -> Changed:
    """Values are over the old row."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    kinds = {f.name: f.dataType for f in target.schema}
    out = target.select(*[F.when(hit, sets[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in target.columns], hit.alias("__ms_hit"))
    return Changed(out.drop("__ms_hit"), out.where("__ms_hit").drop("__ms_hit"))


def update_from(target: DataFrame, source: DataFrame, key: list[str], sets: dict[str, Column], order: list[Column] | None = None) -> Changed:
    """UPDATE ... FROM source WHERE t.key = s.key; of several source rows the first in `order` (or by all columns) counts."""
    from .distinct import first_per_group

    one = first_per_group(source, key, order or [F.col(c).asc_nulls_last() for c in source.columns]).withColumn("__ms_hit", F.lit(True)).alias("s")
    both = target.alias("t").join(one, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in key], "left")
    hit = F.col("s.__ms_hit").isNotNull()
    kinds = {f.name: f.dataType for f in target.schema}
    out = both.select(*[F.when(hit, sets[c].cast(kinds[c])).otherwise(F.col(f"t.{c}")).alias(c) if c in sets else F.col(f"t.{c}") for c in target.columns], hit.alias("__ms_hit"))
    return Changed(out.drop("__ms_hit"), out.where("__ms_hit").drop("__ms_hit"))


def delete(target: DataFrame, where: Column) -> Changed:
    hit = F.coalesce(where, F.lit(False))
    return Changed(target.where(~hit), target.where(hit))


def delete_using(target: DataFrame, source: DataFrame, on: Column | list[str]) -> Changed:
    return Changed(target.join(source, on, "left_anti"), target.join(source, on, "left_semi"))


def truncate(target: DataFrame) -> Changed:
    return Changed(target.limit(0), target.limit(0))
