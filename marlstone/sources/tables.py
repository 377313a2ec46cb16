"""Tables: Parquet folders with a declared schema, views over them, snapshots for historical reads, catalog listings."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TESTDATA = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views; a view is a plan, nothing is read."""
    for name in names or TESTDATA:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


@dataclass
class Table:
    """A declared table and where its rows are."""

    name: str
    schema: StructType
    path: str
    primary_key: list[str] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    unique: list[list[str]] = field(default_factory=list)
    defaults: dict[str, Column] = field(default_factory=dict)
    policies: list[Column] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)


class Catalog:
    """Declared tables; every write is a new snapshot folder, so readers and historical reads see whole states."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables: dict[str, Table] = {}
        self.snapshots: dict[str, list[tuple[dt.datetime, str]]] = {}
        self.enums: dict[str, list[str]] = {}
        self.comments: dict[str, str] = {}

    def create(self, name: str, schema: StructType, **how) -> Table:
        if name in self.tables:
            raise ValueError(f"relation {name} already exists")
        self.tables[name] = Table(name, schema, f"{self.root}/{name}", **how)
        self.snapshots[name] = []
        self.replace(name, self.spark.createDataFrame([], schema))
        return self.tables[name]

    def create_as(self, name: str, rows: DataFrame, data: bool = True, **how) -> Table:
        """CREATE TABLE AS [WITH NO DATA]."""
        made = self.create(name, rows.schema, **how)
        if data:
            self.replace(name, rows)
        return made

    def create_like(self, name: str, other: str) -> Table:
        t = self.tables[other]
        return self.create(name, t.schema, primary_key=list(t.primary_key), checks=dict(t.checks), unique=list(t.unique), defaults=dict(t.defaults))

    def drop(self, name: str) -> None:
        del self.tables[name], self.snapshots[name]
        self.spark.catalog.dropTempView(name)

    def replace(self, name: str, rows: DataFrame) -> None:
        """A new state, after its constraints have been checked."""
        from ..operators import constraints as c

        t = self.tables[name]
        path = f"{t.path}/snapshot={uuid.uuid4().hex}"
        rows.write.parquet(path)
        written = self.spark.read.schema(t.schema).parquet(path)
        found = {f"{name}_check_{k}": c.check(written, v) for k, v in t.checks.items()}
        found |= {f"{name}_{f.name}_not_null": c.not_null(written, f.name) for f in t.schema if not f.nullable}
        if t.primary_key:
            found[f"{name}_pkey"] = c.primary_key(written, t.primary_key)
        found |= {f"{name}_unique_{'_'.join(u)}": c.unique(written, u) for u in t.unique}
        c.enforce(**found)
        self.snapshots[name].append((dt.datetime.now(dt.UTC), path))
        self.read(name).createOrReplaceTempView(name)

    def read(self, name: str, as_of: dt.datetime | str | None = None) -> DataFrame:
        """The rows now, or AS OF SYSTEM TIME: an instant, or a past offset like '-5s'; policies filter either."""
        t, states = self.tables[name], self.snapshots[name]
        if isinstance(as_of, str):
            unit = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}[as_of[-1]]
            as_of = dt.datetime.now(dt.UTC) + dt.timedelta(**{unit: float(as_of[:-1])})
        if as_of is not None:
            states = [s for s in states if s[0] <= as_of]
            if not states:
                raise LookupError(f"relation {name} does not exist at {as_of}")
        rows = self.spark.read.schema(t.schema).parquet(states[-1][1])
        for policy in t.policies:
            rows = rows.where(policy)
        return rows

    def alter(self, name: str, add: dict[str, tuple[str, Column]] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None, retype: dict[str, str] | None = None) -> None:
        """Columns added (type, value), dropped, renamed or cast; a rewrite."""
        t, rows = self.tables[name], self.read(name)
        for c, (kind, value) in (add or {}).items():
            rows = rows.withColumn(c, value.cast(kind))
        rows = rows.drop(*(drop or []))
        for a, b in (rename or {}).items():
            rows = rows.withColumnRenamed(a, b)
        for c, kind in (retype or {}).items():
            rows = rows.withColumn(c, F.col(c).cast(kind))
        t.schema = rows.schema
        t.primary_key = [(rename or {}).get(k, k) for k in t.primary_key]
        for a, b in (rename or {}).items():
            t.checks = {k: re.sub(rf"\b{re.escape(a)}\b", b, v) for k, v in t.checks.items()}
        self.replace(name, rows)

    def create_enum(self, name: str, labels: list[str]) -> None:
        self.enums[name] = list(labels)

    def enum_order(self, name: str, x: Column) -> Column:
        """The ordinal to sort by; an unknown label raises."""
        labels = self.enums[name]
        at = F.array_position(F.array(*map(F.lit, labels)), x)
        return F.when(x.isNotNull() & (at == 0), F.raise_error(F.lit(f"invalid input value for enum {name}")).cast("bigint")).otherwise(at)

    def show_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(n, len(t.schema)) for n, t in sorted(self.tables.items())], "table_name string, columns int")

    def show_columns(self, name: str) -> DataFrame:
        t = self.tables[name]
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable, f.name in t.primary_key) for f in t.schema], "column_name string, data_type string, is_nullable boolean, primary_key boolean")

    def show_create(self, name: str) -> str:
        t = self.tables[name]
        lines = [f"  {f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in t.schema]
        lines += [f"  PRIMARY KEY ({', '.join(t.primary_key)})"] if t.primary_key else []
        lines += [f"  CONSTRAINT {k} CHECK ({v})" for k, v in t.checks.items()]
        return f"CREATE TABLE {name} (\n" + ",\n".join(lines) + "\n)"

    def information_schema_columns(self) -> DataFrame:
        rows = [(n, f.name, i, f.dataType.simpleString(), "YES" if f.nullable else "NO") for n, t in sorted(self.tables.items()) for i, f in enumerate(t.schema, 1)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")


def statistics(df: DataFrame) -> DataFrame:
    """ANALYZE: one row per column with rows, NULLs, distinct values (HyperLogLog), in one pass."""
    counts = [F.struct(F.lit(c).alias("column_name"), F.count("*").alias("row_count"), F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias("null_count"), F.approx_count_distinct(f"`{c}`").alias("distinct_count")) for c in df.columns]
    return df.agg(F.array(*counts).alias("a")).select(F.inline("a"))


def values(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A VALUES list; types meet across rows."""
    kinds = []
    for column in zip(*rows, strict=True):
        found = {type(v) for v in column if v is not None}
        kinds.append("bigint" if found <= {int} and found else "double" if found <= {int, float} and found else "boolean" if found == {bool} else "string")
    cast = {"bigint": int, "double": float, "boolean": bool, "string": str}
    data = [tuple(None if v is None else cast[k](v) for v, k in zip(r, kinds, strict=True)) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))
