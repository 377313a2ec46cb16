"""The session that a user talks to: SQL text in, DataFrames out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import session as settings
from ..sources.tables import Catalog, register, statistics
from .dialect import rewrite
from .statements import HEADS, Statements, historical


def spark_session(master: str = "local[*]", **conf) -> SparkSession:
    """ANSI arithmetic, UTC, adaptive plans; further settings by keyword with _ for dots."""
    b = SparkSession.builder.master(master).appName("marlstone")
    fixed = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.cteRecursionLevelLimit": "10000", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (fixed | {k.replace("_", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


class Engine:
    """PostgreSQL-flavoured SQL over registered tables."""

    def __init__(self, spark: SparkSession | None = None, root: str | None = None):
        self.spark = spark or spark_session()
        self.catalog = Catalog(self.spark, root) if root else None
        self.prepared: dict[str, str] = {}

    def register(self, sf_dir: str, *names: str) -> Engine:
        register(self.spark, sf_dir, *names)
        return self

    def sql(self, text: str, *params) -> DataFrame:
        """SELECT (also AS OF SYSTEM TIME), INSERT, UPSERT, UPDATE, DELETE, TRUNCATE, CREATE, DROP, WITH, VALUES, SHOW, EXPLAIN, ANALYZE, SET, PREPARE and EXECUTE; $1, $2, ... are params."""
        head = text.strip().split(None, 1)[0].upper() if text.strip() else ""
        if head in ("SET", "SHOW", "EXPLAIN", "ANALYZE", "PREPARE", "EXECUTE", "RESET"):
            return getattr(self, "_" + head.lower())(text.strip().rstrip(";"))
        if head in HEADS and self.catalog is not None:
            return Statements(self).run(text)
        text = historical(self, text)
        return self.spark.sql(rewrite(text, self.spark), args={f"p{i}": v for i, v in enumerate(params, 1)} or None)

    def _one(self, name: str, rows: list) -> DataFrame:
        return self.spark.createDataFrame([(r,) for r in rows], f"`{name}` string")

    def _set(self, text: str) -> DataFrame:
        m = re.match(r"SET\s+(?:SESSION\s+|LOCAL\s+)?([\w.]+)\s*(?:=|TO)\s*(.+)$", text, re.I | re.S)
        settings.SETTINGS.values[m[1].lower()] = m[2].strip().strip("'")
        return self._one("set", [])

    def _reset(self, text: str) -> DataFrame:
        settings.SETTINGS.values.pop(text.split()[1].lower(), None)
        return self._one("reset", [])

    def _show(self, text: str) -> DataFrame:
        words = text.split()
        if words[1].upper() == "TABLES":
            return self.spark.sql("SHOW TABLES").selectExpr("tableName AS table_name")
        if words[1].upper() == "COLUMNS":
            return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in self.spark.table(words[-1]).schema], "column_name string, data_type string, is_nullable boolean")
        if words[1].upper() == "CREATE" and self.catalog:
            return self._one("create_statement", [self.catalog.show_create(words[-1])])
        if words[1].upper() == "STATS":
            return statistics(self.spark.table(words[-1]))
        return self._one(words[1], [settings.SETTINGS.values[words[1].lower()]])

    def _explain(self, text: str) -> DataFrame:
        m = re.match(r"EXPLAIN\s+(ANALYZE\s+)?(.*)$", text, re.I | re.S)
        df = self.sql(m[2])
        plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        rows = plan.splitlines()
        if m[1]:
            rows = [f"rows: {df.count()}", *rows]
        return self._one("info", rows)

    def _analyze(self, text: str) -> DataFrame:
        return statistics(self.spark.table(text.split()[-1]))

    def _prepare(self, text: str) -> DataFrame:
        m = re.match(r"PREPARE\s+(\w+)\s*(?:\([^)]*\))?\s+AS\s+(.*)$", text, re.I | re.S)
        self.prepared[m[1].lower()] = m[2]
        return self._one("prepare", [])

    def _execute(self, text: str) -> DataFrame:
        m = re.match(r"EXECUTE\s+(\w+)\s*(?:\((.*)\))?$", text, re.I | re.S)
        args = [] if not m[2] else list(self.spark.sql(f"SELECT {m[2]}").first())
        return self.sql(self.prepared[m[1].lower()], *args)

    def cursor(self, text: str, *params):
        """Rows one partition at a time."""
        return self.sql(text, *params).toLocalIterator(prefetchPartitions=True)
