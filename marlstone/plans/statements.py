"""Statements that change declared tables, as text: each is read into clauses and handed to the catalog and `operators.dml`."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import dml
from .dialect import TYPES, _Text, rewrite

if TYPE_CHECKING:
    from .engine import Engine

HEADS = ("INSERT", "UPSERT", "UPDATE", "DELETE", "TRUNCATE", "CREATE", "DROP")


class Statements:
    def __init__(self, engine: Engine):
        if engine.catalog is None:
            raise ValueError("statements that change tables need an engine with a root folder")
        self.engine, self.spark, self.catalog = engine, engine.spark, engine.catalog

    def run(self, text: str) -> DataFrame:
        t = _Text(text.strip().rstrip(";"))
        return getattr(self, "_" + t.items[0][1].lower())(t)

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "done string")

    def _query(self, text: str) -> DataFrame:
        return self.spark.sql(rewrite(text, self.spark))

    def _expression(self, text: str):
        return F.expr(rewrite(text, self.spark))

    @staticmethod
    def _cut(t: _Text, first: int, *words: str) -> tuple[dict[str, tuple[int, int]], int]:
        """The clauses that start with these words, in their order, as ranges; and where the first of them starts."""
        at = [(k, w) for w in words if (k := t.find(first, len(t.items), w)) is not None]
        at.sort()
        ends = [*(k for k, _ in at[1:]), len(t.items)] if at else []
        return {w: (k, e) for (k, w), e in zip(at, ends, strict=True)}, at[0][0] if at else len(t.items)

    def _sets(self, t: _Text, a: int, b: int) -> dict[str, str]:
        """Column -> expression of a SET list."""
        return {t.items[i][1].strip('"'): t.text(i + 2, j) for i, j in t.parts(a, b)}

    def _finish(self, name: str, changed: dml.Changed, t: _Text, returning: tuple[int, int] | None) -> DataFrame:
        if returning is None:
            self.catalog.replace(name, changed.table)
            return self._none()
        # The rows are read from the old state, which stays as it is.
        view = f"ms_returning_{uuid.uuid4().hex[:12]}"
        changed.returning.createOrReplaceTempView(view)
        rows = self._query(f"SELECT {t.text(returning[0] + 1, returning[1])} FROM {view} AS {name}")
        self.catalog.replace(name, changed.table)
        return rows

    def _rows(self, t: _Text, name: str, a: int, b: int, columns: list[str]) -> DataFrame:
        if t.is_word(a, "DEFAULT"):
            return self.spark.range(1).select()
        source = t.text(a, b)
        rows = self._query(source if not t.is_word(a, "VALUES") else f"SELECT * FROM ({source})")
        wanted = columns or self.catalog.tables[name].schema.names[: len(rows.columns)]
        if len(wanted) != len(rows.columns):
            raise ValueError(f"INSERT has {len(rows.columns)} expressions for {len(wanted)} columns")
        return rows.toDF(*wanted)

    def _insert(self, t: _Text, upsert: bool = False) -> DataFrame:
        name = t.items[2][1].strip('"')
        table, target = self.catalog.tables[name], self.catalog.read(name)
        at, columns = 3, []
        if t.is_op(3, "("):
            end = t.close(3)
            columns, at = [t.items[a][1].strip('"') for a, _ in t.parts(4, end)], end + 1
        clauses, stop = self._cut(t, at, "ON", "RETURNING")
        if "ON" in clauses and not t.is_word(clauses["ON"][0] + 1, "CONFLICT"):
            clauses, stop = self._cut(t, at, "RETURNING")
        rows = self._rows(t, name, at, stop, columns)
        returning = clauses.get("RETURNING")
        if not upsert and "ON" not in clauses:
            return self._finish(name, dml.insert(target, rows, table.defaults), t, returning)
        key = table.primary_key
        full = dml.insert(target.limit(0), rows, table.defaults).returning
        if upsert:
            return self._finish(name, dml.upsert(target, full, key, {c: F.col(f"excluded.{c}") for c in rows.columns if c not in key}), t, returning)
        a, b = clauses["ON"]
        if t.is_op(a + 2, "("):
            end = t.close(a + 2)
            key, a = [t.items[i][1].strip('"') for i, _ in t.parts(a + 3, end)], end - 1
        if t.is_word(a + 3, "NOTHING"):
            return self._finish(name, dml.insert_ignore(target, full, key), t, returning)
        where = t.find(a + 5, b, "WHERE")
        # Bare columns are the table's, as in the statement.
        owned = lambda x: re.sub(rf"(?<![\w.'])({'|'.join(map(re.escape, target.columns))})\b(?!\s*[(.'])", r"t.\1", x.replace(f"{name}.", "t."))
        sets = {c: self._expression(owned(e)) for c, e in self._sets(t, a + 5, where or b).items()}
        return self._finish(name, dml.upsert(target, full, key, sets, self._expression(owned(t.text(where + 1, b))) if where else None), t, returning)

    def _upsert(self, t: _Text) -> DataFrame:
        return self._insert(t, True)

    def _update(self, t: _Text) -> DataFrame:
        name = t.items[1][1].strip('"')
        clauses, _ = self._cut(t, 2, "SET", "FROM", "WHERE", "RETURNING")
        table, target = self.catalog.tables[name], self.catalog.read(name)
        sets = self._sets(t, clauses["SET"][0] + 1, clauses["SET"][1])
        where = t.text(clauses["WHERE"][0] + 1, clauses["WHERE"][1]) if "WHERE" in clauses else "true"
        if "FROM" in clauses:
            self._keyed(name)
            values = ", ".join([*(f"{name}.{k}" for k in table.primary_key), *(f"{e} AS ms_value_{i}" for i, e in enumerate(sets.values()))])
            source = self._query(f"SELECT {values} FROM {name}, {t.text(clauses['FROM'][0] + 1, clauses['FROM'][1])} WHERE {where}")
            changed = dml.update_from(target, source, table.primary_key, {c: F.col(f"s.ms_value_{i}") for i, c in enumerate(sets)})
        else:
            changed = dml.update(target, {c: self._expression(e) for c, e in sets.items()}, self._expression(where))
        return self._finish(name, changed, t, clauses.get("RETURNING"))

    def _delete(self, t: _Text) -> DataFrame:
        name = t.items[2][1].strip('"')
        clauses, _ = self._cut(t, 3, "USING", "WHERE", "RETURNING")
        table, target = self.catalog.tables[name], self.catalog.read(name)
        where = t.text(clauses["WHERE"][0] + 1, clauses["WHERE"][1]) if "WHERE" in clauses else "true"
        if "USING" in clauses or t.find(clauses.get("WHERE", (len(t.items),))[0], len(t.items), "SELECT") or "SELECT" in where.upper().split():
            self._keyed(name)
            more = f", {t.text(clauses['USING'][0] + 1, clauses['USING'][1])}" if "USING" in clauses else ""
            found = self._query(f"SELECT DISTINCT {', '.join(f'{name}.{k}' for k in table.primary_key)} FROM {name}{more} WHERE {where}")
            changed = dml.delete_using(target, found, table.primary_key)
        else:
            changed = dml.delete(target, self._expression(where))
        return self._finish(name, changed, t, clauses.get("RETURNING"))

    def _keyed(self, name: str) -> None:
        if not self.catalog.tables[name].primary_key:
            raise ValueError(f"{name} has no primary key to find its rows by")

    def _truncate(self, t: _Text) -> DataFrame:
        first = 1 + t.is_word(1, "TABLE")
        for a, _ in t.parts(first, len(t.items)):
            name = t.items[a][1].strip('"')
            self.catalog.replace(name, dml.truncate(self.catalog.read(name)).table)
        return self._none()

    def _create(self, t: _Text) -> DataFrame:
        if t.is_word(1, "OR") or t.is_word(1, "VIEW"):
            return self.spark.sql(re.sub(r"^CREATE\s+(OR\s+REPLACE\s+)?VIEW", "CREATE OR REPLACE TEMPORARY VIEW", rewrite(t.text(), self.spark), flags=re.I))
        at = 2 if t.is_word(1, "TABLE") else 3
        if not t.is_word(at - 1, "TABLE"):
            raise SyntaxError("only tables and views can be created")
        if t.is_word(at, "IF"):
            at += 3
            if t.items[at][1].strip('"') in self.catalog.tables:
                return self._none()
        name = t.items[at][1].strip('"')
        if t.is_word(at + 1, "AS"):
            bare = t.is_word(len(t.items) - 2, "NO") and t.is_word(len(t.items) - 1, "DATA")
            self.catalog.create_as(name, self._query(t.text(at + 2, len(t.items) - 3 * bare)), data=not bare)
            return self._none()
        if t.is_word(at + 2, "LIKE"):
            self.catalog.create_like(name, t.items[at + 3][1].strip('"'))
            return self._none()
        columns, how = [], {"primary_key": [], "unique": [], "checks": {}, "defaults": {}}
        for a, b in t.parts(at + 2, t.close(at + 1)):
            if t.is_word(a, "CONSTRAINT"):
                label, a = t.items[a + 1][1], a + 2
            else:
                label = f"c{len(how['checks'])}"
            names = lambda k: [t.items[i][1].strip('"') for i, _ in t.parts(k + 1, t.close(k))]
            if t.is_word(a, "PRIMARY"):
                how["primary_key"] = names(a + 2)
            elif t.is_word(a, "UNIQUE"):
                how["unique"].append(names(a + 1))
            elif t.is_word(a, "CHECK"):
                how["checks"][label] = rewrite(t.text(a + 2, t.close(a + 1)), self.spark)
            else:
                columns.append(self._column(t, a, b, how))
        key = set(how["primary_key"])
        schema = StructType.fromDDL(", ".join(f"`{c}` {kind}{' NOT NULL' if bare or c in key else ''}" for c, kind, bare in columns))
        self.catalog.create(name, schema, **how)
        return self._none()

    def _column(self, t: _Text, a: int, b: int, how: dict) -> tuple[str, str, bool]:
        """One column's name, type and whether NULL is refused; its constraints go to `how`."""
        name, kind = t.items[a][1].strip('"'), t.items[a + 1][1].lower()
        k = a + 2
        if kind == "double" and t.is_word(k, "PRECISION"):
            k += 1
        spark_kind = TYPES.get(kind, kind)
        if t.is_op(k, "("):
            end = t.close(k)
            spark_kind = f"decimal({t.text(k + 1, end)})" if kind in ("numeric", "decimal") else spark_kind
            k = end + 1
        if t.is_op(k, "[") and t.is_op(k + 1, "]"):
            spark_kind, k = f"array<{spark_kind}>", k + 2
        bare = False
        while k < b:
            if t.is_word(k, "NOT"):
                bare, k = True, k + 2
            elif t.is_word(k, "PRIMARY"):
                how["primary_key"], k = [name], k + 2
            elif t.is_word(k, "UNIQUE"):
                how["unique"].append([name])
                k += 1
            elif t.is_word(k, "CHECK"):
                end = t.close(k + 1)
                how["checks"][f"{name}_{len(how['checks'])}"] = rewrite(t.text(k + 2, end), self.spark)
                k = end + 1
            elif t.is_word(k, "DEFAULT"):
                end = t.operand_end(k + 1)
                how["defaults"][name] = self._expression(t.text(k + 1, end))
                k = end
            elif t.is_word(k, "NULL"):
                k += 1
            else:
                raise SyntaxError(f"column clause {t.items[k][1]}")
        return name, spark_kind, bare

    def _drop(self, t: _Text) -> DataFrame:
        at = 2
        if t.is_word(2, "IF"):
            at = 4
        name = t.items[at][1].strip('"')
        if at == 2 or name in self.catalog.tables:
            self.catalog.drop(name)
        return self._none()


def historical(engine: Engine, text: str) -> str:
    """SELECT ... AS OF SYSTEM TIME when: the statement over the tables' states of then.

    when: an offset like '-5s', an instant, or with_max_staleness / with_min_timestamp, for which the newest state will do.
    """
    t = _Text(text.strip().rstrip(";"))
    at = next((k for k in range(len(t.items)) if t.is_word(k, "AS") and t.is_word(k + 1, "OF") and t.is_word(k + 2, "SYSTEM")), None)
    if at is None:
        return text
    if engine.catalog is None:
        raise ValueError("AS OF SYSTEM TIME needs an engine with a root folder")
    end = t.operand_end(at + 4)
    when = t.text(at + 4, end)
    if when.lower().startswith("with_"):
        then = None
    else:
        when = when.strip("'")
        then = when if when.startswith("-") else dt.datetime.fromisoformat(when)
        then = then.replace(tzinfo=dt.UTC) if isinstance(then, dt.datetime) and then.tzinfo is None else then
    del t.items[at:end]
    views: dict[str, str] = {}
    for k, (kind, x) in enumerate(t.items):
        name = x.strip('"')
        if kind in ("word", "quoted") and name in engine.catalog.tables and (t.is_word(k - 1, "FROM", "JOIN") or t.is_op(k - 1, ",")):
            if name not in views:
                views[name] = f"ms_then_{uuid.uuid4().hex[:12]}"
                engine.catalog.read(name, then).createOrReplaceTempView(views[name])
            follows = t.items[k + 1] if k + 1 < len(t.items) else ("", "")
            alias = follows[0] == "word" and follows[1].upper() not in ("WHERE", "JOIN", "ON", "GROUP", "ORDER", "LIMIT", "LEFT", "RIGHT", "FULL", "CROSS", "INNER", "UNION", "HAVING")
            t.items[k] = ("word", views[name] if alias else f"{views[name]} AS {name}")
    return t.text()
