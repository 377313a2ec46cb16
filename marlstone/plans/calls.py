"""Function calls and operators of SQL text, built as Columns by the function library and given back as Spark SQL text.

A builder gets literals as plain values and everything else as a placeholder; the Column's own text form is then the expression,
with the arguments' texts put in.  Python functions are registered with the session under names of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, jsonb, registry, text_search, vectors
from ..functions import math as m
from ..text import query as q

#: Marks arguments that aren't literals.
UNKNOWN = object()
#: Names that stay with Spark, whose meaning is the same.
SPARKS = {"coalesce", "nullif", "greatest", "least", "concat", "lower", "upper", "abs", "md5", "current_date", "now", "current_timestamp"}
AGGREGATES: dict[str, Callable] = {
    "json_agg": jsonb.jsonb_agg,
    "jsonb_agg": jsonb.jsonb_agg,
    "json_agg_strict": lambda x: jsonb.jsonb_agg(x, strict=True),
    "jsonb_agg_strict": lambda x: jsonb.jsonb_agg(x, strict=True),
    "json_object_agg": jsonb.jsonb_object_agg,
    "jsonb_object_agg": jsonb.jsonb_object_agg,
    "json_object_agg_strict": lambda k, v: jsonb.jsonb_object_agg(k, v, strict=True),
    "jsonb_object_agg_strict": lambda k, v: jsonb.jsonb_object_agg(k, v, strict=True),
    "json_object_agg_unique": lambda k, v: jsonb.jsonb_object_agg(k, v, unique=True),
    "jsonb_object_agg_unique": lambda k, v: jsonb.jsonb_object_agg(k, v, unique=True),
}
#: Strings and quoted names, which stay; operators in call notation; doubles.
_FORMS = re.compile(r"(?P<keep>'(?:[^'\\]|\\.)*'|`[^`]*`)|(?P<op><=>|<=|>=|!=|==|[-+*/%<>=!&|^~]|\b(?:and|or|not|in|like|ilike|rlike)\b)\(|(?<![\w.])(?P<number>\d+\.\d+(?:E[+-]?\d+)?)(?![\w.])|(?P<special>-?\bInfinity|\bNaN)\b")
_QUERIES = {"to_tsquery": q.to_query, "plainto_tsquery": q.plain, "phraseto_tsquery": q.phrase, "websearch_to_tsquery": q.websearch}
_TEXT_SEARCH = {"to_tsvector", "to_tsquery", "plainto_tsquery", "phraseto_tsquery", "websearch_to_tsquery", "ts_headline"}
_INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


def _spelled(form: re.Match) -> str:
    if form["op"]:
        return f"`{form['op']}`("
    if form["number"]:
        return form["number"] + "D"
    return f"double('{form['special']}')" if form["special"] else form[0]


def text_of(column: Column) -> str:
    """Spark SQL for a Column."""
    text = _FORMS.sub(_spelled, column._jc.node().sql())
    return re.sub(r"\b(timestampdiff|timestampadd)\('(\w+)'", r"\1(\2", text)


def _spaceless(text: str) -> str:
    return re.sub(r"\s", "", text)


def quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Calls:
    """What the rewrite asks about a session: types of its tables' columns, and texts of calls."""

    def __init__(self, spark: SparkSession, words: set[str]):
        self.spark, self.words = spark, words
        #: By text without spaces: what to_tsvector's calls were made of, and the values of constant queries.
        self.made_vectors: dict[str, tuple[str, str]] = {}
        self.made_queries: dict[str, str | None] = {}

    @cached_property
    def types(self) -> dict[str, set[str]]:
        """Type names by column, over the tables that the statement names."""
        found: dict[str, set[str]] = {}
        for t in self.spark.catalog.listTables():
            if t.name.lower() in self.words:
                for f in self.spark.table(t.name).schema:
                    found.setdefault(f.name.lower(), set()).add(f.dataType.simpleString())
        return found

    def integral(self, name: str) -> bool:
        own = self.types.get(name.lower())
        return bool(own) and own <= _INTEGRAL

    def is_array(self, name: str) -> bool:
        own = self.types.get(name.lower())
        return bool(own) and all(t.startswith("array") for t in own)

    def known(self, name: str) -> bool:
        from ..functions import load

        load()
        return name.lower() in registry.FUNCTIONS and name.lower() not in SPARKS

    def build(self, make: Callable[..., Column], args: list[tuple[str, object]]) -> str:
        slots = [F.expr(f"ms_arg_{i}") for i in range(len(args))]
        with registry.named_functions(self.spark):
            try:
                made = make(*[slot if x is UNKNOWN else x for slot, (_, x) in zip(slots, args, strict=True)])
            except (TypeError, AttributeError):
                made = make(*slots)
            text = text_of(made)
        return re.sub(r"\bms_arg_(\d+)\b", lambda k: f"({args[int(k[1])][0]})", text)

    def call(self, name: str, args: list[tuple[str, object]]) -> str:
        # The configuration comes first in SQL, and last in the builders.
        if name.lower() in _TEXT_SEARCH and len(args) > 1 and args[0][1] in ("english", "simple", "words"):
            first, *rest = args
            args = [*rest[:2], *([("''", "")] if name.lower() == "ts_headline" and len(rest) < 3 else []), *rest[2:], first]
        if name.lower() == "array_fill":
            args = [args[0], (f"element_at({args[1][0]}, 1)", UNKNOWN)]
        made = self.build(registry.FUNCTIONS[name.lower()], args)
        values = [x for _, x in args]
        if name.lower() == "to_tsvector" and values[0] is UNKNOWN and all(isinstance(x, str) for x in values[1:]):
            self.made_vectors[_spaceless(made)] = (args[0][0], *values[1:])
        elif name.lower() in _QUERIES and all(isinstance(x, str) for x in values):
            # Queries that differ in spaces only share a key, and are left to the text.
            key, value = _spaceless(made), q.show(_QUERIES[name.lower()](*values))
            self.made_queries[key] = value if self.made_queries.get(key, value) == value else None
        return made

    def match(self, vector: tuple[str, object], query: tuple[str, object]) -> str:
        """vector @@ query: a constant query is parsed once, and a text isn't made a vector for it."""
        value = query[1] if isinstance(query[1], str) else self.made_queries.get(_spaceless(query[0]))
        if value is None:
            return self.build(text_search.matches, [vector, query])
        made = self.made_vectors.get(_spaceless(vector[0]))
        if made is None:
            return self.build(lambda x: text_search.matches(x, value), [vector])
        text, *config = made
        return self.build(lambda x: text_search.text_matches(x, value, *config), [(text, UNKNOWN)])

    def operator(self, op: str, a: tuple[str, object], b: tuple[str, object], of_arrays: bool) -> str:
        """Of two operands."""
        if op == "->":
            return self.build(jsonb.get, [a, b])
        if op == "->>":
            return self.build(jsonb.get_text, [a, b])
        if op in ("#>", "#>>", "#-"):
            make = {"#>": lambda x, p: jsonb.get(x, *jsonb.path_of(p)), "#>>": lambda x, p: jsonb.get_text(x, *jsonb.path_of(p)), "#-": jsonb.delete_path}[op]
            return self.build(make, [a, b])
        if op in ("@>", "<@"):
            x, y = (a, b) if op == "@>" else (b, a)
            return self.build(arrays.contains if of_arrays else jsonb.jsonb_contains, [x, y])
        if op == "?":
            return self.build(jsonb.jsonb_exists, [a, b])
        if op in ("?|", "?&"):
            keys = re.findall(r"'((?:[^'\\]|\\.)*)'", b[0])
            return self.build(lambda x: (jsonb.exists_any if op == "?|" else jsonb.exists_all)(x, keys), [a])
        if op == "&&":
            return self.build(arrays.overlaps, [a, b])
        if op == "@@":
            return self.match(a, b)
        if op in ("<->", "<=>", "<#>"):
            make = {"<->": vectors.l2_distance, "<=>": vectors.cosine_distance, "<#>": lambda x, y: -vectors.inner_product(x, y)}[op]
            return self.build(make, [self.vector(a), self.vector(b)])
        if op == "^":
            return self.build(m.power, [a, b])
        if op == "#":
            return f"({a[0]} ^ {b[0]})"
        raise SyntaxError(f"operator {op}")

    @staticmethod
    def vector(x: tuple[str, object]) -> tuple[str, object]:
        """A vector in its text form as an array."""
        if isinstance(x[1], str):
            return "array(" + ", ".join(f"{float(v)!r}D" for v in x[1].strip("[] ").split(",")) + ")", UNKNOWN
        return f"cast({x[0]} as array<double>)", UNKNOWN
