"""JSON values as canonical text: keys sorted, the last of equal keys kept, numbers with the digits they were written with."""

from __future__ import annotations

import json
from decimal import Decimal
from functools import cmp_to_key

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import col, function, vectorised


class Number(str):
    """A number by its text."""

    __slots__ = ()

    @property
    def value(self) -> Decimal:
        return Decimal(self)


def parse(text: str):
    return json.loads(text, parse_float=Number, parse_int=Number, parse_constant=_refuse)


def _refuse(name: str):
    raise ValueError(f"invalid JSON number {name}")


def dump(x) -> str:
    if isinstance(x, Number):
        return str(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(v)}" for k, v in sorted(x.items(), key=lambda kv: kv[0].encode())) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(dump, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


def text_of(x) -> str | None:
    """As ->> gives it: strings bare, null as NULL."""
    return None if x is None else str(x) if isinstance(x, str) and not isinstance(x, Number) else dump(x)


def kind(x) -> str:
    for name, of in (("null", type(None)), ("boolean", bool), ("number", Number), ("string", str), ("array", list)):
        if isinstance(x, of):
            return name
    return "object"


_RANK = {"null": 0, "string": 1, "number": 2, "boolean": 3, "array": 4, "object": 5}


def compare(a, b) -> int:
    """The total order: null, strings, numbers, booleans, arrays, objects; more elements after fewer."""
    ka, kb = kind(a), kind(b)
    if ka != kb:
        return -1 if _RANK[ka] < _RANK[kb] else 1
    if ka == "number":
        a, b = a.value, b.value
    elif ka == "string":
        a, b = a.encode(), b.encode()
    elif ka in ("array", "object"):
        if len(a) != len(b):
            return -1 if len(a) < len(b) else 1
        if ka == "object":
            x, y = (sorted(o.items(), key=lambda kv: kv[0].encode()) for o in (a, b))
            a, b = [v for kv in x for v in kv], [v for kv in y for v in kv]
        return next((c for c in map(compare, a, b) if c), 0)
    elif ka == "null":
        return 0
    return (a > b) - (a < b)


sort_key = cmp_to_key(compare)


def contains(a, b, top: bool = True) -> bool:
    """a @> b."""
    ka, kb = kind(a), kind(b)
    if ka == kb == "object":
        return all(k in a and contains(a[k], v, False) for k, v in b.items())
    if ka == kb == "array":
        return all(any(contains(x, y, False) for x in a) for y in b)
    if top and ka == "array" and kb != "object":
        return any(compare(x, b) == 0 for x in a)
    return ka == kb and compare(a, b) == 0


def _step(x, key):
    if isinstance(x, dict):
        return x.get(str(key), _MISSING)
    if isinstance(x, list):
        try:
            i = int(key)
        except ValueError:
            return _MISSING
        return x[i] if -len(x) <= i < len(x) else _MISSING
    return _MISSING


class _Missing:
    """No such key.  Workers may hold copies of the one instance, so it is told by its class."""


_MISSING = _Missing()


def missing(x) -> bool:
    return isinstance(x, _Missing)


def walk(x, path):
    for key in path:
        x = _step(x, key)
        if missing(x):
            return x
    return x


def path_of(text) -> list[str]:
    """{a,b,0} or a list."""
    return list(text) if not isinstance(text, str) else [p.strip().strip('"') for p in text.strip().strip("{}").split(",") if p.strip()]


def _udf(result: str, f, strict: bool = True):
    """An Arrow UDF over JSON texts (and further arguments); NULL in, NULL out."""

    @vectorised(result)
    def udf(*xs: pd.Series) -> pd.Series:
        rows = zip(*(x.where(x.notna(), None).tolist() if x.dtype != object else x.tolist() for x in xs), strict=True)
        out = [None if strict and any(v is None for v in r) else f(*r) for r in rows]
        return pd.Series(out, dtype="Int64" if result == "long" else "boolean" if result == "boolean" else object)

    return udf


def canonical(j) -> Column:
    """Text as the jsonb type stores it; raises for invalid JSON."""
    return _udf("string", lambda x: dump(parse(x)))(col(j))


def get(j, *path) -> Column:
    """-> and #>: a JSON null stays null, a missing key is NULL."""

    def one(x):
        got = walk(parse(x), path)
        return None if missing(got) else dump(got)

    return _udf("string", one)(col(j))


def get_text(j, *path) -> Column:
    """->> and #>>."""

    def one(x):
        got = walk(parse(x), path)
        return None if missing(got) else text_of(got)

    return _udf("string", one)(col(j))


def flat_text(j, key: str) -> Column:
    """->> with one key of an object, without Python: the fast path for filters."""
    return F.get_json_object(col(j), f"$.{key}" if key.isidentifier() else f"$['{key}']")


@function("jsonb_extract_path", "json_extract_path")
def jsonb_extract_path(j, *path) -> Column:
    return get(j, *path)


@function("jsonb_extract_path_text", "json_extract_path_text")
def jsonb_extract_path_text(j, *path) -> Column:
    return get_text(j, *path)


def _flat_contains(parsed: Column, wanted) -> Column | None:
    """Whether a parsed object has these scalar values, without Python; None for other patterns."""
    if not isinstance(wanted, dict) or not wanted:
        return None
    out = F.lit(True)
    for key, value in wanted.items():
        if not key.isidentifier() or not key.isascii():
            return None
        path = f"$.{key}"
        shape = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
        if kind(value) == "string":
            same = (shape == "STRING") & (F.try_variant_get(parsed, path, "string") == value)
        elif kind(value) == "number" and str(value).lstrip("-").isdigit() and len(str(value)) < 16:
            whole = (shape == "BIGINT") & (F.try_variant_get(parsed, path, "bigint") == int(value))
            exact = F.startswith(shape, F.lit("DECIMAL")) & (F.try_variant_get(parsed, path, "decimal(38,18)") == F.lit(int(value)))
            same = whole | exact | (shape == "DOUBLE") & (F.try_variant_get(parsed, path, "double") == float(int(value)))
        else:
            return None
        out = out & F.coalesce(same, F.lit(False))
    return out


@function("jsonb_contains")
def jsonb_contains(j, pattern) -> Column:
    """@> ; a constant pattern is parsed once, and one of plain strings and integers is looked for in the JVM, where texts that can't match are not parsed."""
    if isinstance(pattern, str):
        wanted = parse(pattern)
        in_python = _udf("boolean", lambda x: contains(parse(x), wanted))
        parsed = F.try_parse_json(col(j))
        quick = _flat_contains(parsed, wanted)
        if quick is None:
            return in_python(col(j))
        # Values stand in the text as they are, unless it has escapes or exponents; only texts that may match are parsed.
        may = F.contains(col(j), F.lit("\\")) | F.rlike(col(j), F.lit("[0-9.][eE][-+]?[0-9]"))
        every = F.lit(True)
        for value in wanted.values():
            every = every & F.contains(col(j), F.lit(str(value)))
        may = F.coalesce(every | may, F.lit(False))
        # What the JVM's parser refuses, as repeated keys, goes to Python.
        return F.when(col(j).isNull(), None).when(~may, False).when(parsed.isNotNull(), quick).otherwise(in_python(F.when(may & parsed.isNull(), col(j))))
    return _udf("boolean", lambda x, y: contains(parse(x), parse(y)))(col(j), col(pattern))


@function("jsonb_exists")
def jsonb_exists(j, key: str) -> Column:
    """? ; object keys and array strings."""

    def one(x):
        v = parse(x)
        return key in v if isinstance(v, dict) else any(kind(e) == "string" and e == key for e in v) if isinstance(v, list) else kind(v) == "string" and v == key

    return _udf("boolean", one)(col(j))


def exists_any(j, keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | jsonb_exists(j, k)
    return out


def exists_all(j, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & jsonb_exists(j, k)
    return out


def concat(a, b) -> Column:
    """|| : objects merge, anything else joins as arrays."""

    def one(x, y):
        p, q = parse(x), parse(y)
        if isinstance(p, dict) and isinstance(q, dict):
            return dump({**p, **q})
        return dump((p if isinstance(p, list) else [p]) + (q if isinstance(q, list) else [q]))

    return _udf("string", one)(col(a), col(b))


def delete(j, key) -> Column:
    """- : a key, an array's equal strings, or an element by place."""

    def one(x):
        v = parse(x)
        if isinstance(key, int):
            if not isinstance(v, list):
                raise ValueError("cannot delete from object using integer index")
            if -len(v) <= key < len(v):
                del v[key]
            return dump(v)
        keys = [key] if isinstance(key, str) else list(key)
        return dump({k: e for k, e in v.items() if k not in keys} if isinstance(v, dict) else [e for e in v if not (kind(e) == "string" and e in keys)])

    return _udf("string", one)(col(j))


def delete_path(j, path) -> Column:
    """#-"""
    parts = path_of(path)

    def one(x):
        v = parse(x)
        at = walk(v, parts[:-1])
        if isinstance(at, dict):
            at.pop(parts[-1], None)
        elif isinstance(at, list) and not missing(_step(at, parts[-1])):
            del at[int(parts[-1])]
        return dump(v)

    return _udf("string", one)(col(j))


@function("jsonb_set")
def jsonb_set(j, path, new, create: bool = True) -> Column:
    parts = path_of(path)

    def one(x, y):
        v, put = parse(x), parse(y)
        if not parts:
            return dump(v)
        at = walk(v, parts[:-1])
        if isinstance(at, dict):
            if create or parts[-1] in at:
                at[parts[-1]] = put
        elif isinstance(at, list):
            if not missing(_step(at, parts[-1])):
                at[int(parts[-1])] = put
            elif create:
                at.insert(0, put) if int(parts[-1]) < 0 else at.append(put)
        return dump(v)

    return _udf("string", one)(col(j), col(new))


@function("jsonb_insert")
def jsonb_insert(j, path, new, after: bool = False) -> Column:
    parts = path_of(path)

    def one(x, y):
        v, put = parse(x), parse(y)
        at = walk(v, parts[:-1])
        if isinstance(at, dict):
            if parts[-1] in at:
                raise ValueError("cannot replace existing key")
            at[parts[-1]] = put
        elif isinstance(at, list):
            i = int(parts[-1])
            i = max(i + len(at), 0) if i < 0 else i
            at.insert(i + (1 if after else 0), put)
        return dump(v)

    return _udf("string", one)(col(j), col(new))


def _stripped(x):
    if isinstance(x, dict):
        return {k: _stripped(v) for k, v in x.items() if v is not None}
    return [_stripped(v) for v in x] if isinstance(x, list) else x


@function("jsonb_strip_nulls", "json_strip_nulls")
def jsonb_strip_nulls(j) -> Column:
    return _udf("string", lambda x: dump(_stripped(parse(x))))(col(j))


def _pretty(x, depth: int = 0) -> str:
    inner, outer = "    " * (depth + 1), "    " * depth
    if isinstance(x, dict):
        rows = [f"{inner}{json.dumps(k, ensure_ascii=False)}: {_pretty(v, depth + 1)}" for k, v in sorted(x.items(), key=lambda kv: kv[0].encode())]
        return "{\n" + ",\n".join(rows) + f"\n{outer}}}"
    if isinstance(x, list):
        return "[\n" + ",\n".join(inner + _pretty(v, depth + 1) for v in x) + f"\n{outer}]"
    return dump(x)


@function("jsonb_pretty")
def jsonb_pretty(j) -> Column:
    return _udf("string", lambda x: _pretty(parse(x)))(col(j))


@function("jsonb_typeof", "json_typeof")
def jsonb_typeof(j) -> Column:
    return _udf("string", lambda x: kind(parse(x)))(col(j))


@function("jsonb_array_length", "json_array_length")
def jsonb_array_length(j) -> Column:
    return F.json_array_length(col(j)).cast("bigint")


def _elements(x) -> list:
    v = parse(x)
    if not isinstance(v, list):
        raise ValueError("cannot extract elements from an object or a scalar")
    return v


@function("jsonb_array_elements", "json_array_elements")
def jsonb_array_elements(j) -> Column:
    """Rows."""
    return F.explode(_udf("array<string>", lambda x: [dump(e) for e in _elements(x)])(col(j)))


@function("jsonb_array_elements_text", "json_array_elements_text")
def jsonb_array_elements_text(j) -> Column:
    """Rows."""
    return F.explode(_udf("array<string>", lambda x: [text_of(e) for e in _elements(x)])(col(j)))


@function("jsonb_each", "json_each")
def jsonb_each(j) -> Column:
    """Rows of struct<key, value>; select it with .* ."""
    pairs = _udf("array<struct<key:string,value:string>>", lambda x: [{"key": k, "value": dump(v)} for k, v in sorted(parse(x).items())])
    return F.inline(pairs(col(j)))


@function("jsonb_each_text", "json_each_text")
def jsonb_each_text(j) -> Column:
    pairs = _udf("array<struct<key:string,value:string>>", lambda x: [{"key": k, "value": text_of(v)} for k, v in sorted(parse(x).items())])
    return F.inline(pairs(col(j)))


@function("jsonb_object_keys", "json_object_keys")
def jsonb_object_keys(j) -> Column:
    return F.explode(F.array_sort(F.json_object_keys(col(j))))


def _json_text(x: Column, kind_: str) -> Column:
    """A column's value as JSON text, by its declared kind."""
    if kind_ == "json":
        return x
    if kind_ in ("number", "boolean"):
        return F.coalesce(x.cast("string"), F.lit("null"))
    return F.coalesce(F.to_json(F.struct(x.cast("string").alias("v"))).substr(F.lit(6), F.lit(1 << 30)), F.lit("null"))


@function("to_jsonb", "to_json")
def to_jsonb(x, of: str = "string") -> Column:
    """Numbers and booleans bare, texts quoted, complex values by Spark's writer."""
    x = col(x)
    if of == "complex":
        return canonical(F.to_json(x, {"ignoreNullFields": "false"}))
    if of in ("number", "boolean"):
        return x.cast("string")
    return _udf("string", lambda v: dump(str(v)))(x.cast("string"))


def _python_json(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, list | tuple) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return [_python_json(e) for e in v]
    if isinstance(v, float | Decimal) and v == int(v) and not isinstance(v, Decimal):
        return Number(int(v))
    return Number(v)


@function("jsonb_build_array", "json_build_array")
def jsonb_build_array(*xs) -> Column:
    """Of arguments of any types."""
    return _udf("string", lambda *v: dump([_python_json(e) for e in v]), strict=False)(*map(col, xs))


@function("jsonb_build_object", "json_build_object")
def jsonb_build_object(*xs) -> Column:
    return _udf("string", lambda *v: dump({str(v[i]): _python_json(v[i + 1]) for i in range(0, len(v), 2)}), strict=False)(*map(col, xs))


def jsonb_agg(x, strict: bool = False) -> Column:
    """Of JSON texts; NULLs are JSON nulls, or skipped (strict)."""
    rows = F.collect_list(F.struct(col(x).alias("x")))
    values = F.transform(rows, lambda s: F.coalesce(s["x"], F.lit("null")))
    values = F.filter(F.transform(rows, lambda s: s["x"]), lambda e: e.isNotNull()) if strict else values
    return F.when(F.size(rows) > 0, F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")))


def jsonb_object_agg(k, v, strict: bool = False, unique: bool = False) -> Column:
    """Of keys and JSON texts; the last of equal keys in the order of their values stays unless unique, when equal keys raise."""

    def build(keys, values):
        if any(x is None for x in keys):
            raise ValueError("field name must not be null")
        pairs = [(x, y) for x, y in zip(keys, values, strict=True) if not (strict and y is None)]
        if unique and len({x for x, _ in pairs}) < len(pairs):
            raise ValueError("duplicate JSON object key value")
        return dump({x: parse(y) if y is not None else None for x, y in pairs})

    rows = F.sort_array(F.collect_list(F.struct(col(k).cast("string").alias("k"), col(v).alias("v"))))
    return _udf("string", build)(F.transform(rows, lambda s: s["k"]), F.transform(rows, lambda s: s["v"]))
