"""One-dimensional arrays with 1-based subscripts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import col, function

_INT = "bigint"


def _full(a) -> Column:
    return F.nullif(F.size(col(a)), F.lit(0)).cast(_INT)


def subscript(a, i) -> Column:
    """NULL outside the array, at zero and at negative subscripts."""
    return F.get(col(a), F.when(col(i) >= 1, col(i).cast("int") - 1))


@function("array_append")
def array_append(a, x) -> Column:
    return F.array_append(col(a), col(x))


@function("array_prepend")
def array_prepend(x, a) -> Column:
    return F.array_prepend(col(a), col(x))


@function("array_cat")
def array_cat(a, b) -> Column:
    a, b = col(a), col(b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


@function("array_dims")
def array_dims(a) -> Column:
    return F.when(F.size(col(a)) > 0, F.concat(F.lit("[1:"), F.size(col(a)).cast("string"), F.lit("]")))


@function("array_ndims")
def array_ndims(a) -> Column:
    return F.when(F.size(col(a)) > 0, F.lit(1).cast(_INT))


@function("array_lower")
def array_lower(a, dimension: int = 1) -> Column:
    return F.when((F.size(col(a)) > 0) & F.lit(dimension == 1), F.lit(1).cast(_INT))


@function("array_length")
def array_length(a, dimension: int = 1) -> Column:
    return _full(a) if dimension == 1 else F.lit(None).cast(_INT)


@function("array_upper")
def array_upper(a, dimension: int = 1) -> Column:
    return array_length(a, dimension)


@function("cardinality")
def cardinality(a) -> Column:
    return F.when(col(a).isNotNull(), F.size(col(a)).cast(_INT))


@function("array_fill")
def array_fill(x, n) -> Column:
    n = F.element_at(F.array(*map(F.lit, n)), 1) if isinstance(n, list) else col(n)
    return F.array_repeat(col(x), n.cast("int"))


@function("array_position")
def array_position(a, x) -> Column:
    """NULL when absent; finds NULLs too."""
    where = F.filter(_indexed(a), lambda z: z["x"].eqNullSafe(col(x)))
    return F.get(where, F.lit(0))["i"]


def _indexed(a) -> Column:
    return F.transform(col(a), lambda x, i: F.struct(x.alias("x"), (i + 1).cast(_INT).alias("i")))


@function("array_positions")
def array_positions(a, x) -> Column:
    return F.transform(F.filter(_indexed(a), lambda z: z["x"].eqNullSafe(col(x))), lambda z: z["i"])


@function("array_remove")
def array_remove(a, x) -> Column:
    return F.filter(col(a), lambda e: ~e.eqNullSafe(col(x)))


@function("array_replace")
def array_replace(a, old, new) -> Column:
    return F.transform(col(a), lambda e: F.when(e.eqNullSafe(col(old)), col(new)).otherwise(e))


@function("array_reverse")
def array_reverse(a) -> Column:
    return F.reverse(col(a))


@function("array_shuffle")
def array_shuffle(a) -> Column:
    return F.shuffle(col(a))


@function("array_sample")
def array_sample(a, n) -> Column:
    return F.slice(F.shuffle(col(a)), F.lit(1), col(n).cast("int"))


@function("array_sort")
def array_sort(a, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """NULLs last, or first when descending, unless said otherwise."""
    a = col(a)
    first = descending if nulls_first is None else nulls_first
    values = F.sort_array(F.filter(a, lambda e: e.isNotNull()), not descending)
    nulls = F.filter(a, lambda e: e.isNull())
    return F.concat(nulls, values) if first else F.concat(values, nulls)


@function("array_to_string")
def array_to_string(a, sep: str, null_text: str | None = None) -> Column:
    texts = F.transform(col(a), lambda e: e.cast("string"))
    return F.array_join(texts, sep) if null_text is None else F.array_join(texts, sep, null_text)


@function("string_to_array")
def string_to_array(s, sep: str | None, null_text: str | None = None) -> Column:
    """A NULL separator splits into characters, an empty one doesn't split; the empty string has no elements."""
    s = col(s)
    if sep is None:
        parts = F.filter(F.split(s, ""), lambda e: e != "")
    else:
        parts = F.array(s) if sep == "" else F.split(s, re.escape(sep), -1)
    out = F.when(s == "", F.array().cast("array<string>")).when(s.isNotNull(), parts)
    return out if null_text is None else F.transform(out, lambda e: F.nullif(e, F.lit(null_text)))


@function("trim_array")
def trim_array(a, n) -> Column:
    return F.slice(col(a), F.lit(1), F.size(col(a)) - col(n).cast("int"))


def contains(a, b) -> Column:
    """a @> b; NULL elements contain nothing."""
    return F.forall(col(b), lambda e: F.coalesce(F.array_contains(col(a), e), F.lit(False)))


def overlaps(a, b) -> Column:
    """a && b."""
    return F.exists(col(b), lambda e: F.coalesce(F.array_contains(col(a), e), F.lit(False)))


def any_of(x, op, a) -> Column:
    """x op ANY(a), three-valued."""
    return F.exists(col(a), lambda e: op(col(x), e))


def all_of(x, op, a) -> Column:
    """x op ALL(a), three-valued."""
    return F.forall(col(a), lambda e: op(col(x), e))


@function("generate_subscripts")
def generate_subscripts(a, dimension: int = 1, descending: bool = False) -> Column:
    places = F.when(F.size(col(a)) > 0, F.sequence(F.lit(1), F.size(col(a))))
    return F.explode(F.transform(F.reverse(places) if descending else places, lambda i: i.cast(_INT)))


@function("generate_series")
def generate_series(start, stop, step=None) -> Column:
    """Rows from start to stop; an interval column as step for times."""
    parts = [col(start), col(stop)] if step is None else [col(start), col(stop), col(step)]
    forward = F.lit(True) if step is None or not isinstance(step, int | float) else F.lit(step > 0)
    good = F.when(forward, parts[0] <= parts[1]).otherwise(parts[0] >= parts[1])
    if step is None:
        parts.append(F.lit(1))
    if isinstance(step, int | float) and step == 0:
        raise ValueError("step size cannot equal zero")
    return F.explode(F.when(good, F.sequence(*parts)))


@function("unnest")
def unnest(a) -> Column:
    return F.explode(col(a))


def array_agg(x) -> Column:
    """Keeps NULLs; NULL over no rows."""
    rows = F.collect_list(F.struct(col(x).alias("x")))
    return F.when(F.size(rows) > 0, F.transform(rows, lambda s: s["x"]))


def ordered_agg(x, *keys, keep_nulls: bool = True) -> Column:
    """array_agg(x ORDER BY keys), keys ascending."""
    rows = F.sort_array(F.collect_list(F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)], col(x).alias("x"))))
    values = F.transform(rows, lambda s: s["x"])
    return F.when(F.size(rows) > 0, values if keep_nulls else F.filter(values, lambda e: e.isNotNull()))


def lockstep(**sets) -> list[Column]:
    """Set-returning calls of one select list: rows side by side, short ones padded with NULL.  name=array."""
    zipped = F.arrays_zip(*[col(a).alias(n) for n, a in sets.items()])
    return [F.inline(F.transform(zipped, lambda z: F.struct(*[z[n].alias(n) for n in sets])))]
