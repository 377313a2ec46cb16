"""name -> builder of a Column.  Builders take Columns (or plain values for constant arguments)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import count
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

FUNCTIONS: dict[str, Callable[..., Column]] = {}


def function(*names: str):
    """Registers a builder under its SQL names."""

    def put(f: Callable[..., Column]) -> Callable[..., Column]:
        for name in names:
            FUNCTIONS[name] = f
        return f

    return put


def col(x: Any) -> Column:
    """A Column as it is, anything else as a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def call(name: str, *args: Any) -> Column:
    """A registered function by name, as the SQL front end calls it."""
    from . import load

    load()
    if name.lower() not in FUNCTIONS:
        raise LookupError(f"unknown function {name}")
    return FUNCTIONS[name.lower()](*args)


_naming: list[SparkSession] = []
_numbers = count()


@contextmanager
def named_functions(spark: SparkSession) -> Iterator[None]:
    """Inside, Python functions are called by names that SQL text can use."""
    _naming.append(spark)
    try:
        yield
    finally:
        _naming.pop()


def vectorised(result: str):
    """An Arrow UDF; see named_functions."""

    def wrap(f: Callable) -> Callable[..., Column]:
        udf = F.pandas_udf(f, result)

        def call_(*args: Column) -> Column:
            if not _naming:
                return udf(*args)
            name = f"ms_function_{next(_numbers)}"
            _naming[-1].udf.register(name, udf)
            return F.call_function(name, *args)

        return call_

    return wrap


def fails(message: str, kind: str = "double") -> Column:
    """An expression of a type that raises when it is evaluated."""
    return F.raise_error(F.lit(message)).cast(kind)
