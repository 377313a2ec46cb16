"""Numbers.  Domain errors raise, as in PostgreSQL; integers are bigint and divide by truncation."""

from __future__ import annotations

import math as _math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import col, fails, function, vectorised

_INT, _DOUBLE = "bigint", "double"


def _d(x) -> Column:
    return col(x).cast(_DOUBLE)


def _same(name: str, f=None):
    """A double function that Spark has under some name."""
    f = f or getattr(F, name)

    @function(name)
    def build(x) -> Column:
        return f(_d(x))

    return build


for _name in ("asinh", "acosh", "atan", "atanh", "cbrt", "cos", "cosh", "cot", "degrees", "exp", "radians", "sin", "sinh", "tan", "tanh"):
    _same(_name)


def _guarded(name: str, f, ok, message: str = "input is out of range"):
    @function(name)
    def build(x) -> Column:
        x = _d(x)
        return F.when(ok(x) | x.isNull() | F.isnan(x), f(x)).otherwise(fails(message))

    return build


acos = _guarded("acos", F.acos, lambda x: F.abs(x) <= 1)
asin = _guarded("asin", F.asin, lambda x: F.abs(x) <= 1)
sqrt = _guarded("sqrt", F.sqrt, lambda x: x >= 0, "cannot take square root of a negative number")
ln = _guarded("ln", F.ln, lambda x: x > 0, "cannot take logarithm of a nonpositive number")
_log10 = _guarded("log10", F.log10, lambda x: x > 0, "cannot take logarithm of a nonpositive number")


@function("log")
def log(base_or_x, x=None) -> Column:
    return _log10(base_or_x) if x is None else ln(x) / ln(base_or_x)


@function("abs")
def abs_(x) -> Column:
    return F.abs(col(x))


@function("sign")
def sign(x) -> Column:
    return F.signum(_d(x)).cast(_INT)


@function("atan2")
def atan2(y, x) -> Column:
    return F.atan2(_d(y), _d(x))


@function("pi")
def pi() -> Column:
    return F.pi()


def _degrees(radians: Column) -> Column:
    """Degrees, exact at the multiples of 30 and 45 that have exact arguments."""
    d = F.degrees(radians)
    near = F.rint(d / 15) * 15
    return F.when(F.abs(d - near) < 1e-12 * 180, near).otherwise(d)


@function("acosd")
def acosd(x) -> Column:
    return _degrees(acos(x))


@function("asind")
def asind(x) -> Column:
    return _degrees(asin(x))


@function("atand")
def atand(x) -> Column:
    return _degrees(F.atan(_d(x)))


@function("atan2d")
def atan2d(y, x) -> Column:
    return _degrees(atan2(y, x))


def _exact(x: Column, table: dict[int, float], f) -> Column:
    turn = F.pmod(x, F.lit(360.0))
    out = None
    for degrees, value in table.items():
        out = F.when(turn == degrees, F.lit(value)) if out is None else out.when(turn == degrees, F.lit(value))
    return out.otherwise(f(F.radians(x)))


_SINES = {0: 0.0, 30: 0.5, 90: 1.0, 150: 0.5, 180: 0.0, 210: -0.5, 270: -1.0, 330: -0.5}


@function("sind")
def sind(x) -> Column:
    return _exact(_d(x), _SINES, F.sin)


@function("cosd")
def cosd(x) -> Column:
    return _exact(_d(x), {(90 - k) % 360: v for k, v in _SINES.items()}, F.cos)


@function("tand")
def tand(x) -> Column:
    return _exact(_d(x), {0: 0.0, 45: 1.0, 90: _math.inf, 135: -1.0, 180: 0.0, 225: 1.0, 270: -_math.inf, 315: -1.0}, F.tan)


@function("cotd")
def cotd(x) -> Column:
    return _exact(_d(x), {0: _math.inf, 45: 1.0, 90: 0.0, 135: -1.0, 180: -_math.inf, 225: 1.0, 270: 0.0, 315: -1.0}, F.cot)


def _python(name: str, f):
    @function(name)
    def build(x) -> Column:
        @vectorised(_DOUBLE)
        def udf(xs: pd.Series) -> pd.Series:
            return xs.map(f, na_action="ignore")

        return udf(_d(x))

    return build


erf, erfc = _python("erf", _math.erf), _python("erfc", _math.erfc)


def int_div(a, b) -> Column:
    """Truncating division of integers; division by zero raises."""
    return F.call_function("div", col(a).cast(_INT), col(b).cast(_INT))


@function("div")
def div(a, b) -> Column:
    return int_div(a, b)


@function("mod")
def mod(a, b) -> Column:
    """The sign of the dividend."""
    return col(a) % col(b)


@function("power", "pow")
def power(a, b) -> Column:
    a, b = _d(a), _d(b)
    zero = F.when((a == 0) & (b < 0), fails("zero raised to a negative power is undefined"))
    return F.coalesce(zero.when((a < 0) & (b != F.rint(b)), fails("a negative number raised to a non-integer power yields a complex result")), F.pow(a, b))


def caret(a, b, whole: bool = False) -> Column:
    """The ^ operator; whole: both operands are integers, as is the result."""
    return power(a, b).cast(_INT) if whole else power(a, b)


@function("factorial")
def factorial(n) -> Column:
    """Up to 33!, which is the last to have 38 digits at most."""
    n = col(n).cast("int")
    product = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array(F.lit(1))), F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    return F.when(n < 0, fails("factorial of a negative number is undefined", "decimal(38,0)")).otherwise(F.when(n.isNotNull(), product))


@function("gcd")
def gcd(a, b) -> Column:
    """Euclid's rounds, of which 64-bit numbers need 92 at most."""
    a, b = F.abs(col(a).cast(_INT)), F.abs(col(b).cast(_INT))
    start = F.struct(a.alias("a"), b.alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast(_INT)).otherwise(F.try_mod(s["a"], s["b"])).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]


@function("lcm")
def lcm(a, b) -> Column:
    a, b = F.abs(col(a).cast(_INT)), F.abs(col(b).cast(_INT))
    return F.when((a == 0) | (b == 0), F.lit(0).cast(_INT)).otherwise(int_div(a, F.when(a == 0, F.lit(1).cast(_INT)).otherwise(gcd(a, b))) * b)


def _fraction(x) -> Column:
    return F.regexp_extract(col(x).cast("string"), r"\.([0-9]*)$", 1)


@function("scale")
def scale(x) -> Column:
    return F.when(col(x).isNotNull(), F.length(_fraction(x)).cast(_INT))


@function("min_scale")
def min_scale(x) -> Column:
    return F.when(col(x).isNotNull(), F.length(F.rtrim(_fraction(x), F.lit("0"))).cast(_INT))


@function("trim_scale")
def trim_scale(x) -> Column:
    """Text, as a decimal column has one scale for all rows."""
    s = col(x).cast("string")
    return F.when(F.contains(s, F.lit(".")), F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s)


@function("ceil", "ceiling")
def ceil(x, kind: str = _DOUBLE) -> Column:
    return F.ceil(col(x)).cast(kind)


@function("floor")
def floor(x, kind: str = _DOUBLE) -> Column:
    return F.floor(col(x)).cast(kind)


@function("round")
def round_(x, digits: int = 0) -> Column:
    """Half away from zero."""
    return F.round(col(x), digits)


@function("trunc")
def trunc(x, digits: int = 0) -> Column:
    x = col(x)
    unit = 10**digits if digits >= 0 else 1 / 10**-digits
    return F.signum(x) * F.floor(F.abs(x) * F.lit(unit)) / F.lit(unit)


@function("width_bucket")
def width_bucket(x, low, high, n) -> Column:
    return F.width_bucket(_d(x), _d(low), _d(high), col(n).cast("int")).cast(_INT)


@function("random")
def random(low=None, high=None) -> Column:
    if low is None:
        return F.rand()
    if isinstance(low, int) and isinstance(high, int):
        return F.floor(F.rand() * (high - low + 1) + low).cast(_INT)
    return F.rand() * (col(high) - col(low)) + col(low)


@function("random_normal")
def random_normal(mean: float = 0.0, deviation: float = 1.0) -> Column:
    return F.randn() * deviation + mean


# --- decimals ---------------------------------------------------------------------


def decimal_div(a, b) -> Column:
    """Exact division, six digits, half to even."""
    return F.bround(col(a).cast("decimal(38,12)") / col(b), 6)


def to_int(x, kind: str = _DOUBLE) -> Column:
    """A cast that rounds: doubles half to even, decimals half away from zero."""
    return (F.rint(_d(x)) if kind == _DOUBLE else F.round(col(x), 0)).cast(_INT)


def pg_avg(x) -> Column:
    """The mean of integers or decimals: a decimal of six digits, half to even."""
    return F.bround(F.sum(x).cast("decimal(38,12)") / F.count(x), 6)


def pg_corr(y, x) -> Column:
    """NULL where either input is constant."""
    return F.try_divide(F.covar_pop(y, x), F.stddev_pop(y) * F.stddev_pop(x))


def parse_number(s: str) -> float | int:
    return int(s) if re.fullmatch(r"[+-]?\d+", s) else float(s)
