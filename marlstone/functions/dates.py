"""Dates, times and intervals.

An interval is struct<months int, days int, micros bigint>; it compares with months of 30 days and days of 24 hours.
"""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import col, fails, function, vectorised

DAY = 86_400_000_000
_INT = "bigint"


def interval(months=0, days=0, micros=0) -> Column:
    return F.struct(col(months).cast("int").alias("months"), col(days).cast("int").alias("days"), col(micros).cast(_INT).alias("micros"))


def interval_key(i) -> Column:
    """Orders and groups intervals as they compare."""
    i = col(i)
    return i["months"].cast("decimal(20,0)") * (30 * DAY) + i["days"].cast("decimal(20,0)") * DAY + i["micros"]


@function("make_interval")
def make_interval(years=0, months=0, weeks=0, days=0, hours=0, mins=0, secs=0) -> Column:
    micros = (col(hours).cast(_INT) * 3600 + col(mins).cast(_INT) * 60) * 1_000_000 + F.round(col(secs).cast("double") * 1e6).cast(_INT)
    return interval(col(years) * 12 + col(months), col(weeks) * 7 + col(days), micros)


def interval_sum(i) -> Column:
    """An aggregate."""
    i = col(i)
    return F.when(F.count(i) > 0, F.struct(F.sum(i["months"]).cast("int").alias("months"), F.sum(i["days"]).cast("int").alias("days"), F.sum(i["micros"]).alias("micros")))


def interval_times(i, n) -> Column:
    """Fractions of months go to days, of days to the clock."""
    i, n = col(i), col(n).cast("double")
    months = i["months"] * n
    whole = F.signum(months) * F.floor(F.abs(months))
    days = i["days"] * n + (months - whole) * 30
    whole_days = F.signum(days) * F.floor(F.abs(days) + 1e-9)
    return interval(whole, whole_days, F.rint(i["micros"] * n + (days - whole_days) * DAY))


def add_interval(t, i) -> Column:
    """Of a date or a timestamp: a timestamp."""
    t, i = col(t).cast("timestamp_ntz"), col(i)
    moved = F.add_months(t.cast("date"), i["months"])
    clock = F.timestamp_diff("MICROSECOND", F.date_trunc("DAY", t), t)
    return F.timestamp_add("MICROSECOND", clock + i["micros"] + i["days"] * F.lit(DAY), moved.cast("timestamp_ntz"))


def date_minus(a, b) -> Column:
    """date - date: days."""
    return F.datediff(col(a), col(b)).cast(_INT)


def timestamp_minus(a, b) -> Column:
    """timestamp - timestamp: whole days and the rest."""
    micros = F.timestamp_diff("MICROSECOND", col(b), col(a))
    return interval(0, F.call_function("div", micros, F.lit(DAY)), micros % F.lit(DAY))


@function("age")
def age(a, b=None) -> Column:
    """Whole months, days and the clock's remainder from b to a; from a to midnight today with one argument."""
    late, early = (F.current_date(), col(a)) if b is None else (col(a), col(b))
    late, early = late.cast("timestamp_ntz"), early.cast("timestamp_ntz")
    back = late < early
    low, high = F.least(late, early), F.greatest(late, early)
    months = F.timestamp_diff("MONTH", low, high)
    rest = F.timestamp_diff("MICROSECOND", F.timestamp_add("MONTH", months.cast("int"), low), high)
    sign = F.when(back, -1).otherwise(1)
    return interval(months * sign, F.call_function("div", rest, F.lit(DAY)) * sign, rest % F.lit(DAY) * sign)


def _trunc_div(a: Column, b: int) -> Column:
    return F.call_function("div", a.cast(_INT), F.lit(b).cast(_INT))


@function("justify_hours")
def justify_hours(i) -> Column:
    i = col(i)
    return interval(i["months"], i["days"] + _trunc_div(i["micros"], DAY), i["micros"] % F.lit(DAY))


@function("justify_days")
def justify_days(i) -> Column:
    i = col(i)
    return interval(i["months"] + _trunc_div(i["days"], 30), i["days"] % 30, i["micros"])


@function("justify_interval")
def justify_interval(i) -> Column:
    """All parts get the sign of the whole."""
    total = interval_key(i).cast(_INT)
    months = _trunc_div(total, 30 * DAY)
    rest = total % F.lit(30 * DAY)
    return interval(months, _trunc_div(rest, DAY), rest % F.lit(DAY))


@function("clock_timestamp", "now", "current_timestamp", "statement_timestamp", "transaction_timestamp")
def now() -> Column:
    return F.current_timestamp()


@function("localtimestamp")
def localtimestamp() -> Column:
    return F.localtimestamp()


@function("current_date")
def current_date() -> Column:
    return F.current_date()


@function("current_time", "localtime")
def current_time() -> Column:
    """Microseconds since midnight."""
    t = F.localtimestamp()
    return F.timestamp_diff("MICROSECOND", F.date_trunc("DAY", t), t)


@function("isfinite")
def isfinite(x) -> Column:
    return F.when(col(x).isNotNull(), F.lit(True))


@function("make_date")
def make_date(y, m, d) -> Column:
    return F.make_date(col(y).cast("int"), col(m).cast("int"), col(d).cast("int"))


@function("make_time")
def make_time(h, m, s) -> Column:
    """Microseconds since midnight."""
    h, m, s = col(h).cast(_INT), col(m).cast(_INT), col(s).cast("double")
    ok = h.between(0, 23) & m.between(0, 59) & (s >= 0) & (s < 60) | (h == 24) & (m == 0) & (s == 0)
    return F.when(~ok, fails("time field value out of range", _INT)).otherwise((h * 3600 + m * 60) * 1_000_000 + F.rint(s * 1e6).cast(_INT))


@function("make_timestamp", "make_timestamptz")
def make_timestamp(y, mo, d, h, mi, s) -> Column:
    return F.make_timestamp(*[col(x).cast("int") for x in (y, mo, d, h, mi)], col(s).cast("decimal(16,6)"))


_UNITS = {"microseconds": "MICROSECOND", "milliseconds": "MILLISECOND", "second": "SECOND", "minute": "MINUTE", "hour": "HOUR", "day": "DAY", "week": "WEEK", "month": "MONTH", "quarter": "QUARTER", "year": "YEAR"}


@function("date_trunc")
def date_trunc(unit: str, t) -> Column:
    unit, t = unit.lower(), col(t)
    if unit in _UNITS:
        return F.date_trunc(_UNITS[unit], t)
    y = F.year(t)
    first = {"decade": F.floor(y / 10) * 10, "century": F.floor((y - 1) / 100) * 100 + 1, "millennium": F.floor((y - 1) / 1000) * 1000 + 1}
    if unit not in first:
        raise ValueError(f"unit {unit} not recognized")
    return F.make_date(first[unit].cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")


@function("extract", "date_part")
def extract(field: str, t) -> Column:
    """A double."""
    f, t = field.lower(), col(t)
    y = F.year(t)
    second = F.second(t) + F.pmod(_micros(t), F.lit(1_000_000)) / 1e6
    fields = {
        "year": lambda: y, "quarter": lambda: F.quarter(t), "month": lambda: F.month(t), "week": lambda: F.weekofyear(t), "isoweek": lambda: F.weekofyear(t),
        "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), t), "day": lambda: F.dayofmonth(t), "doy": lambda: F.dayofyear(t), "dow": lambda: F.dayofweek(t) - 1,
        "isodow": lambda: F.weekday(t) + 1, "hour": lambda: F.hour(t), "minute": lambda: F.minute(t), "second": lambda: second,
        "milliseconds": lambda: second * 1e3, "microseconds": lambda: second * 1e6, "epoch": lambda: _micros(t) / 1e6,
        "century": lambda: F.floor((y - 1) / 100) + 1, "decade": lambda: F.floor(y / 10), "millennium": lambda: F.floor((y - 1) / 1000) + 1,
        "timezone": lambda: F.lit(0), "timezone_hour": lambda: F.lit(0), "timezone_minute": lambda: F.lit(0),
    }
    if f not in fields:
        raise ValueError(f"unit {field} not recognized")
    return fields[f]().cast("double")


def _micros(t: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def extract_interval(field: str, i) -> Column:
    """A double."""
    f, i = field.lower(), col(i)
    m, d, u = i["months"], i["days"], i["micros"]
    fields = {
        "millennium": _trunc_div(m, 12_000), "century": _trunc_div(m, 1200), "decade": _trunc_div(m, 120), "year": _trunc_div(m, 12),
        "quarter": _trunc_div(m % 12, 3) + 1, "month": m % 12, "day": d, "hour": _trunc_div(u, 3_600_000_000), "minute": _trunc_div(u, 60_000_000) % 60,
        "second": (u % 60_000_000) / 1e6, "milliseconds": (u % 60_000_000) / 1e3, "microseconds": u % 60_000_000,
        "epoch": _trunc_div(m, 12) * 31_557_600 + (m % 12) * 2_592_000 + d * 86_400 + u / 1e6,
    }
    return fields[f].cast("double")


@function("timezone")
def timezone(zone: str, t, aware: bool = False) -> Column:
    """AT TIME ZONE: zoneless clock time of an instant (aware), or the instant of a zoneless clock time."""
    return F.from_utc_timestamp(col(t), zone) if aware else F.to_utc_timestamp(col(t), zone)


# --- templates -----------------------------------------------------------------------

# Template fields, longest first where one begins another.
_FIELDS = ("YYYY", "IYYY", "YYY", "IYY", "YY", "IY", "HH24", "HH12", "HH", "MI", "SSSS", "SS", "MS", "US", "FF1", "FF2", "FF3", "FF4", "FF5", "FF6", "MONTH", "Month", "month", "MON", "Mon", "mon", "MM", "DDD", "DAY", "Day", "day", "DY", "Dy", "dy", "DD", "IDDD", "ID", "D", "IW", "WW", "W", "CC", "Q", "J", "A.M.", "a.m.", "P.M.", "p.m.", "AM", "am", "PM", "pm", "TZ", "tz", "OF", "Y", "I")
_FIELD = re.compile('"([^"]*)"|(FM)?(' + "|".join(re.escape(f) for f in sorted(_FIELDS, key=len, reverse=True)) + ")(TH|th)?")


def _shown(t: dt.datetime, field: str, fill: bool) -> str:
    iso = t.isocalendar()
    pad = lambda n, w: str(n).rjust(w, "0") if fill else str(n)
    u = field.upper()
    if u in ("YYYY", "YYY", "YY", "Y"):
        return pad(t.year, 4) if u == "YYYY" else pad(t.year, 4)[-len(u) :]
    if u in ("IYYY", "IYY", "IY", "I"):
        return pad(iso[0], 4) if u == "IYYY" else pad(iso[0], 4)[-len(u) :]
    if u in ("MONTH", "DAY", "MON", "DY"):
        name = t.strftime("%B" if u in ("MONTH", "MON") else "%A")
        name = name[:3] if u in ("MON", "DY") else name.ljust(9) if fill else name
        return name.upper() if field.isupper() else name.lower() if field.islower() else name
    numbers = {"MM": (t.month, 2), "DD": (t.day, 2), "DDD": (t.timetuple().tm_yday, 3), "HH24": (t.hour, 2), "HH12": ((t.hour + 11) % 12 + 1, 2), "HH": ((t.hour + 11) % 12 + 1, 2), "MI": (t.minute, 2), "SS": (t.second, 2), "SSSS": (t.hour * 3600 + t.minute * 60 + t.second, 1), "MS": (t.microsecond // 1000, 3), "US": (t.microsecond, 6), "D": (t.isoweekday() % 7 + 1, 1), "ID": (t.isoweekday(), 1), "IW": (iso[1], 2), "WW": ((t.timetuple().tm_yday - 1) // 7 + 1, 2), "W": ((t.day - 1) // 7 + 1, 1), "CC": ((t.year - 1) // 100 + 1, 2), "Q": ((t.month + 2) // 3, 1), "J": (t.toordinal() + 1_721_425, 7), "IDDD": ((iso[1] - 1) * 7 + iso[2], 3)}
    if u in numbers:
        return pad(*numbers[u])
    if u.startswith("FF"):
        return f"{t.microsecond:06d}"[: int(u[2])]
    if u in ("AM", "PM", "A.M.", "P.M."):
        half = "pm" if t.hour >= 12 else "am"
        half = f"{half[0]}.m." if "." in u else half
        return half if field.islower() else half.upper()
    return {"TZ": "UTC" if field.isupper() else "utc", "OF": "+00"}[u]


def _with_suffix(text: str, suffix: str | None) -> str:
    if not suffix:
        return text
    n = int(text)
    th = "th" if n % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    return text + (th.upper() if suffix == "TH" else th)


def show_time(t: dt.datetime, template: str) -> str:
    return _FIELD.sub(lambda m: m[1] if m[1] is not None else _with_suffix(_shown(t, m[3], not m[2]), m[4]), template)


def show_number(x: float, template: str) -> str:
    """9 0 . , D G S MI PL FM PR L templates."""
    fm = "FM" in template
    body = template.replace("FM", "")
    marks = {k: k in body for k in ("PR", "MI", "PL", "SG", "S")}
    lead_s = body.startswith("S") and not body.startswith("SG")
    core = re.sub("PR|MI|PL|SG|S|L|TH|th", "", body).replace("D", ".").replace("G", ",")
    whole, _, part = core.partition(".")
    digits = f"{abs(x):.{part.count('9') + part.count('0')}f}"
    w, _, p = digits.partition(".")
    w = "" if w == "0" and "0" not in whole and p else w
    places = whole.count("9") + whole.count("0")
    if len(w) > places:
        text = re.sub("[90]", "#", core)
    else:
        left, k = [], len(w)
        seen_zero = len(whole) - whole.index("0") if "0" in whole else 0
        for at, c in enumerate(reversed(whole)):
            if c == ",":
                left.append("," if k > 0 or at < seen_zero - 1 else " ")
            elif k > 0:
                k -= 1
                left.append(w[k])
            else:
                left.append("0" if at < seen_zero else " ")
        text = "".join(reversed(left))
        if part:
            if fm:
                keep = part.rfind("0") + 1
                p = p[:keep] + p[keep:].rstrip("0")
            text += "." + p
    negative = x < 0
    if marks["PR"]:
        text = text.strip()
        text = f"<{text}>" if negative else f" {text} "
    elif marks["MI"]:
        text += "-" if negative else " "
    elif marks["S"] or marks["SG"]:
        sign = "-" if negative else "+"
        text = _signed(text, sign) if lead_s or marks["SG"] else text + sign
    else:
        text = _signed(text, "-" if negative else " ")
    return text.strip() if fm else text


def _signed(text: str, sign: str) -> str:
    bare = text.lstrip(" ")
    return " " * (len(text) - len(bare)) + sign + bare


@function("to_char")
def to_char(x, template: str, number: bool = False) -> Column:
    """Of a date or timestamp, or of a number (number=True)."""
    if number:

        @vectorised("string")
        def shown(xs: pd.Series) -> pd.Series:
            return xs.map(lambda v: None if pd.isna(v) else show_number(float(v), template))

        return shown(col(x).cast("double"))

    @vectorised("string")
    def udf(xs: pd.Series) -> pd.Series:
        return xs.map(lambda t: None if pd.isna(t) else show_time(t.to_pydatetime(), template))

    return udf(col(x).cast("timestamp_ntz"))


# Template fields and Spark's letters for them.
_PARSE = {"YYYY": "yyyy", "YY": "yy", "MONTH": "MMMM", "Month": "MMMM", "month": "MMMM", "MON": "MMM", "Mon": "MMM", "mon": "MMM", "MM": "MM", "DDD": "DDD", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a", "am": "a", "pm": "a"}


def _spark_template(template: str) -> str:
    out, at = "", 0
    for m in _FIELD.finditer(template):
        out += re.sub("([A-Za-z]+)", r"'\1'", template[at : m.start()])
        out += f"'{m[1]}'" if m[1] is not None else _PARSE[m[3]]
        at = m.end()
    return out + re.sub("([A-Za-z]+)", r"'\1'", template[at:])


@function("to_date")
def to_date(s, template: str) -> Column:
    return F.to_date(col(s), _spark_template(template))


@function("to_timestamp")
def to_timestamp(x, template: str | None = None) -> Column:
    """Of seconds since 1970, or of text by a template."""
    return F.timestamp_seconds(col(x)) if template is None else F.to_timestamp(col(x), F.lit(_spark_template(template)))
