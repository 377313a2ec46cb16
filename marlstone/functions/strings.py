"""String, bytes, regular-expression and digest functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import col, fails, function, vectorised

_INT = "bigint"


def _n(x) -> Column:
    return col(x).cast("int")


@function("ascii")
def ascii_(s) -> Column:
    return F.ascii(col(s)).cast(_INT)


@function("bit_length")
def bit_length(s) -> Column:
    return F.bit_length(col(s)).cast(_INT)


@function("octet_length")
def octet_length(s) -> Column:
    return F.octet_length(col(s)).cast(_INT)


@function("length", "char_length", "character_length")
def length(s) -> Column:
    return F.char_length(col(s)).cast(_INT)


@function("lower")
def lower(s) -> Column:
    return F.lower(col(s))


@function("upper")
def upper(s) -> Column:
    return F.upper(col(s))


@function("chr")
def chr_(n) -> Column:
    """A character by its code point."""
    return F.decode(F.unhex(F.lpad(F.hex(col(n).cast(_INT)), 8, "0")), "UTF-32")


@function("concat")
def concat(*xs) -> Column:
    """NULL arguments are skipped."""
    return F.concat_ws("", *[col(x).cast("string") for x in xs])


@function("concat_ws")
def concat_ws(sep, *xs) -> Column:
    joined = F.array_join(F.filter(F.array(*[col(x).cast("string") for x in xs]), lambda e: e.isNotNull()), "\u0000")
    return F.replace(joined, F.lit("\u0000"), col(sep)) if isinstance(sep, Column) else F.concat_ws(sep, *[col(x).cast("string") for x in xs])


_CHARSETS = {"utf8": "UTF-8", "unicode": "UTF-8", "latin1": "ISO-8859-1", "iso_8859_1": "ISO-8859-1", "sql_ascii": "US-ASCII", "utf16": "UTF-16"}


def _charset(name: str) -> str:
    return _CHARSETS.get(name.lower().replace("-", "").replace("iso88591", "iso_8859_1"), name)


@function("convert_from")
def convert_from(b, encoding: str) -> Column:
    return F.decode(col(b), _charset(encoding))


@function("convert_to")
def convert_to(s, encoding: str) -> Column:
    return F.encode(col(s), _charset(encoding))


@function("convert")
def convert(b, source: str, target: str) -> Column:
    return F.encode(F.decode(col(b), _charset(source)), _charset(target))


@function("crc32")
def crc32(x) -> Column:
    return F.crc32(col(x).cast("binary"))


def _castagnoli() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0x82F63B78 * (n & 1)
        out.append(n)
    return out


@function("crc32c")
def crc32c(x) -> Column:
    """The Castagnoli checksum."""
    table = _castagnoli()

    def one(data) -> int | None:
        if data is None:
            return None
        crc = 0xFFFFFFFF
        for b in bytes(data):
            crc = table[(crc ^ b) & 255] ^ crc >> 8
        return crc ^ 0xFFFFFFFF

    @vectorised("long")
    def udf(xs: pd.Series) -> pd.Series:
        return xs.map(one).astype("Int64")

    return udf(col(x).cast("binary"))


def _escape_bytes(data) -> str | None:
    if data is None:
        return None
    return "".join("\\\\" if b == 92 else chr(b) if 32 <= b < 127 else f"\\{b:03o}" for b in bytes(data))


def _unescape_bytes(s) -> bytes | None:
    if s is None:
        return None
    return re.sub(rb"\\(\\|[0-3][0-7]{2})", lambda m: b"\\" if m[1] == b"\\" else bytes([int(m[1], 8)]), s.encode())


@function("encode")
def encode(b, fmt: str) -> Column:
    b = col(b).cast("binary")
    if fmt == "hex":
        return F.lower(F.hex(b))
    if fmt == "base64":
        return F.base64(b)

    @vectorised("string")
    def escaped(xs: pd.Series) -> pd.Series:
        return xs.map(_escape_bytes)

    return escaped(b)


@function("decode")
def decode(s, fmt: str) -> Column:
    if fmt == "hex":
        return F.unhex(col(s))
    if fmt == "base64":
        return F.unbase64(col(s))

    @vectorised("binary")
    def plain(xs: pd.Series) -> pd.Series:
        return xs.map(_unescape_bytes)

    return plain(col(s))


@function("md5")
def md5(s) -> Column:
    return F.md5(col(s).cast("binary"))


def _sha(bits: int):
    def build(x) -> Column:
        return F.unhex(F.sha2(col(x).cast("binary"), bits))

    return build


for _bits in (224, 256, 384, 512):
    function(f"sha{_bits}")(_sha(_bits))


@function("get_byte")
def get_byte(b, i) -> Column:
    b, i = col(b).cast("binary"), _n(i)
    at = F.conv(F.hex(F.substring(b, i + 1, F.lit(1))), 16, 10).cast(_INT)
    return F.when((i < 0) | (i >= F.octet_length(b)), fails("index out of range", _INT)).otherwise(at)


@function("set_byte")
def set_byte(b, i, v) -> Column:
    b, i = col(b).cast("binary"), _n(i)
    one = F.unhex(F.lpad(F.hex(col(v).cast(_INT).bitwiseAND(F.lit(255))), 2, "0"))
    return F.concat(F.substring(b, F.lit(1), i), one, F.substring(b, i + 2, F.octet_length(b)))


@function("get_bit")
def get_bit(b, i) -> Column:
    i = col(i).cast(_INT)
    return F.pmod(F.floor(get_byte(b, F.floor(i / 8)) / F.pow(F.lit(2), i % 8)), F.lit(2)).cast(_INT)


@function("set_bit")
def set_bit(b, i, v) -> Column:
    i = col(i).cast(_INT)
    at, weight = F.floor(i / 8).cast("int"), F.pow(F.lit(2), i % 8).cast(_INT)
    held = get_byte(b, at)
    without = held - get_bit(b, i) * weight
    return set_byte(b, at, without + col(v).cast(_INT) * weight)


@function("initcap")
def initcap(s) -> Column:
    """Upper case at the start of every run of letters and digits."""
    marked = F.regexp_replace(F.lower(col(s)), r"(?<![\p{L}\p{N}])([\p{L}\p{N}])", "\u0001$1")
    parts = F.split(marked, "\u0001")
    first = F.element_at(parts, 1)
    return F.concat(first, F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.expr("''"), F.substr(p, F.lit(2)))), ""))


@function("left")
def left(s, n) -> Column:
    """All but the last -n characters for a negative n."""
    s, n = col(s), _n(n)
    return F.substring(s, F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(F.char_length(s) + n, F.lit(0))))


@function("right")
def right(s, n) -> Column:
    s, n = col(s), _n(n)
    start = F.when(n >= 0, F.greatest(F.char_length(s) - n, F.lit(0)) + 1).otherwise(-n + 1)
    return F.when(n == 0, F.when(s.isNotNull(), F.lit(""))).otherwise(F.substr(s, start))


@function("substring", "substr")
def substring(s, start, count=None) -> Column:
    """Places before the first count towards the length but give nothing."""
    if isinstance(start, str):
        return F.when(F.regexp_like(col(s), F.lit("(?s)" + start)), F.regexp_extract(col(s), "(?s)" + start, 1 if re.compile(start).groups else 0))
    s, start = col(s), _n(start)
    low = F.greatest(start, F.lit(1))
    if count is None:
        return F.substr(s, low)
    count = _n(count)
    got = F.substring(s, low, F.greatest(start + count - low, F.lit(0)))
    return F.when(count < 0, fails("negative substring length not allowed", "string")).otherwise(got)


@function("position", "strpos")
def position(needle, haystack) -> Column:
    return F.position(col(needle), col(haystack)).cast(_INT)


@function("lpad")
def lpad(s, n, fill=" ") -> Column:
    return F.lpad(col(s), _n(n), col(fill))


@function("rpad")
def rpad(s, n, fill=" ") -> Column:
    return F.rpad(col(s), _n(n), col(fill))


@function("ltrim")
def ltrim(s, chars=" ") -> Column:
    return F.ltrim(col(s), col(chars))


@function("rtrim")
def rtrim(s, chars=" ") -> Column:
    return F.rtrim(col(s), col(chars))


@function("trim", "btrim")
def trim(s, chars=" ") -> Column:
    return F.btrim(col(s), col(chars))


@function("overlay")
def overlay(s, new, start, count=None) -> Column:
    s, new, start = col(s), col(new), _n(start)
    count = F.char_length(new) if count is None else _n(count)
    return F.concat(F.substring(s, F.lit(1), start - 1), new, F.substr(s, start + count))


@function("repeat")
def repeat(s, n) -> Column:
    return F.repeat(col(s), _n(n))


@function("replace")
def replace(s, old, new) -> Column:
    return F.when(col(old) == "", col(s)).otherwise(F.replace(col(s), col(old), col(new)))


@function("reverse")
def reverse(s) -> Column:
    return F.reverse(col(s))


@function("split_part")
def split_part(s, sep, n) -> Column:
    return F.split_part(col(s), col(sep), _n(n))


@function("starts_with")
def starts_with(s, prefix) -> Column:
    return F.startswith(col(s), col(prefix))


@function("translate")
def translate(s, source: str, target: str) -> Column:
    return F.translate(col(s), source, target)


@function("to_hex")
def to_hex(n) -> Column:
    return F.lower(F.hex(col(n).cast(_INT)))


@function("quote_literal")
def quote_literal(x) -> Column:
    s = col(x).cast("string")
    quoted = F.concat(F.lit("'"), F.replace(F.replace(s, F.lit("'"), F.lit("''")), F.lit("\\"), F.lit("\\\\")), F.lit("'"))
    return F.when(F.contains(s, F.lit("\\")), F.concat(F.lit("E"), quoted)).otherwise(quoted)


@function("quote_nullable")
def quote_nullable(x) -> Column:
    return F.coalesce(quote_literal(x), F.lit("NULL"))


@function("quote_ident")
def quote_ident(s) -> Column:
    s = col(s)
    return F.when(F.regexp_like(s, F.lit("^[a-z_][a-z0-9_$]*$")), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


@function("format")
def format_(template, *xs) -> Column:
    """%s, %I and %L with positions, widths and the left-justify flag; %% is a percent sign."""
    spec = re.compile(r"%(?:(\d+)\$)?(-)?(\*(?:(\d+)\$)?|\d+)?([sIL%])")

    def one(t, values) -> str | None:
        if t is None:
            return None
        following = 0

        def put(m: re.Match) -> str:
            nonlocal following
            if m[5] == "%":
                return "%"
            width = 0
            if m[3] and m[3].startswith("*"):
                at = int(m[4]) - 1 if m[4] else following
                following = at + 1
                width = int(values[at] or 0)
            elif m[3]:
                width = int(m[3])
            at = int(m[1]) - 1 if m[1] else following
            following = at + 1
            if at >= len(values):
                raise ValueError("too few arguments for format()")
            v = values[at]
            if m[5] == "s":
                text = v or ""
            elif m[5] == "L":
                text = "NULL" if v is None else ("E'" + v.replace("\\", "\\\\").replace("'", "''") + "'" if "\\" in v else "'" + v.replace("'", "''") + "'")
            elif v is None:
                raise ValueError("null values cannot be formatted as an SQL identifier")
            else:
                text = v if re.fullmatch("[a-z_][a-z0-9_$]*", v) else '"' + v.replace('"', '""') + '"'
            return text.ljust(width) if m[2] or width < 0 else text.rjust(width)

        return spec.sub(put, t)

    @vectorised("string")
    def udf(t: pd.Series, *rest: pd.Series) -> pd.Series:
        columns = [r.where(r.notna(), None).tolist() for r in rest]
        return pd.Series([one(x, [c[i] for c in columns]) for i, x in enumerate(t)])

    return udf(col(template), *[col(x).cast("string") for x in xs])


@function("normalize")
def normalize(s, form: str = "NFC") -> Column:
    import unicodedata

    @vectorised("string")
    def udf(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else unicodedata.normalize(form.upper(), x))

    return udf(col(s))


@function("is_normalized")
def is_normalized(s, form: str = "NFC") -> Column:
    import unicodedata

    @vectorised("boolean")
    def udf(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else unicodedata.is_normalized(form.upper(), x))

    return udf(col(s))


@function("to_ascii")
def to_ascii(s, encoding: str = "latin1") -> Column:
    """Letters without their marks; other characters beyond ASCII are blanks."""
    import unicodedata

    @vectorised("string")
    def udf(xs: pd.Series) -> pd.Series:
        def one(x):
            return None if x is None else "".join(next((d for d in unicodedata.normalize("NFD", c) if ord(d) < 128), " ") for c in x)

        return xs.map(one)

    return udf(col(s))


@function("unistr")
def unistr(s) -> Column:
    r"""Unescapes \XXXX, \+XXXXXX, \uXXXX, \UXXXXXXXX and \\."""
    spec = re.compile(r"\\(?:(\\)|u?([0-9A-Fa-f]{4})|\+([0-9A-Fa-f]{6})|U([0-9A-Fa-f]{8}))")

    @vectorised("string")
    def udf(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else spec.sub(lambda m: "\\" if m[1] else chr(int(m[2] or m[3] or m[4], 16)), x))

    return udf(col(s))


@function("parse_ident")
def parse_ident(s, strict: bool = True) -> Column:
    part = re.compile(r'\s*(?:"((?:[^"]|"")+)"|([A-Za-z_][A-Za-z0-9_$]*))\s*')

    def one(x):
        if x is None:
            return None
        out, at = [], 0
        while True:
            m = part.match(x, at)
            if not m:
                raise ValueError(f"string is not a valid identifier: {x}")
            out.append(m[1].replace('""', '"') if m[1] else m[2].lower())
            at = m.end()
            if at < len(x) and x[at] == ".":
                at += 1
            elif at < len(x) and strict:
                raise ValueError(f"string is not a valid identifier: {x}")
            else:
                return out

    @vectorised("array<string>")
    def udf(xs: pd.Series) -> pd.Series:
        return xs.map(one)

    return udf(col(s))


# --- regular expressions -------------------------------------------------------


def java_pattern(pattern: str, flags: str = "") -> str:
    """The pattern for Spark's engine: dots match line feeds unless flags say otherwise; word-edge escapes translated."""
    if "q" in flags:
        pattern = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    else:
        pattern = re.sub(r"(?<!\\)((?:\\\\)*)\\([mMyYAZ])", lambda m: m[1] + {"m": r"\b(?=\w)", "M": r"\b(?<=\w)", "y": r"\b", "Y": r"\B", "A": r"\A", "Z": r"\z"}[m[2]], pattern)
    modes = "" if set("nmp") & set(flags) else "s"
    modes += "m" if set("nmw") & set(flags) else ""
    modes += "i" if "i" in flags else ""
    modes += "x" if "x" in flags else ""
    return (f"(?{modes})" if modes else "") + pattern


def _groups(pattern: str) -> int:
    return re.compile(re.sub(r"\\[mMyY]", r"\\b", pattern)).groups


@function("regexp_like")
def regexp_like(s, pattern: str, flags: str = "") -> Column:
    return F.regexp_like(col(s), F.lit(java_pattern(pattern, flags)))


@function("regexp_count")
def regexp_count(s, pattern: str, start: int = 1, flags: str = "") -> Column:
    return F.regexp_count(F.substr(col(s), F.lit(start)), F.lit(java_pattern(pattern, flags))).cast(_INT)


@function("regexp_match")
def regexp_match(s, pattern: str, flags: str = "") -> Column:
    """The groups of the first match, the whole match if there are none; NULL without a match."""
    p, n = java_pattern(pattern, flags), _groups(pattern)
    groups = F.array(*[F.regexp_extract(col(s), p, i) for i in (range(1, n + 1) if n else (0,))])
    return F.when(F.regexp_like(col(s), F.lit(p)), groups)


@function("regexp_matches")
def regexp_matches(s, pattern: str, flags: str = "") -> Column:
    """Array of the groups of each match (all matches with flag g); explode it for rows."""
    p, n = java_pattern(pattern, flags), _groups(pattern)
    each = [F.regexp_extract_all(col(s), F.lit(p), F.lit(i)) for i in (range(1, n + 1) if n else (0,))]
    zipped = F.transform(F.arrays_zip(*each), lambda z: F.array(*[z[str(i)] for i in range(len(each))]))
    return zipped if "g" in flags else F.slice(zipped, 1, 1)


def _java_replacement(text: str) -> str:
    return re.sub(r"\\([0-9&\\])|(\$)", lambda m: r"\$" if m[2] else "$0" if m[1] == "&" else "\\\\" if m[1] == "\\" else "$" + m[1], text)


@function("regexp_replace")
def regexp_replace(s, pattern: str, replacement: str, flags: str = "", start: int = 1) -> Column:
    """The first match, or all with flag g."""
    p, new = java_pattern(pattern, flags), _java_replacement(replacement)
    s = col(s)
    if start > 1:
        return F.concat(F.substring(s, 1, start - 1), regexp_replace(F.substr(s, F.lit(start)), pattern, replacement, flags))
    if "g" in flags:
        return F.regexp_replace(s, p, new)
    at = F.regexp_instr(s, F.lit(p))
    head, tail = F.substring(s, F.lit(1), at - 1), F.substr(s, at)
    own = re.match(r"\(\?[a-z]+\)", p)
    modes, body = (own[0], p[own.end() :]) if own else ("", p)
    return F.when(at > 0, F.concat(head, F.regexp_replace(tail, f"{modes}\\A(?:{body})", new))).otherwise(s)


@function("regexp_split_to_array")
def regexp_split_to_array(s, pattern: str, flags: str = "") -> Column:
    return F.split(col(s), java_pattern(pattern, flags), -1)


@function("regexp_split_to_table")
def regexp_split_to_table(s, pattern: str, flags: str = "") -> Column:
    return F.explode(regexp_split_to_array(s, pattern, flags))


@function("regexp_substr")
def regexp_substr(s, pattern: str, start: int = 1, n: int = 1, flags: str = "", group: int = 0) -> Column:
    found = F.regexp_extract_all(F.substr(col(s), F.lit(start)), F.lit(java_pattern(pattern, flags)), F.lit(group))
    return F.try_element_at(found, F.lit(n))


@function("regexp_instr")
def regexp_instr(s, pattern: str, start: int = 1, n: int = 1, end: int = 0, flags: str = "", group: int = 0) -> Column:
    """Place of the n-th match or of its group (or of the character after it); 0 without one."""
    if (start, n, end, group) == (1, 1, 0, 0):
        return F.regexp_instr(col(s), F.lit(java_pattern(pattern, flags))).cast(_INT)
    python_flags = (re.I if "i" in flags else 0) | (0 if set("nmp") & set(flags) else re.S) | (re.M if set("nmw") & set(flags) else 0)
    spec = re.compile(pattern, python_flags)

    def one(x):
        if x is None:
            return None
        for k, m in enumerate(spec.finditer(x, start - 1), 1):
            if k == n:
                return (m.end(group) if end else m.start(group)) + 1
        return 0

    @vectorised("long")
    def udf(xs: pd.Series) -> pd.Series:
        return xs.map(one).astype("Int64")

    return udf(col(s))


def similar_to(s, pattern: str, escape: str = "\\") -> Column:
    """SIMILAR TO: % and _ as wildcards, | * + ? {} () [] as in regular expressions, all else plain."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif c == "[":
            j = pattern.index("]", i + 2)
            out += pattern[i : j + 1].replace("\\", "\\\\")
            i = j
        else:
            out += {"%": ".*", "_": "."}.get(c, c if c in "|*+?{}(),0123456789" else re.escape(c))
        i += 1
    return col(s).rlike(f"(?s)\\A(?:{out})\\z")
