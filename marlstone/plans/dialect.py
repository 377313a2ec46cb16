"""PostgreSQL-flavoured SELECT text to Spark SQL: a token-level rewrite of what Spark's parser doesn't take or reads otherwise.

With a session, calls of library functions and operators that Spark lacks become what the function library builds
for them (see calls), and operators that stay unknown are refused.
"""

from __future__ import annotations

import re

from .calls import AGGREGATES, UNKNOWN, Calls, quoted

_TOKEN = re.compile(r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>[eE]?'(?:[^']|'')*')|(?P<quoted>\"(?:[^\"]|\"\")*\")|(?P<dollar>\$\d+)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_][A-Za-z0-9_$]*)|(?P<op>::|!~\*|!~|~\*|<->|<=>|<#>|#>>|#>|#-|@@|\?\||\?&|\|\|/|\|/|<=|>=|<>|!=|\|\||->>|->|@>|<@|&&|~|.)", re.S)
_OPERATORS = ("->", "->>", "#>", "#>>", "#-", "@>", "<@", "?", "?|", "?&", "&&", "@@", "<->", "<=>", "<#>", "^", "#")
#: Calls whose result is an integer if their arguments are.
_WHOLE = {"count", "sum", "min", "max", "abs", "length", "char_length", "cardinality", "array_length", "mod"}
_KEYWORDS = {"IN", "AND", "OR", "NOT", "WHEN", "THEN", "ELSE", "SELECT", "WHERE", "ON", "BY", "HAVING", "CASE", "LIKE", "IS", "BETWEEN", "FROM", "AS", "RETURNING", "VALUES", "LIMIT", "DISTINCT"}

# Type names that Spark spells differently, and functions under another name there.
TYPES = {"int8": "bigint", "int4": "int", "int2": "smallint", "integer": "int", "text": "string", "float8": "double", "float4": "float", "real": "float", "bool": "boolean", "timestamptz": "timestamp", "bytea": "binary", "numeric": "decimal(38,6)", "jsonb": "string", "json": "string", "uuid": "string", "varchar": "string"}
FUNCTIONS = {"strpos": "instr", "btrim": "trim", "string_agg": "listagg", "gen_random_uuid": "uuid", "clock_timestamp": "current_timestamp", "statement_timestamp": "current_timestamp", "transaction_timestamp": "current_timestamp", }


def tokens(sql: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m[0]) for m in _TOKEN.finditer(sql)]


class _Text:
    """Tokens without white space, with helpers to look around."""

    def __init__(self, sql: str | list[tuple[str, str]]):
        self.items = [t for t in tokens(sql) if t[0] != "space"] if isinstance(sql, str) else list(sql)

    def is_word(self, i: int, *words: str) -> bool:
        return 0 <= i < len(self.items) and self.items[i][0] == "word" and self.items[i][1].upper() in words

    def is_op(self, i: int, op: str) -> bool:
        return 0 <= i < len(self.items) and self.items[i] == ("op", op)

    def close(self, i: int) -> int:
        """The parenthesis that ends the one at i."""
        depth = 0
        for k in range(i, len(self.items)):
            depth += self.is_op(k, "(") - self.is_op(k, ")")
            if not depth:
                return k
        raise SyntaxError("unbalanced parentheses")

    def operand_start(self, end: int) -> int:
        """The first token of the simple operand that ends before `end`: a name, literal, call or parenthesis."""
        i = end - 1
        if self.is_op(i, ")") or self.is_op(i, "]"):
            depth, pair = 0, {")": "(", "]": "["}
            shut = self.items[i][1]
            while True:
                depth += (self.items[i][1] == shut) - (self.items[i][1] == pair[shut])
                if not depth:
                    break
                i -= 1
            if i and self.items[i - 1][0] in ("word", "quoted") and not self.is_word(i - 1, "IN", "AND", "OR", "NOT", "WHEN", "THEN", "ELSE", "SELECT", "WHERE", "ON", "BY", "HAVING"):
                i -= 1
        while i >= 2 and self.is_op(i - 1, "."):
            i -= 2
        return i

    def operand_end(self, start: int) -> int:
        """One past the simple operand that starts at `start`."""
        i = start
        if self.is_op(i, "-"):
            i += 1
        if self.is_op(i, "("):
            i = self.close(i)
        while self.is_op(i + 1, ".") or self.is_op(i + 1, "(") or self.is_op(i + 1, "::"):
            if self.is_op(i + 1, "::"):
                i += 2 + 2 * (self.is_op(i + 3, "[") and self.is_op(i + 4, "]"))
            else:
                i = self.close(i + 1) if self.is_op(i + 1, "(") else i + 2
        return i + 1

    def parts(self, a: int, b: int) -> list[tuple[int, int]]:
        """The ranges between the commas of a .. b."""
        out, depth, first = [], 0, a
        for k in range(a, b):
            depth += (self.is_op(k, "(") or self.is_op(k, "[")) - (self.is_op(k, ")") or self.is_op(k, "]"))
            if not depth and self.is_op(k, ","):
                out.append((first, k))
                first = k + 1
        return [*out, (first, b)] if b > a else []

    def find(self, a: int, b: int, *words: str) -> int | None:
        """The first of these words outside parentheses in a .. b."""
        depth = 0
        for k in range(a, b):
            depth += self.is_op(k, "(") - self.is_op(k, ")")
            if not depth and self.is_word(k, *words):
                return k
        return None

    def put(self, start: int, end: int, text: str) -> None:
        self.items[start:end] = [("made", text)]

    def text(self, start: int = 0, end: int | None = None) -> str:
        return re.sub(r"\s*(\.|\()\s*(?=\S)", lambda m: m[0], " ".join(t for _, t in self.items[start:end])).replace(" . ", ".").replace(" (", "(").replace("( ", "(")


def _regex(pattern: str, fold: bool) -> str:
    """A literal pattern for rlike: dots match line feeds."""
    return f"'(?s{'i' if fold else ''}){pattern[1:]}" if pattern.startswith("'") else f"concat('(?s{'i' if fold else ''})', {pattern})"


def _literal(items: list[tuple[str, str]]) -> object:
    """The value of a literal, or UNKNOWN."""
    if len(items) == 2 and items[0] == ("op", "-") and items[1][0] == "number":
        value = _literal(items[1:])
        return value if value is UNKNOWN else -value
    if len(items) != 1:
        return UNKNOWN
    kind, x = items[0]
    if kind == "string" and x[0] == "'":
        return x[1:-1].replace("''", "'")
    if kind == "number":
        return int(x) if x.isdigit() else float(x)
    return {"TRUE": True, "FALSE": False}.get(x.upper(), UNKNOWN) if kind == "word" else UNKNOWN


class _Calls:
    """The parts of the rewrite that ask the session."""

    def __init__(self, t: _Text, calls: Calls):
        self.t, self.calls = t, calls

    def sub(self, a: int, b: int) -> tuple[str, object]:
        """A part of the statement, rewritten on its own: its text and value."""
        items = self.t.items[a:b]
        value = _literal(items)
        return (_rewritten(items, self.calls), value) if value is UNKNOWN or not isinstance(value, str) else (quoted(value), value)

    def whole(self, a: int, b: int) -> bool:
        """Whether a part is an integer, as far as tokens and tables tell."""
        t = self.t
        for k in range(a, b):
            kind, x = t.items[k]
            good = kind == "number" and x.isdigit() or kind == "op" and x in "+-*%(),." or kind == "made" and re.search(r" as (big|small)?int\)$", x)
            if kind in ("word", "quoted"):
                good = x.lower() in _WHOLE and t.is_op(k + 1, "(") or t.is_op(k + 1, ".") or self.calls.integral(x.strip('"`')) or x == "*"
            if not good:
                return False
        return True

    def of_arrays(self, a: int, b: int) -> bool:
        kind, x = self.t.items[a]
        return kind == "word" and x.lower() == "array" or kind == "made" and (x.startswith("array(") or re.search(r" as array<\w+>\)$", x) is not None) or kind in ("word", "quoted") and b - a in (1, 3) and self.calls.is_array(self.t.items[b - 1][1].strip('"`'))

    def aggregate(self, i: int) -> None:
        """array_agg, json_agg and the like, with DISTINCT, ORDER BY and FILTER."""
        t, name = self.t, self.t.items[i][1].lower()
        end = t.close(i + 1)
        first = i + 2 + t.is_word(i + 2, "DISTINCT")
        order = t.find(first, end, "ORDER")
        stop = end + 1
        keep = ""
        if t.is_word(end + 1, "FILTER"):
            stop = t.close(end + 2) + 1
            keep = f" FILTER (WHERE {_rewritten(t.items[end + 4 : stop - 1], self.calls)})"
        args = [self.sub(a, b) for a, b in t.parts(first, order or end)]
        if name in AGGREGATES and not order and not keep and first == i + 2:
            # The value, which comes last, is JSON already or becomes so.
            last = t.parts(first, end)[-1]
            ready = any(t.is_op(k, "::") and t.is_word(k + 1, "JSON", "JSONB") for k in range(*last))
            texts = [x for x, _ in args]
            texts[-1] = texts[-1] if ready else f"to_json(cast({texts[-1]} as variant))"
            t.put(i, stop, self.calls.build(AGGREGATES[name], [(x, UNKNOWN) for x in texts]))
            return
        if name != "array_agg":
            raise SyntaxError(f"{name} takes no DISTINCT, ORDER BY or FILTER")
        keys, signs = [], []
        for a, b in t.parts(order + 2, end) if order else []:
            desc, nulls = t.find(a, b, "DESC"), t.find(a, b, "NULLS")
            cut = min(k for k in (desc, t.find(a, b, "ASC"), nulls, b) if k is not None)
            keys.append(self.sub(a, cut)[0])
            first_nulls = desc is not None if nulls is None else t.is_word(nulls + 1, "FIRST")
            signs.append((-1 if desc is None else 1, -1 if first_nulls else 1))
        rows = f"collect_list(struct({', '.join([*(f'{k} AS k{n}' for n, k in enumerate(keys)), f'{args[0][0]} AS x'])})){keep}"
        compare = "0"
        for n in reversed(range(len(keys))):
            less, null = signs[n]
            compare = f"CASE WHEN l.k{n} <=> r.k{n} THEN {compare} WHEN l.k{n} IS NULL THEN {null} WHEN r.k{n} IS NULL THEN {-null} WHEN l.k{n} < r.k{n} THEN {less} ELSE {-less} END"
        ordered = f"array_sort({rows}, (l, r) -> {compare})" if keys else rows
        made = f"transform({ordered}, ms_s -> ms_s.x)"
        if first > i + 2:
            made = f"array_distinct({made})"
        t.put(i, stop, f"CASE WHEN count(*){keep} > 0 THEN {made} END")

    def step(self, i: int) -> int | None:
        """Rewrites at place i; where to go on, or None if there was nothing."""
        t, (kind, x) = self.t, self.t.items[i]
        if kind == "word" and t.is_op(i + 1, "("):
            name, end = x.lower(), t.close(i + 1)
            if name == "array_agg" or name in AGGREGATES:
                self.aggregate(i)
                return i + 1
            if self.calls.known(name) and not (i and t.items[i - 1] == ("op", ".")):
                word = t.find(i + 2, end, "FROM", "IN", "PLACING")
                if name in ("extract", "position", "substring") and word:
                    last = t.find(word, end, "FOR")
                    cuts = [(i + 2, word), (word + 1, last or end), *([(last + 1, end)] if last else [])]
                    args = [self.sub(a, b) for a, b in cuts]
                    if name == "extract":
                        args[0] = (args[0][0], args[0][0].lower().strip("'"))
                elif word:
                    return None
                else:
                    args = [self.sub(a, b) for a, b in t.parts(i + 2, end)]
                t.put(i, end + 1, self.calls.call(name, args))
                return i + 1
        if t.is_word(i, "AT") and (t.is_word(i + 1, "TIME") and t.is_word(i + 2, "ZONE") or t.is_word(i + 1, "LOCAL")) and i:
            local = t.is_word(i + 1, "LOCAL")
            a, b = t.operand_start(i), i + 2 if local else t.operand_end(i + 3)
            # TIMESTAMP '...' is two tokens.
            a -= a > 0 and t.is_word(a - 1, "TIMESTAMP", "TIMESTAMPTZ", "TIMESTAMP_NTZ")
            aware = self.calls.types.get(t.items[i - 1][1].lower()) == {"timestamp"} or t.is_word(a, "TIMESTAMPTZ")
            zone = (quoted("UTC"), "UTC") if local else self.sub(i + 3, b)
            text = self.sub(a, i)[0]
            t.put(a, b, self.calls.call("timezone", [zone, (re.sub("(?i)^timestamptz ", "TIMESTAMP ", text), UNKNOWN), ("true" if aware else "false", aware)]))
            return a + 1
        before = i > 0 and (t.items[i - 1][0] in ("quoted", "made", "string", "number", "dollar") or t.items[i - 1][0] == "word" and t.items[i - 1][1].upper() not in _KEYWORDS or t.is_op(i - 1, ")") or t.is_op(i - 1, "]"))
        if kind == "op" and x == "[" and before:
            end = next(k for k in range(i + 1, len(t.items)) if t.is_op(k, "]"))
            a = t.operand_start(i)
            value, index = self.sub(a, i), self.sub(i + 1, end)
            if isinstance(index[1], str):
                text = self.calls.operator("->", value, index, False)
            else:
                from ..functions import arrays

                text = self.calls.build(arrays.subscript, [value, index])
            t.put(a, end + 1, text)
            return a + 1
        if kind == "op" and x in ("|/", "||/", "@") and not before:
            b = t.operand_end(i + 1)
            t.put(i, b, self.calls.call({"|/": "sqrt", "||/": "cbrt", "@": "abs"}[x], [self.sub(i + 1, b)]))
            return i + 1
        if kind == "op" and x in _OPERATORS and before:
            a, b = t.operand_start(i), t.operand_end(i + 1)
            arrays_ = self.of_arrays(a, i) or self.of_arrays(i + 1, b)
            t.put(a, b, self.calls.operator(x, self.sub(a, i), self.sub(i + 1, b), arrays_))
            return a + 1
        if kind == "op" and x == "/" and before:
            a, b = t.operand_start(i), t.operand_end(i + 1)
            if self.whole(a, i) and self.whole(i + 1, b):
                right = self.sub(i + 1, b)[0]
                t.put(a, b, f"({self.sub(a, i)[0]} div {right})")
                return a + 1
        if kind == "op" and (x in _OPERATORS and x != "?" or x in ("@", "|/", "||/")):
            raise SyntaxError(f"operator {x} has no operand that is understood")
        return None


def rewrite(sql: str, spark=None) -> str:
    """One statement; with a session also what the function library serves."""
    items = [x for x in tokens(sql.rstrip().rstrip(";")) if x[0] != "space"]
    calls = Calls(spark, {x.strip('"').lower() for kind, x in items if kind in ("word", "quoted")}) if spark is not None else None
    return _rewritten(items, calls)


def _rewritten(items: list[tuple[str, str]], calls: Calls | None) -> str:
    t = _Text(items)
    served = _Calls(t, calls) if calls is not None else None
    _array_literals(t)
    i = 0
    while i < len(t.items):
        if served is not None and (after := served.step(i)) is not None:
            i = after
            continue
        kind, x = t.items[i]
        if kind == "quoted" and x[0] == '"':
            t.items[i] = ("quoted", "`" + x[1:-1].replace('""', '"').replace("`", "``") + "`")
        elif kind == "string" and x[0] in "eE":
            t.items[i] = ("string", x[1:])
        elif kind == "string":
            t.items[i] = ("string", x.replace("\\", "\\\\"))
        elif kind == "dollar":
            t.items[i] = ("made", f":p{x[1:]}")
        elif t.is_op(i, "::"):
            a, end = t.operand_start(i), i + 2
            name = t.items[i + 1][1].lower()
            if name == "double" and t.is_word(i + 2, "PRECISION"):
                end, name = i + 3, "double"
            if t.is_op(end, "("):
                last = t.close(end)
                name = f"{'decimal' if name == 'numeric' else name}({','.join(v for k, v in t.items[end + 1 : last] if v != ',')})"
                end = last + 1
            spark_type = TYPES.get(name, name)
            if t.is_op(end, "[") and t.is_op(end + 1, "]"):
                spark_type, end = f"array<{spark_type}>", end + 2
            if spark_type.startswith("array<") and i - a == 1 and t.items[a][0] == "string":
                t.put(a, end, f"cast(array({', '.join(quoted(v.strip()) for v in t.items[a][1].strip(chr(39) + '{}').split(',') if v.strip())}) as {spark_type})")
            else:
                t.put(a, end, f"cast({t.text(a, i)} as {spark_type})")
            i = a
        elif kind == "op" and x in ("~", "~*", "!~", "!~*") and i and not t.is_op(i - 1, "("):
            a, b = t.operand_start(i), t.operand_end(i + 1)
            call = f"rlike({t.text(a, i)}, {_regex(t.text(i + 1, b), x.endswith('*'))})"
            t.put(a, b, f"NOT {call}" if x.startswith("!") else call)
            i = a
        elif kind == "op" and x in ("->", "->>") and i:
            a, b = t.operand_start(i), t.operand_end(i + 1)
            key = t.text(i + 1, b)
            path = f"$[{key}]" if key.lstrip("-").isdigit() else "$." + key.strip("'")
            t.put(a, b, f"get_json_object({t.text(a, i)}, '{path}')")
            i = a
        elif t.is_word(i, "BETWEEN") and t.is_word(i + 1, "SYMMETRIC"):
            a, b = t.operand_start(i), t.operand_end(i + 2)
            negated = t.is_word(i - 1, "NOT")
            a = t.operand_start(i - 1) if negated else a
            c = t.operand_end(b + 1)
            lo, hi = t.text(i + 2, b), t.text(b + 1, c)
            t.put(a, c, f"{t.text(a, i - negated)} {'NOT ' * negated}BETWEEN least({lo}, {hi}) AND greatest({lo}, {hi})")
            i = a
        elif t.is_word(i, "SIMILAR") and t.is_word(i + 1, "TO"):
            negated = t.is_word(i - 1, "NOT")
            a, b = t.operand_start(i - negated), t.operand_end(i + 2)
            t.put(a, b, f"{'NOT ' * negated}rlike({t.text(a, i - negated)}, {_similar(t.text(i + 2, b))})")
            i = a
        elif t.is_word(i, "ANY", "SOME", "ALL") and t.is_op(i + 1, "(") and i and t.items[i - 1][1] in ("=", "<>", "!=", "<", ">", "<=", ">=") and not t.is_word(i + 2, "SELECT", "WITH", "VALUES"):
            a, b = t.operand_start(i - 1), t.close(i + 1)
            f = "forall" if x.upper() == "ALL" else "exists"
            t.put(a, b + 1, f"{f}({t.text(i + 2, b)}, ms_e -> {t.text(a, i - 1)} {t.items[i - 1][1]} ms_e)")
            i = a
        elif t.is_word(i, "FETCH") and t.is_word(i + 1, "FIRST", "NEXT"):
            n = "1" if t.is_word(i + 2, "ROW", "ROWS") else t.items[i + 2][1]
            end = i + 3 if t.is_word(i + 2, "ROW", "ROWS") else i + 4
            t.items[i : end + t.is_word(end, "ONLY")] = [("word", "LIMIT"), ("made", n)]
        elif kind == "word" and t.is_op(i + 1, "(") and x.lower() in FUNCTIONS:
            t.items[i] = ("word", FUNCTIONS[x.lower()])
        elif kind == "word" and x.upper() == "CAST" and t.is_op(i + 1, "("):
            end = t.close(i + 1)
            for k in range(i + 2, end):
                if t.is_word(k, "AS") and k + 1 < end and t.items[k + 1][1].lower() in TYPES and not t.is_op(k + 2, "("):
                    t.items[k + 1] = ("word", TYPES[t.items[k + 1][1].lower()])
        i += 1
    _distinct_on(t)
    _null_order(t)
    return t.text()


def _array_literals(t: _Text) -> None:
    """ARRAY[...] -> array(...)."""
    for i in range(len(t.items)):
        if t.is_word(i, "ARRAY") and t.is_op(i + 1, "["):
            depth, k = 0, i + 1
            while True:
                depth += t.is_op(k, "[") - t.is_op(k, "]")
                if not depth:
                    break
                k += 1
            t.items[i], t.items[i + 1], t.items[k] = ("word", "array"), ("op", "("), ("op", ")")


def _similar(literal: str) -> str:
    body = literal.strip("'")
    out = "".join({"%": ".*", "_": "."}.get(c, c if c in "|*+?{}()[]," or c.isalnum() else re.escape(c)) for c in body)
    return f"r'(?s)^(?:{out})$'"


def _distinct_on(t: _Text) -> None:
    """SELECT DISTINCT ON (keys) list FROM ... ORDER BY order -> the first row of each key by a rank."""
    if not (t.is_word(0, "SELECT") and t.is_word(1, "DISTINCT") and t.is_word(2, "ON")):
        return
    end = t.close(3)
    keys = t.text(4, end)
    depth, source, by, limit = 0, None, None, len(t.items)
    for k in range(end + 1, len(t.items)):
        depth += t.is_op(k, "(") - t.is_op(k, ")")
        if not depth and source is None and t.is_word(k, "FROM"):
            source = k
        if not depth and t.is_word(k, "ORDER") and t.is_word(k + 1, "BY"):
            by = k
        if not depth and t.is_word(k, "LIMIT", "OFFSET") and limit == len(t.items):
            limit = k
    stop = by if by is not None else limit
    order = t.text(by + 2, limit) if by is not None else keys
    inner = f"SELECT {t.text(end + 1, source)}, row_number() OVER (PARTITION BY {keys} ORDER BY {_with_nulls(order)}) AS ms_rank {t.text(source, stop)}"
    tail = t.text(limit)
    t.items = [("made", f"SELECT * EXCEPT (ms_rank) FROM ({inner}) WHERE ms_rank = 1 {tail}".rstrip())]


def _with_nulls(order: str) -> str:
    t = _Text("ORDER BY " + order)
    _null_order(t)
    return t.text(2)


def _null_order(t: _Text) -> None:
    """NULLS LAST ascending and FIRST descending, wherever an ORDER BY says nothing."""
    i = 0
    while i < len(t.items):
        if not (t.is_word(i, "ORDER") and t.is_word(i + 1, "BY")):
            i += 1
            continue
        k, depth, desc, placed, empty = i + 2, 0, False, False, True
        while True:
            end = k >= len(t.items) or not depth and (t.is_op(k, ")") or t.is_word(k, "LIMIT", "OFFSET", "ROWS", "RANGE", "UNION", "EXCEPT", "INTERSECT", "FOR"))
            if end or not depth and t.is_op(k, ","):
                if not placed and not empty:
                    t.items.insert(k, ("made", "NULLS FIRST" if desc else "NULLS LAST"))
                    k += 1
                if end:
                    break
                desc = placed = False
                empty = True
                k += 1
                continue
            depth += t.is_op(k, "(") - t.is_op(k, ")")
            desc |= not depth and t.is_word(k, "DESC")
            placed |= not depth and t.is_word(k, "NULLS")
            empty = False
            k += 1
        i = k
