"""Tokens, configurations and vectors.

A vector is {lexeme: [(position, weight), ...]}; weights are the letters A to D.
"""

from __future__ import annotations

import re

from .stem import stem

MAX_POSITION = 16_383
MAX_POSITIONS = 256
# English stop words.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are was
    were be been being have has had having do does did doing a an the and but if or because as until while of at by
    for with about against between into through during before after above below to from up down in out on off over
    under again further then once here there when where why how all any both each few more most other some such no nor
    not only own same so than too very s t can will just don should now""".split()
)
_TOKEN = re.compile(
    r"(?P<email>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<host>(?:[a-z0-9-]+\.)+[a-z]{2,}(?![\w]))|(?P<number>(?<![\w])-?\d+(?:\.\d+)?(?:e[+-]?\d+)?(?![\w]))|(?P<word>[^\W_]+)",
    re.IGNORECASE,
)
_WORD = re.compile(r"(?P<word>[^\W_]+)")


def tokens(text: str, config: str = "english") -> list[tuple[str, str, int, int]]:
    """(kind, lower-cased token, start, end): e-mail addresses, host names, numbers and words; all else separates.

    The configuration "words" knows runs of letters and digits only, also in addresses, and is otherwise "simple".
    """
    return [(m.lastgroup, m[0].lower(), m.start(), m.end()) for m in (_WORD if config == "words" else _TOKEN).finditer(text)]


def lexeme(config: str, kind: str, token: str) -> str | None:
    """None for a stop word."""
    if config in ("simple", "words") or kind != "word" or not token.isalpha():
        return token
    if config != "english":
        raise LookupError(f"text search configuration {config} does not exist")
    return None if token in STOP_WORDS else stem(token)


def to_vector(text: str, config: str = "english") -> dict[str, list[tuple[int, str]]]:
    out: dict[str, list[tuple[int, str]]] = {}
    for place, (kind, token, _, _) in enumerate(tokens(text, config), 1):
        x = lexeme(config, kind, token)
        if x is not None:
            held = out.setdefault(x, [])
            at = min(place, MAX_POSITION)
            if len(held) < MAX_POSITIONS and not (held and held[-1][0] == at):
                held.append((at, "D"))
    return out


def lexemes(text: str, config: str = "english") -> set[str]:
    """The lexemes of to_vector."""
    if config == "words":
        return {w.lower() for w in set(_WORD.findall(text))}
    return {x for kind, token in {(kind, token) for kind, token, _, _ in tokens(text, config)} if (x := lexeme(config, kind, token)) is not None}


def show(v: dict[str, list[tuple[int, str]]]) -> str:
    """The text form: lexemes in byte order."""
    out = []
    for x in sorted(v, key=str.encode):
        quoted = "'" + x.replace("\\", "\\\\").replace("'", "''") + "'"
        places = ",".join(f"{p}{'' if w == 'D' else w}" for p, w in v[x])
        out.append(quoted + (":" + places if places else ""))
    return " ".join(out)


_ENTRY = re.compile(r"'((?:[^'\\]|''|\\.)*)'(?::([0-9A-Da-d*,]+))?|([^\s:']+)(?::([0-9A-Da-d*,]+))?")


def parse(text: str) -> dict[str, list[tuple[int, str]]]:
    out: dict[str, list[tuple[int, str]]] = {}
    for m in _ENTRY.finditer(text):
        x = re.sub(r"''|\\(.)", lambda e: e[1] or "'", m[1]) if m[1] is not None else m[3]
        places = out.setdefault(x, [])
        for p in (m[2] or m[4] or "").split(","):
            if p:
                n = re.match(r"\d+", p)[0]
                places.append((min(int(n), MAX_POSITION), p[len(n) :].upper().replace("*", "A") or "D"))
        best: dict[int, str] = {}
        for p, w in places:
            best[p] = min(best.get(p, "D"), w)
        out[x] = sorted(best.items())
    return out


def concat(a, b):
    """Positions of b follow those of a."""
    shift = max((p for places in a.values() for p, _ in places), default=0)
    out = {x: list(places) for x, places in a.items()}
    for x, places in b.items():
        out.setdefault(x, []).extend((min(p + shift, MAX_POSITION), w) for p, w in places)
    return out


def set_weight(v, weight: str):
    return {x: [(p, weight.upper()) for p, _ in places] for x, places in v.items()}


def strip(v):
    return {x: [] for x in v}
