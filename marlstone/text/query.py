"""Queries: parsing, matching and their text form.

A node is ("lexeme", text, prefix, weights), ("not", x), ("and", x, y), ("or", x, y) or ("phrase", x, y, distance);
None is the empty query.
"""

from __future__ import annotations

import re

from .vector import lexeme, tokens


def _operand(text: str, config: str, prefix: bool = False, weights: str = ""):
    """The lexemes of a piece of text as a phrase, with distances as written; None if only stop words are left."""
    node, last = None, 0
    for place, (kind, token, _, _) in enumerate(tokens(text, config), 1):
        x = lexeme(config, kind, token)
        if x is None:
            continue
        leaf = ("lexeme", x, prefix, weights)
        node = leaf if node is None else ("phrase", node, leaf, place - last)
        last = place
    return node


def _join(kind: str, a, b, distance: int = 1):
    if a is None or b is None:
        return b if a is None else a
    return (kind, a, b, distance) if kind == "phrase" else (kind, a, b)


_SPEC = re.compile(r"\s*(?:(?P<op>[&|!()])|<(?P<d>\d+|-)>|'(?P<q>(?:[^'\\]|''|\\.)*)'(?::(?P<qf>[A-Da-d*]+))?|(?P<w>[^\s&|!()<:']+)(?::(?P<f>[A-Da-d*]+))?)")


class _Parser:
    """or < and < phrase < not."""

    def __init__(self, text: str, config: str | None):
        self.config = config
        self.items: list[re.Match] = []
        at = 0
        while at < len(text.rstrip()):
            m = _SPEC.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"syntax error in tsquery: {text!r}")
            self.items.append(m)
            at = m.end()
        self.at, self.text = 0, text

    def peek(self, op: str) -> bool:
        return self.at < len(self.items) and self.items[self.at]["op"] == op

    def either(self):
        node = self.both()
        while self.peek("|"):
            self.at += 1
            node = _join("or", node, self.both())
        return node

    def both(self):
        node = self.phrase()[0]
        while self.peek("&"):
            self.at += 1
            node = _join("and", node, self.phrase()[0])
        return node

    def phrase(self):
        node, _ = self.single()
        gap = 0
        while self.at < len(self.items) and self.items[self.at]["d"]:
            d = self.items[self.at]["d"]
            self.at += 1
            right, _ = self.single()
            distance = 1 if d == "-" else int(d)
            # A stop word between two lexemes widens their distance.
            if right is None:
                gap += distance
            else:
                node = _join("phrase", node, right, distance + gap)
                gap = 0
        return node, gap

    def single(self):
        if self.at >= len(self.items):
            raise ValueError(f"syntax error in tsquery: {self.text!r}")
        m = self.items[self.at]
        self.at += 1
        if m["op"] == "!":
            node, gap = self.single()
            return (None if node is None else ("not", node)), gap
        if m["op"] == "(":
            node = self.either()
            if not self.peek(")"):
                raise ValueError(f"syntax error in tsquery: {self.text!r}")
            self.at += 1
            return node, 0
        if m["op"] or m["d"]:
            raise ValueError(f"syntax error in tsquery: {self.text!r}")
        flags = (m["qf"] or m["f"] or "").upper()
        word = re.sub(r"''|\\(.)", lambda e: e[1] or "'", m["q"]) if m["q"] is not None else m["w"]
        prefix, weights = "*" in flags, "".join(sorted(set(flags) - {"*"}))
        if self.config is None:
            return ("lexeme", word, prefix, weights), 0
        return _operand(word, self.config, prefix, weights), 0


def _whole(text: str, config: str | None):
    if not text.strip():
        return None
    p = _Parser(text, config)
    node = p.either()
    if p.at < len(p.items):
        raise ValueError(f"syntax error in tsquery: {text!r}")
    return node


def to_query(text: str, config: str = "english"):
    return _whole(text, config)


def parse(text: str):
    """The cast of a text: words as they are."""
    return _whole(text, None)


def plain(text: str, config: str = "english"):
    node = None
    for kind, token, _, _ in tokens(text, config):
        x = lexeme(config, kind, token)
        if x is not None:
            node = _join("and", node, ("lexeme", x, False, ""))
    return node


def phrase(text: str, config: str = "english"):
    return _operand(text, config)


def websearch(text: str, config: str = "english"):
    """Words joined by and, "..." phrases, or, and a leading minus."""
    out = group = None
    either = False
    for m in re.finditer(r'(-)?"([^"]*)"?|(-)?(\S+)', text):
        if m[4] and m[4].lower() == "or" and not m[3] and group is not None:
            either = True
            continue
        node = phrase(m[2], config) if m[2] is not None else phrase(m[4], config)
        if node is None:
            continue
        if m[1] or m[3]:
            node = ("not", node)
        if either:
            out, group, either = _join("or", out, group), node, False
        else:
            group = _join("and", group, node)
    return _join("or", out, group)


def show(node, parent: int = 0) -> str:
    if node is None:
        return ""
    if node[0] == "lexeme":
        flags = ("*" if node[2] else "") + node[3]
        return "'" + node[1].replace("\\", "\\\\").replace("'", "''") + "'" + (":" + flags if flags else "")
    if node[0] == "not":
        return "!" + show(node[1], 4)
    rank, sign = {"or": (1, "|"), "and": (2, "&"), "phrase": (3, "")}[node[0]]
    if node[0] == "phrase":
        sign = "<->" if node[3] == 1 else f"<{node[3]}>"
    text = f"{show(node[1], rank)} {sign} {show(node[2], rank)}"
    return f"( {text} )" if rank < parent else text


def count_nodes(node) -> int:
    return 0 if node is None else 1 if node[0] == "lexeme" else 1 + sum(count_nodes(x) for x in node[1:] if isinstance(x, tuple))


def has_phrase(node) -> bool:
    return node is not None and node[0] != "lexeme" and (node[0] == "phrase" or any(has_phrase(x) for x in node[1:] if isinstance(x, tuple)))


def leaves(node) -> list[tuple]:
    if node is None:
        return []
    return [node] if node[0] == "lexeme" else [y for x in node[1:] if isinstance(x, tuple) for y in leaves(x)]


def found(leaf, v) -> list[list[tuple[int, str]]]:
    """The position lists of the leaf's lexemes that the vector has, cut to the leaf's weights."""
    _, x, prefix, weights = leaf
    out = []
    for places in [p for y, p in v.items() if y.startswith(x)] if prefix else [v[x]] if x in v else []:
        kept = [p for p in places if not weights or p[1] in weights]
        # A lexeme without positions meets any weights.
        if kept or not places:
            out.append(kept)
    return out


def matches(node, v) -> bool:
    """The empty query matches nothing."""
    if node is None:
        return False
    if node[0] == "lexeme":
        return bool(found(node, v))
    if node[0] == "not":
        return not matches(node[1], v)
    if node[0] == "and":
        return matches(node[1], v) and matches(node[2], v)
    if node[0] == "or":
        return matches(node[1], v) or matches(node[2], v)
    places, negated = positions(node, v)
    return negated or bool(places)


def positions(node, v) -> tuple[set[int], bool]:
    """(ends, complement): where a phrase's part can end; complement: everywhere but there."""
    if node[0] == "lexeme":
        return {p for places in found(node, v) for p, _ in places}, False
    if node[0] == "not":
        at, negated = positions(node[1], v)
        return at, not negated
    (a, na), (b, nb) = positions(node[1], v), positions(node[2], v)
    if node[0] == "or":
        if na or nb:
            return (a & b if na and nb else a - b if na else b - a), True
        return a | b, False
    if node[0] == "phrase":
        a = {p + node[3] for p in a}
    if na and nb:
        return a | b, True
    return (b - a if na else a - b if nb else a & b), False
