"""ts_rank, ts_rank_cd and ts_headline."""

from __future__ import annotations

import math
import re

from .query import found, leaves, matches
from .vector import lexeme, tokens

# Weights of D, C, B, A, and the sum of 1 / n^2.
WEIGHTS = (0.1, 0.2, 0.4, 1.0)
_BASEL = 1.64493406685


def _weight(weights, letter: str) -> float:
    return weights["DCBA".index(letter)]


def _distance(n: int) -> float:
    return 1e-30 if n > 100 else 1.0 / (1.005 + 0.05 * math.exp(n / 1.5 - 2))


def _normalised(score: float, v, method: int) -> float:
    """Bits: 1 log length, 2 length, 8 distinct words, 16 log distinct words, 32 score / (score + 1)."""
    length = sum(max(1, len(p)) for p in v.values())
    if method & 1 and v:
        score /= math.log(length + 1) / math.log(2.0) if length else 1
    if method & 2 and length:
        score /= length
    if method & 8 and v:
        score /= len(v)
    if method & 16 and v:
        score /= math.log(len(v) + 1) / math.log(2.0)
    if method & 32:
        score /= score + 1
    return score


def rank(v, node, weights=WEIGHTS, method: int = 0) -> float:
    own = list({leaf[1:]: leaf for leaf in leaves(node)}.values())
    if not v or not own:
        return 0.0
    pairs = node[0] in ("and", "phrase") and len(own) > 1
    score = _rank_pairs(v, own, weights) if pairs else _rank_each(v, own, weights)
    return _normalised(score if score >= 0 else 1e-20, v, method)


def _places(leaf, v):
    """Position lists of a leaf; a lexeme without positions stands at the very end."""
    return [p or [(16_383, "D")] for p in found(leaf, v)]


def _rank_pairs(v, own, weights) -> float:
    """Pairs with earlier operands, each of which counts by the last of its lexemes; -1 where no two operands occur."""
    score, seen = -1.0, []
    for leaf in own:
        every = _places(leaf, v)
        for places in every:
            for before in seen:
                for p, w in places:
                    for q, x in before:
                        d = abs(p - q)
                        if d or places == [(16_383, "D")] or before == [(16_383, "D")]:
                            pair = math.sqrt(_weight(weights, w) * _weight(weights, x) * _distance(d or 16_383))
                            score = pair if score < 0 else 1.0 - (1.0 - score) * (1.0 - pair)
        seen += every[-1:]
    return score


def _rank_each(v, own, weights) -> float:
    total = 0.0
    for leaf in own:
        for places in _places(leaf, v):
            ws = [_weight(weights, w) for _, w in places]
            best = max(range(len(ws)), key=lambda j: ws[j])
            series = sum(w / ((j + 1) * (j + 1)) for j, w in enumerate(ws))
            total += (ws[best] + series - ws[best] / ((best + 1) * (best + 1))) / _BASEL
    return total / len(own)


def _covers(v, node):
    """Minimal stretches of the document, as lists of (position, weight), that match the query."""
    doc: dict[int, list[tuple[str, str]]] = {}
    for leaf in leaves(node):
        for x, places in v.items():
            if x == leaf[1] or leaf[2] and x.startswith(leaf[1]):
                for p, w in places:
                    if not leaf[3] or w in leaf[3]:
                        doc.setdefault(p, [])
                        if (x, w) not in doc[p]:
                            doc[p].append((x, w))
    order = sorted(doc)

    def some(stretch) -> bool:
        part: dict[str, list[tuple[int, str]]] = {}
        for p in stretch:
            for x, w in doc[p]:
                part.setdefault(x, []).append((p, w))
        return matches(node, part)

    at = 0
    while at < len(order):
        end = next((e for e in range(at + 1, len(order) + 1) if some(order[at:e])), None)
        if end is None:
            return
        begin = next(b for b in range(end - 1, at - 1, -1) if some(order[b:end]))
        yield [(p, min(w for _, w in doc[p])) for p in order[begin:end]]
        at = begin + 1


def rank_cd(v, node, weights=WEIGHTS, method: int = 0) -> float:
    if node is None:
        return 0.0
    score, last, gaps, n = 0.0, 0.0, 0.0, 0
    for cover in _covers(v, node):
        inverse = sum(1.0 / _weight(weights, w) for _, w in cover)
        noise = max(cover[-1][0] - cover[0][0] - (len(cover) - 1), 0)
        score += len(cover) / inverse / (1.0 + noise)
        middle = (cover[0][0] + cover[-1][0]) / 2
        if n and middle > last:
            gaps += 1.0 / (middle - last)
        last, n = middle, n + 1
    if method & 4 and n and gaps:
        score /= n / gaps
    return _normalised(score, v, method)


def headline(text: str, node, config: str = "english", options: str = "") -> str:
    """One fragment around the matches: StartSel, StopSel, MaxWords, MinWords, HighlightAll, ShortWord."""
    given = {k.strip().lower(): v.strip().strip('"') for k, v in re.findall(r'(\w+)\s*=\s*("[^"]*"|[^,]*)', options)}
    start, stop = given.get("startsel", "<b>"), given.get("stopsel", "</b>")
    most, least = int(given.get("maxwords", 35)), int(given.get("minwords", 15))
    own = leaves(node)
    found_ = tokens(text, config)

    def hit(kind: str, token: str) -> bool:
        x = lexeme(config, kind, token)
        return x is not None and any(x == leaf[1] or leaf[2] and x.startswith(leaf[1]) for leaf in own)

    hits = [hit(kind, token) for kind, token, _, _ in found_]
    if given.get("highlightall", "false").lower() in ("true", "on", "1", "yes"):
        first, last = 0, len(found_)
    elif True not in hits:
        first, last = 0, min(least, len(found_))
    else:
        first = hits.index(True)
        # Most hits within the longest fragment; then at least the fewest words.
        best = max((i for i, h in enumerate(hits) if h), key=lambda i: (sum(hits[i : i + most]), -i))
        first = best
        last = max((j for j in range(first, min(first + most, len(hits))) if hits[j])) + 1
        last = min(len(found_), max(last, first + least))
        first = max(0, min(first, last - least))
    if not found_:
        return text[:0]
    whole = first == 0 and last == len(found_)
    begin = 0 if first == 0 else found_[first][2]
    end = len(text) if whole else found_[last - 1][3]
    out, at = [], begin
    for (_, _, a, b), h in zip(found_[first:last], hits[first:last], strict=True):
        if h:
            out += [text[at:a], start, text[a:b], stop]
            at = b
    return "".join([*out, text[at:end]])
