"""Text search over columns: vectors are strings in their text form; constant queries are parsed once, on the driver."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..text import query as q
from ..text import rank as r
from ..text import vector as v
from .jsonb import _udf
from .registry import col, function, vectorised


@function("to_tsvector")
def to_tsvector(text, config: str = "english") -> Column:
    return _udf("string", lambda x: v.show(v.to_vector(x, config)))(col(text))


def _query(parser):
    def build(text, config: str = "english") -> Column:
        if isinstance(text, str):
            return F.lit(q.show(parser(text, config)))
        return _udf("string", lambda x: q.show(parser(x, config)))(text)

    return build


to_tsquery = function("to_tsquery")(_query(q.to_query))
plainto_tsquery = function("plainto_tsquery")(_query(q.plain))
phraseto_tsquery = function("phraseto_tsquery")(_query(q.phrase))
websearch_to_tsquery = function("websearch_to_tsquery")(_query(q.websearch))


@function("numnode")
def numnode(query) -> Column:
    return _udf("long", lambda x: q.count_nodes(q.parse(x)))(col(query))


def matches(vector, query) -> Column:
    """vector @@ query; a constant query is parsed once."""
    if not isinstance(query, str):
        return _udf("boolean", lambda x, y: q.matches(q.parse(y), v.parse(x)))(col(vector), col(query))
    node = q.parse(query)
    return _udf("boolean", lambda x: q.matches(node, v.parse(x)))(col(vector))


def text_matches(text, query: str, config: str = "english") -> Column:
    """to_tsvector(text) @@ query in one step.  Needed words that no suffix can hide are looked for in the JVM first."""
    node = q.parse(query)
    near = _near(node, config)

    @vectorised("boolean")
    def udf(xs: pd.Series) -> pd.Series:
        # No token has white space in it, and places only matter to phrases: other pieces of the text can't change the answer.
        cut = (lambda x: x) if near is None else lambda x: " ".join([w for w in x.split() if near.search(w)])
        return pd.Series([None if x is None else q.matches(node, v.to_vector(cut(x), config)) for x in xs], dtype="boolean")

    quick = _may_match(node, F.lower(col(text)), config)
    if quick is None:
        return udf(col(text))
    return F.when(~quick, F.lit(False)).otherwise(udf(F.when(quick, col(text))))


def _near(node, config: str) -> re.Pattern | None:
    """What is part of every word that has one of the query's lexemes; None where that isn't known or words' places matter."""
    stubs = [_needed(leaf, config) for leaf in q.leaves(node)]
    return None if not stubs or not all(stubs) or q.has_phrase(node) else re.compile("|".join(sorted({x for own in stubs for x in own})), re.IGNORECASE)


def _may_match(node, low: Column, config: str) -> Column | None:
    """False only for lower-cased texts that can't match; None: all may."""
    if node is None or node[0] == "not":
        return None
    if node[0] == "lexeme":
        stubs = _needed(node, config)
        return F.contains(low, F.lit(stubs[0])) if stubs else None
    a, b = _may_match(node[1], low, config), _may_match(node[2], low, config)
    if node[0] == "or":
        return None if a is None or b is None else a | b
    return b if a is None else a if b is None else a & b


def _needed(node, config: str) -> list[str]:
    """Starts of words that every matching text must contain: of lexemes that all branches need.

    A stem can differ from its word in its last three letters (y and i, a dropped e, able and ability, skies and sky),
    so these are not asked for, nor is what then has fewer than two letters.
    """
    if node is None:
        return []
    if node[0] == "lexeme":
        stub = node[1][:-3] if config == "english" else node[1]
        return [stub] if len(stub) > 1 and stub.isascii() and stub.isalpha() else []
    if node[0] in ("and", "phrase"):
        return _needed(node[1], config) + _needed(node[2], config)
    return []


@function("ts_rank")
def ts_rank(vector, query: str, weights=r.WEIGHTS, method: int = 0) -> Column:
    node = q.parse(query)
    return _udf("double", lambda x: r.rank(v.parse(x), node, weights, method))(col(vector))


@function("ts_rank_cd")
def ts_rank_cd(vector, query: str, weights=r.WEIGHTS, method: int = 0) -> Column:
    node = q.parse(query)
    return _udf("double", lambda x: r.rank_cd(v.parse(x), node, weights, method))(col(vector))


@function("ts_headline")
def ts_headline(text, query: str, options: str = "", config: str = "english") -> Column:
    node = q.parse(query)
    return _udf("string", lambda x: r.headline(x, node, config, options))(col(text))


@function("setweight")
def setweight(vector, weight: str) -> Column:
    return _udf("string", lambda x: v.show(v.set_weight(v.parse(x), weight)))(col(vector))


@function("strip")
def strip(vector) -> Column:
    return _udf("string", lambda x: v.show(v.strip(v.parse(x))))(col(vector))


def concat(a, b) -> Column:
    """vector || vector."""
    return _udf("string", lambda x, y: v.show(v.concat(v.parse(x), v.parse(y))))(col(a), col(b))


@function("tsvector_to_array")
def tsvector_to_array(vector) -> Column:
    return _udf("array<string>", lambda x: sorted(v.parse(x), key=str.encode))(col(vector))


def postings(text, config: str = "english") -> Column:
    """Distinct lexemes, to be exploded into an inverted index."""
    return _udf("array<string>", lambda x: sorted(v.lexemes(x, config)))(col(text))
