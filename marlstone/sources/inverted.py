"""Inverted indexes as tables of postings: candidates by semi join, then the filter itself as a recheck.

Postings can be stored, in order of what is looked up, so that a search of a stored index reads a few row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text_search import postings, text_matches
from ..text import query as q


class TextIndex:
    """lexeme -> key.  Queries that only negate can't be answered by postings and are filtered in full."""

    def __init__(self, df: DataFrame, key: str, text: str, config: str = "english"):
        self.df, self.key, self.text, self.config = df, key, text, config
        self.postings = df.select(F.col(key), F.explode(postings(F.col(text), config)).alias("lexeme"))

    def store(self, path: str) -> TextIndex:
        """Writes the postings; searches read them from then on."""
        self.postings.repartitionByRange("lexeme").sortWithinPartitions("lexeme").write.parquet(path)
        return self.stored(path)

    def stored(self, path: str) -> TextIndex:
        """With the postings that `store` wrote."""
        self.postings = self.df.sparkSession.read.parquet(path)
        return self

    def candidates(self, node) -> DataFrame | None:
        """Keys of rows that may match; None: all."""
        if node is None or node[0] == "not":
            return None
        if node[0] == "lexeme":
            hit = F.startswith("lexeme", F.lit(node[1])) if node[2] else F.col("lexeme") == node[1]
            return self.postings.where(hit).select(self.key).distinct()
        a, b = self.candidates(node[1]), self.candidates(node[2])
        if node[0] == "or":
            return None if a is None or b is None else a.unionAll(b).distinct()
        return b if a is None else a if b is None else a.join(b, self.key, "left_semi")

    def search(self, query: str) -> DataFrame:
        found = self.candidates(q.parse(query))
        rows = self.df if found is None else self.df.join(found, self.key, "left_semi")
        return rows.where(text_matches(F.col(self.text), query, self.config))


class JsonIndex:
    """(path=value) -> key of flat pairs of JSON objects, for @> with flat patterns."""

    def __init__(self, df: DataFrame, key: str, column: str):
        self.df, self.key, self.column = df, key, column
        pairs = F.from_json(F.col(column), "map<string,string>")
        self.postings = df.select(F.col(key), F.explode(pairs).alias("__ms_k", "__ms_v"))

    def store(self, path: str) -> JsonIndex:
        """Writes the postings; searches read them from then on."""
        self.postings.repartitionByRange("__ms_k", "__ms_v").sortWithinPartitions("__ms_k", "__ms_v").write.parquet(path)
        return self.stored(path)

    def stored(self, path: str) -> JsonIndex:
        """With the postings that `store` wrote."""
        self.postings = self.df.sparkSession.read.parquet(path)
        return self

    def search(self, pattern: dict[str, str], recheck: Column) -> DataFrame:
        rows = self.df
        for k, v in pattern.items():
            rows = rows.join(self.postings.where((F.col("__ms_k") == k) & (F.col("__ms_v") == v)).select(self.key).distinct(), self.key, "left_semi")
        return rows.where(recheck)
