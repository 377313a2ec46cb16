"""Nearest neighbours: exact top-k, and an inverted-file index of k-means lists."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import METRICS
from .ordering import order

LISTS = 100
MOST_LISTS = 32_768
#: Vectors sampled for training: that many for each list, and at least so many.
SAMPLE_PER_LIST, LEAST_SAMPLE = 50, 2000
ROUNDS = 12


def knn(df: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "vec_id", metric: str = "l2") -> DataFrame:
    """The k nearest rows with `distance`; ties by key.  Distances are built-in expressions, the sort keeps k rows a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("distance", METRICS[metric](F.col(vector), q)).orderBy(order("distance"), order(key)).limit(k)


def knn_batch(df: DataFrame, queries: dict[int, list[float]], k: int, vector: str = "embedding", key: str = "vec_id", metric: str = "l2") -> DataFrame:
    """query_id, key, distance: the k nearest of each of a stated, bounded set of queries, in blocks of matrix products."""
    ids, wanted = list(queries), np.array(list(queries.values()), np.float64)
    kind = dict(df.dtypes)[key]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        for b in rows:
            if not b.num_rows:
                continue
            own = b.column(0).to_numpy(zero_copy_only=False)
            x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            d = _distances(x, wanted, metric)
            for i in range(len(ids)):
                dd, kk = np.concatenate((best[i][0], d[:, i])), np.concatenate((best[i][1], own))
                at = np.lexsort((kk, dd))[:k]
                best[i] = dd[at], kk[at]
        for i, (dd, kk) in zip(ids, best, strict=True):
            if len(dd):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(dd), pa.int64()), pa.array(kk), pa.array(dd)], names=["query_id", key, "distance"])

    from .distinct import first_per_group

    near = df.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"query_id long, {key} {kind}, distance double")
    return first_per_group(near, ["query_id"], [order("distance"), order(key)], k)


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "inner":
        return -(x @ q.T)
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - np.clip(x @ q.T / np.sqrt((x * x).sum(1)[:, None] * (q * q).sum(1)[None, :]), -1, 1)
    return np.sqrt(np.stack([((x - y) ** 2).sum(1) for y in q], axis=1))


class IvfIndex:
    """Lists of vectors by nearest k-means centre.  The centres are trained on a bounded sample; every row is in a list."""

    def __init__(self, df: DataFrame, vector: str = "embedding", metric: str = "l2", lists: int = LISTS, seed: int = 42):
        if not 1 <= lists <= MOST_LISTS:
            raise ValueError(f"lists must be between 1 and {MOST_LISTS}")
        self.vector, self.metric, self.lists = vector, metric, lists
        want = max(LEAST_SAMPLE, SAMPLE_PER_LIST * lists)
        some = df.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(vector, F.lit(seed))).limit(want)
        x = np.array([r[0] for r in some.collect()], np.float64)
        self.centres = _train(self._unit(x), min(lists, len(x)), seed) if len(x) else np.zeros((0, 1))
        self.rows = self._assigned(df)

    def _unit(self, x: np.ndarray) -> np.ndarray:
        if self.metric not in ("cosine", "inner"):
            return x
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(norm > 0, x / np.where(norm > 0, norm, 1), x)

    def _assigned(self, df: DataFrame) -> DataFrame:
        centres, unit, at = self.centres, self._unit, df.columns.index(self.vector)

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                if b.num_rows:
                    column = b.column(at).to_pylist()
                    got = np.full(len(column), -1, np.int32)
                    there = [i for i, v in enumerate(column) if v is not None]
                    if there and len(centres):
                        got[there] = _nearest(unit(np.array([column[i] for i in there], np.float64)), centres)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], names=[*b.schema.names, "list_id"])

        from pyspark.sql.types import IntegerType, StructField, StructType

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField("list_id", IntegerType())]))

    def save(self, path: str) -> None:
        """Rows by list, so that a search reads its lists only."""
        self.rows.write.partitionBy("list_id").parquet(path)

    def probes(self, query: list[float], n: int | None = None) -> list[int]:
        q = self._unit(np.array([query], np.float64))
        n = n or math.ceil(math.sqrt(self.lists))
        d = ((self.centres - q) ** 2).sum(1)
        return np.argsort(d, kind="stable")[:n].tolist()

    def search(self, query: list[float], k: int, probes: int | None = None, key: str = "vec_id", rows: DataFrame | None = None) -> DataFrame:
        """Exact within the nearest lists."""
        rows = self.rows if rows is None else rows
        return knn(rows.where(F.col("list_id").isin(self.probes(query, probes))), query, k, self.vector, key, self.metric)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int32)
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096]
        out[i : i + 4096] = ((centres * centres).sum(1)[None, :] - 2 * part @ centres.T).argmin(1)
    return out


def _train(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ seeds, then Lloyd rounds until the assignment stays."""
    g = np.random.default_rng(seed)
    centres = [x[g.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
        centres.append(x[g.choice(len(x), p=p)])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
    c, last = np.array(centres), None
    for _ in range(ROUNDS):
        own = _nearest(x, c)
        if last is not None and (own == last).all():
            break
        for i in range(k):
            if (own == i).any():
                c[i] = x[own == i].mean(0)
        last = own
    return c
