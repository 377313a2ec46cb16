"""Encoding and decoding of a table of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import batches

#: Rows whose ids are held at a time.
ROWS = 64


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the ids of every whole text; a narrow step, so no row moves."""
    shared = bpe.broadcast_vocabulary(docs.sparkSession, vocabulary)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.on_worker(shared)
        for ids, texts in batches(rows, ["doc_id", "text"]):
            for at in range(0, len(ids), ROWS):
                got = list(coder.encode_batch(texts[at : at + ROWS]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + ROWS], pa.int64()), pa.array([g.astype(np.int32) for g in got], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""
    shared = bpe.broadcast_vocabulary(encoded.sparkSession, vocabulary)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.on_worker(shared)
        for ids, tokens in batches(rows, ["doc_id", "ids"]):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([coder.decode(t or []) for t in tokens], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of the text decoded from them."""
    import hashlib

    shared = bpe.broadcast_vocabulary(docs.sparkSession, vocabulary)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.on_worker(shared)
        decimal = list(map(str, range(coder.size)))
        for ids, texts in batches(rows, ["doc_id", "text"]):
            counts, coded, decoded = [], [], []
            for got in map(np.ndarray.tolist, coder.encode_batch(texts)):
                counts.append(len(got))
                coded.append(hashlib.sha256(",".join([decimal[i] for i in got]).encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(got).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
