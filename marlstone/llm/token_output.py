"""Packed token-id matrices: best-fit-decreasing packing of whole documents.

Documents are encoded where they lie; each ends with the end token.  One that is longer than a row is split into
pieces losslessly.  Every block of about BLOCK_TOKENS tokens is packed on its own, so no row moves and memory
is bounded: pieces go, longest first, into the row with the least room that still holds them, which a segment
tree over free capacities finds in O(log capacity).  Each row of a block's matrix comes
with cumulative segment lengths (as variable-length attention wants them) and positions that restart
at every segment.

Defined results: null text counts as empty and gives the end token alone; padding is the end token at position 0,
beyond the last cumulative length; equal lengths keep the order of the scan; repeated rows are packed each; blocks follow the scan's partitions; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, chunks
from .common import OWN, batches

CAPACITY = 2048
BLOCK_TOKENS = 1 << 20
MEMO = 1 << 19


class CapacityTree:
    """Bins by free capacity, 0 to `most`: a segment tree whose inner nodes count the bins below them."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, free: int, by: int) -> None:
        i = free + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, bin_: int, free: int) -> None:
        self.bins[free].append(bin_)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(bin, free) with the least free capacity of at least `need`; it leaves the tree."""
        count, i = self.count, need + self.size
        while not count[i]:
            # Up until there is a right sibling with bins, then down its left edge.
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i *= 2
            if not count[i]:
                i += 1
        free = i - self.size
        bin_ = self.bins[free].pop()
        self._add(free, -1)
        return bin_, free


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of indexes into lengths, none of which is over capacity."""
    out: list[list[int]] = []
    tree = CapacityTree(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            bin_, free = len(out), capacity
            out.append([])
        else:
            bin_, free = found
        out[bin_].append(i)
        if free > n:
            tree.put(bin_, free - n)
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ChunkEncoder:
    """ids of texts by the installed byte-pair library, with a memo of chunks between which no merge can reach."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2" if max(ranks.values()) + 1 < 1 << 16 else "<u4")
        self.end = max(ranks.values()) + 1
        self.memo: dict[str, bytes] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        memo, row = self.memo, chunks(text or "")
        new = [c for c in row if c not in memo]
        if new:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = row
            one, kind = self.coder.encode_ordinary, self.dtype
            for c in set(new):
                memo[c] = np.array(one(c), kind).tobytes()
        end = np.array([self.end], self.dtype).tobytes()
        return np.frombuffer(b"".join([memo[c] for c in row]) + end, self.dtype)


_SCHEMA = pa.schema([("block", pa.string()), ("row", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
_ROWS = "block string, row int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"


def _matrix(block: str, docs: list[tuple[int | None, np.ndarray]], capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    pieces = [(i, at, ids[at : at + capacity]) for i, ids in docs for at in range(0, len(ids), capacity)]
    bins = best_fit_decreasing(np.array([len(p[2]) for p in pieces], np.int64), capacity)
    dtype = docs[0][1].dtype
    place = np.dtype("<u2" if capacity <= 1 << 16 else "<u4")
    steps = np.arange(capacity, dtype=place)
    for first in range(0, len(bins), 256):
        some = bins[first : first + 256]
        matrix, positions = np.full((len(some), capacity), end, dtype), np.zeros((len(some), capacity), place)
        cu, owners, starts = [], [], []
        for r, bin_ in enumerate(some):
            at, sums = 0, [0]
            for k in bin_:
                ids = pieces[k][2]
                matrix[r, at : at + len(ids)] = ids
                positions[r, at : at + len(ids)] = steps[: len(ids)]
                at += len(ids)
                sums.append(at)
            cu.append(sums)
            owners.append([pieces[k][0] for k in bin_])
            starts.append([pieces[k][1] for k in bin_])
        yield pa.RecordBatch.from_pydict({"block": [block] * len(some), "row": range(first, first + len(some)), "ids": [x.tobytes() for x in matrix], "positions": [x.tobytes() for x in positions], "cu_seqlens": cu, "doc_ids": owners, "starts": starts}, _SCHEMA)


def pack_documents(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of a block's matrix: block, row, ids and positions (little-endian, capacity of them), cu_seqlens, doc_ids, starts.

    starts: where in its document each segment begins.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # the vocabulary's size, whatever the input

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task = ChunkEncoder(ranks.value), TaskContext.get().partitionId()
        held, size, done = [], 0, 0
        for ids, texts in batches(rows, [OWN + "id", "text"]):
            for i, t in zip(ids, texts, strict=True):
                got = encode(t)
                held.append((i, got))
                size += len(got)
                if size >= block_tokens:
                    yield from _matrix(f"{task}-{done}", held, capacity, encode.end)
                    held, size, done = [], 0, done + 1
        if held:
            yield from _matrix(f"{task}-{done}", held, capacity, encode.end)

    return docs.select(F.col(id_col).cast("long").alias(OWN + "id"), F.col(text_col).alias("text")).mapInArrow(run, _ROWS)


def write_packed(packed: DataFrame, path: str) -> None:
    """Rows of matrices as Parquet; a block's rows lie in one file, in order."""
    packed.write.option("compression", "zstd").parquet(path)
