"""Exact deduplication over a log-structured merge index of text digests.

Write path.  Each task keeps a memtable (digest -> smallest id, largest id, count).  A full
memtable is flushed as a sorted run, cut at digest-prefix boundaries into one
segment per shard.  Shards are compacted level by level: up to `fan_in` segments of
a shard merge into one, so no task ever holds more than its share, and copies of a
text shrink to one entry per run before anything is shuffled.  Compaction keeps the smallest
and the largest identifier; which of them names the group is the caller's `keep`.

Read path.  Digests that occur once need no lookup.  The others are the index's
*hits*: each compacted segment carries a Bloom filter over its hits, the filters (of a
fixed total size) are broadcast, rows that pass are compared byte by byte, grouped by
(digest, text).  Texts that share a digest but differ become separate groups.

Defined results: null text counts as empty; a null id sorts before every other
id; rows that repeat an id and a text stay apart (one of them is kept); extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, UID, Workspace, keep_rows, with_uid

DIGEST = OWN + "digest"
ID = OWN + "id"
#: Rows a shard of the digest space should hold; the number of shards is a power of two, 2^16 at most.
SHARD_ROWS = 400_000
LEAST_SHARD_BITS, MOST_SHARD_BITS = 6, 16
#: Distinct digests in a memtable before it is flushed.
MEMTABLE = 1 << 18
#: Bits of all shards' filters together: 4 MiB are broadcast, whatever the input.  A full filter costs work, never results.
FILTER_BITS = 1 << 25
FILTER_HASHES = 3
#: Segments that one compaction step merges.
FAN_IN = 64

_RUN = "shard int, run string, digests binary, low binary, high binary, n binary, bare binary"
NULL_ID = -(1 << 63)


def _merged(digests: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted, each digest once: smallest and largest id, sum of counts."""
    words = digests.view(">u8").reshape(-1, 4)
    order = np.lexsort((words[:, 3], words[:, 2], words[:, 1], words[:, 0]))
    words = words[order]
    first = np.ones(len(words), bool)
    first[1:] = (words[1:] != words[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    return digests[order][at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at), np.add.reduceat(n[order], at), np.maximum.reduceat(bare[order], at)


def _shard(digests: np.ndarray, bits: int) -> np.ndarray:
    return (digests.view(">u2").reshape(-1, 16)[:, 0] >> (16 - bits)).astype(np.int64)


def _segments(entries: tuple[np.ndarray, ...], run: str, bits: int) -> Iterator[tuple]:
    shard = _shard(entries[0], bits)
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True):
        yield (int(shard[a]), run, *(x[a:b].tobytes() for x in entries))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["shard", "run", "digests", "low", "high", "n", "bare"]
    kinds = [pa.int32(), pa.string(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _flush_runs(capacity: int, bits: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, flushed, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, flushed
            entries = _merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size, flushed = [], 0, flushed + 1
            return _batch(list(_segments(entries, f"{task}-{flushed}", bits)))

        for b in rows:
            if not b.num_rows:
                continue
            digests = np.frombuffer(b"".join(b.column(0).to_pylist()), "V32")
            ids = b.column(1).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((digests, ids, ids, np.ones(len(ids), np.int64), b.column(1).is_null().to_numpy(zero_copy_only=False).astype(np.int8)))
            size += len(ids)
            if size >= capacity:
                yield flush()
        if held:
            yield flush()

    return run


_KINDS = ("V32", np.int64, np.int64, np.int64, np.int8)


def _compact(bits: int):
    """Merges the segments of a shard's slot, `fan_in` or so, into one."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found = rows.select(["digests", "low", "high", "n", "bare"]).to_pylist()
        parts = [tuple(np.frombuffer(x, k) for x, k in zip(r.values(), _KINDS, strict=True)) for r in found]
        entries = _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return pa.Table.from_batches([_batch(list(_segments(entries, f"slot{key[1].as_py()}", bits)))])

    return run


def _positions(words: np.ndarray, size: int) -> np.ndarray:
    """Filter bits of digests, given as (n, 4) words: double hashing on two words that don't choose the shard."""
    steps = np.arange(FILTER_HASHES, dtype=np.uint64)
    return (words[:, 1:2] + steps * (words[:, 2:3] | np.uint64(1))) % np.uint64(size)


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4).astype(np.uint64)


class DigestIndex:
    """The compacted index over `staged` (UID, ID long, DIGEST binary of 32 bytes), a written table."""

    def __init__(self, staged: DataFrame, work: Workspace, memtable: int = MEMTABLE, fan_in: int = FAN_IN):
        self.bits = min(MOST_SHARD_BITS, max(LEAST_SHARD_BITS, (staged.count() // SHARD_ROWS).bit_length()))
        self.filter_bits = FILTER_BITS >> self.bits
        runs = work.save(staged.select(DIGEST, ID).mapInArrow(_flush_runs(memtable, self.bits), _RUN), "runs")
        level = 0
        while (most := runs.groupBy("shard").count().agg(F.max("count")).first()[0] or 0) > 1:
            slots = -(-most // fan_in)
            dealt = runs.withColumn("slot", F.pmod(F.xxhash64("run"), F.lit(slots)))
            level += 1
            runs = work.save(dealt.groupBy("shard", "slot").applyInArrow(_compact(self.bits), _RUN), f"level{level}")
        self.runs = runs

    def entries(self) -> DataFrame:
        """digest, low, high, n: one row per distinct digest."""
        schema = f"{DIGEST} binary, low long, high long, n long, bare boolean"

        def unpack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                for r in b.to_pylist():
                    low, high, n = (np.frombuffer(r[k], np.int64) for k in ("low", "high", "n"))
                    d = r["digests"]
                    yield pa.RecordBatch.from_arrays([pa.array([d[i : i + 32] for i in range(0, len(d), 32)], pa.binary()), pa.array(low), pa.array(high), pa.array(n), pa.array(np.frombuffer(r["bare"], np.int8).astype(bool))], names=[DIGEST, "low", "high", "n", "bare"])

        return self.runs.mapInArrow(unpack, schema)

    def hit_filters(self) -> dict[int, bytes]:
        """A Bloom filter per shard over the digests that occur more than once; FILTER_BITS bits in all."""
        size = self.filter_bits

        def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                for r in b.to_pylist():
                    bits = np.zeros(size, bool)
                    words = np.frombuffer(r["digests"], ">u8").reshape(-1, 4).astype(np.uint64)
                    bits[_positions(words[np.frombuffer(r["n"], np.int64) > 1], size).ravel().astype(np.int64)] = True
                    yield pa.RecordBatch.from_arrays([pa.array([r["shard"]], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["shard", "bits"])

        found = self.runs.select("shard", "digests", "n").mapInArrow(build, "shard int, bits binary")
        return {r["shard"]: r["bits"] for r in found.collect()}


def _passing(filters, bits: int, size: int):
    """The rows whose digest may be a hit."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1 << bits, size // 8), np.uint8)
        for shard, packed in filters.value.items():
            held[shard] = np.frombuffer(packed, np.uint8)
        for b in rows:
            if not b.num_rows:
                continue
            digests = np.frombuffer(b"".join(b.column(1).to_pylist()), "V32")
            at = _positions(digests.view(">u8").reshape(-1, 4).astype(np.uint64), size).astype(np.int64)
            byte = held[_shard(digests, bits)[:, None], at >> 3]
            yield b.filter(pa.array((byte >> (7 - (at & 7)) & 1).all(axis=1)))

    return run


def groups(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """One row per document: UID, id, DIGEST, keep_id, group_size, kept.

    `docs` must have UID (see with_uid).  keep: "min" or "max" identifier of a group stays.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "exact")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digested = docs.select(UID, F.col(id_col).cast("long").alias(ID), F.unhex(F.sha2(text, 256)).alias(DIGEST))
    staged = work.save(digested, "digests")
    index = DigestIndex(staged, work)
    hits = index.entries().where("n > 1")

    filters = spark.sparkContext.broadcast(index.hit_filters())
    # Byte verification: (digest, text) is grouped with the text itself as key, after a combine in each task.
    suspects = docs.select(text.alias("text"), F.unhex(F.sha2(text, 256)).alias(DIGEST)).mapInArrow(_passing(filters, index.bits, index.filter_bits), f"text string, {DIGEST} binary")
    clashes = work.save(suspects.groupBy(DIGEST, "text").agg(F.lit(1).alias("one")).groupBy(DIGEST).count().where("count > 1").select(DIGEST), "clashes")

    chosen = F.col("high") if keep == "max" else F.col("low")
    chosen = F.when(F.col("bare") if keep == "min" else chosen == NULL_ID, None).otherwise(chosen)
    sized = hits.select(DIGEST, chosen.alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("hit"))
    if clashes.take(1):
        sized = sized.join(clashes, DIGEST, "left_anti")
    # A digest held by many rows makes this join's left side uneven; AQE splits such partitions, the right side has one row per key.
    merged = staged.join(sized, DIGEST, "left")
    out = merged.select(UID, ID, DIGEST, F.when(F.col("hit"), F.col("keep_id")).otherwise(F.col(ID)).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    if clashes.take(1):
        out = _separated(docs, out, clashes, text, keep)
    named = F.col(ID).eqNullSafe(F.col("keep_id"))
    # Rows that repeat the id that stays: the first of them is kept.
    repeats = out.where(named & (F.col("group_size") > 1)).groupBy(DIGEST, "keep_id").agg(F.count("*").alias("same"), F.min(UID).alias("first")).where("same > 1")
    repeats = work.save(repeats, "repeats")
    kept = named
    if repeats.take(1):
        out = out.join(repeats.select(DIGEST, F.col("keep_id").alias(OWN + "keep"), "first"), (out[DIGEST] == repeats[DIGEST]) & out["keep_id"].eqNullSafe(F.col(OWN + "keep")), "left").select(out["*"], "first")
        kept = named & (F.col("first").isNull() | (F.col("first") == F.col(UID)))
    return out.select(UID, ID, DIGEST, "keep_id", "group_size", kept.alias("kept"))


def _separated(docs: DataFrame, out: DataFrame, clashes: DataFrame, text, keep: str) -> DataFrame:
    """Groups of the rare digests that stand for several texts, told apart by the texts themselves."""
    rows = docs.select(UID, text.alias("text"), F.unhex(F.sha2(text, 256)).alias(DIGEST)).join(clashes, DIGEST, "left_semi").join(out.select(UID, ID), UID)
    pick = F.max(ID) if keep == "max" else F.min(ID)
    sizes = rows.groupBy(DIGEST, "text").agg(pick.alias("keep_id"), F.count("*").alias("group_size"))
    apart = rows.join(sizes, [DIGEST, "text"]).select(UID, ID, DIGEST, "keep_id", "group_size")
    return out.join(clashes, DIGEST, "left_anti").select(UID, ID, DIGEST, "keep_id", "group_size").unionByName(apart)


def exact_dedup(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row left of each group of equal texts; the columns are those of `docs`."""
    rows = with_uid(docs)
    found = groups(rows, keep, id_col, text_col)
    return keep_rows(rows, found.where(~F.col("kept"))).drop(UID)
