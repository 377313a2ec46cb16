"""Optimal length buckets and token-budget batches.

Lengths are cut into pieces of at most `longest` tokens, so the global histogram of piece lengths has at most
that many entries.  Dynamic programming over it chooses the bucket boundaries that minimise padding.
Inside a bucket, pieces are dealt to shards of about SHARD pieces (their number follows from
the histogram), numbered there, and cut into batches of budget // boundary rows.  So no bucket, however full,
is numbered in one task; each shard leaves one batch at most that isn't full.

Defined results: null text counts as empty; texts without tokens have one piece of length 0 in the first
bucket; rows that repeat an id are pieces of their own; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, UID, Workspace, with_uid

BUCKETS = 16
LONGEST = 4096
BUDGET = 1 << 16
SHARD = 4096


def word_count(text: str) -> Column:
    """Words as the language model has them: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending upper bounds, the last of them the largest length, that minimise the sum of (bound - length)."""
    order = np.argsort(lengths)
    x, n = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    if not len(x):
        return []
    rows = np.concatenate(([0], np.cumsum(n)))
    tokens = np.concatenate(([0], np.cumsum(n * x)))
    k = min(buckets, len(x))
    # best[j]: least padding of the j shortest lengths in the buckets so far; cost[i, j]: lengths i+1 .. j in one bucket.
    best = x * rows[1:] - tokens[1:]
    best = np.concatenate(([0], best))
    cut = np.zeros((k, len(x) + 1), np.int64)
    for b in range(1, k):
        now = np.empty_like(best)
        now[0] = 0
        for j in range(1, len(x) + 1):
            total = best[:j] + x[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            cut[b, j] = i = int(total.argmin())
            now[j] = total[i]
        best = now
    out, j = [], len(x)
    for b in range(k - 1, -1, -1):
        if j:
            out.append(int(x[j - 1]))
            j = int(cut[b, j])
    return sorted(set(out))


def pieces(docs: DataFrame, length: Column, longest: int = LONGEST, id_col: str = "doc_id") -> DataFrame:
    """UID, doc_id, piece, start, n_tokens: each document's tokens in runs of at most `longest`."""
    sized = with_uid(docs).select(UID, F.col(id_col).cast("long").alias("doc_id"), length.alias("whole"))
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("whole") / longest).cast("int") - 1, F.lit(0)))))
    start = (F.col("piece") * longest).cast("long")
    return cut.select(UID, "doc_id", "piece", start.alias("start"), F.least(F.lit(longest), F.col("whole") - start).cast("long").alias("n_tokens"))


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, longest: int = LONGEST, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket, boundary, batch, place, padding.

    length: tokens of a row; words of text_col unless given.  batch is bucket-shard-number.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    cut = work.save(pieces(docs, word_count(text_col) if length is None else length, longest, id_col), "pieces")
    histogram = cut.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()  # at most longest + 1 rows
    lengths, counts = (np.array([r[k] for r in histogram], np.int64) for k in ("n_tokens", "n"))
    bounds = boundaries(lengths, counts, buckets)
    if not bounds:
        return cut.select("doc_id", "piece", "start", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("boundary"), F.lit("").alias("batch"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("padding"))
    held = [int(counts[(lengths <= b) & (lengths > a)].sum()) for a, b in zip([-1, *bounds], bounds, strict=False)]
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(bucket)
    of = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket") + 1)
    placed = cut.withColumn("bucket", bucket).withColumn("boundary", of(bounds)).withColumn(OWN + "shards", of([-(-n // SHARD) or 1 for n in held]))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(UID, "piece"), F.col(OWN + "shards")))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(F.col("n_tokens").desc(), F.col("doc_id").asc_nulls_last(), "piece", UID)) - 1
    size = F.greatest(F.expr(f"{budget} div greatest(boundary, 1)"), F.lit(1))
    out = placed.withColumn("rank", rank).withColumn("size", size)
    batch = F.concat_ws("-", "bucket", "shard", F.expr("rank div size"))
    return out.select("doc_id", "piece", "start", "n_tokens", "bucket", "boundary", batch.alias("batch"), F.expr("cast(rank % size as int)").alias("place"), (F.col("boundary") - F.col("n_tokens")).alias("padding"))
