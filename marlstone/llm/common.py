"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every column that an operator adds for itself, so that columns of the caller can't clash.
OWN = "__ms_"
UID = OWN + "uid"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; one of our own only where the session names none and runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table cuts lineage and survives lost executors, as its files are in
    the shared store.  Results are lazy and may read these tables later, so a call
    leaves its folder behind; `drop` removes it once the result has been written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/marlstone-{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Removes one table, or all of them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and broadcasts that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_uid(docs: DataFrame) -> DataFrame:
    """Adds a row id.

    It is (scan partition << 33) + row, hence the same in every scan of the same
    files within a call.  `docs` must be a plain scan (or one with narrow steps).
    """
    return docs.withColumn(UID, F.monotonically_increasing_id())


#: A key is hot if it has more than this share of all rows, so there are at most as many hot keys.
HOT_KEYS = 1024


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str) -> DataFrame:
    """Inner join with a `right` that has one row a key, where column `count` says how many rows of `left` the key has.

    Hot keys, at most HOT_KEYS of them, are broadcast, so that they are not dealt to one task each; `right` should be a written table.
    """
    least = F.lit((right.agg(F.sum(count)).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(right.where(F.col(count) > least))
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col(count) <= least), on)
    return left.join(hot, on).unionByName(rest)


def keep_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """`docs` (with UID) without the rows whose UID is in `dropped`; a shuffle on the unique row id, so it is never skewed."""
    return docs.join(dropped.select(UID), UID, "left_anti")


def batches(rows: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[list]]:
    """Python lists of the named columns, batch by batch."""
    for b in rows:
        if b.num_rows:
            yield [b.column(b.schema.get_field_index(c)).to_pylist() for c in columns]


def sliced(rows: Iterator[pa.RecordBatch], n: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows, `n` at a time, as long texts take several times their bytes once they are Python's."""
    for b in rows:
        for i in range(0, b.num_rows, n):
            yield b.slice(i, n)


def afresh(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`sliced`, once memory that earlier tasks of this worker have freed is the system's again; a C library may not offer that."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()
    yield from sliced(rows)


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fold(parts: DataFrame, key: str, slot_on: list[str], merge, work: Workspace, name: str, fan_in: int = 64) -> DataFrame:
    """Merges rows of partial results until each key has one, at most about `fan_in` rows in a task at a time.

    merge: (key values, pa.Table) -> pa.Table with one row and the schema of `parts`.
    """
    parts, step = work.save(parts, f"{name}0"), 0
    while (most := parts.groupBy(key).count().agg(F.max("count")).first()[0] or 0) > 1:
        slots, step = -(-most // fan_in), step + 1
        slot = F.pmod(F.xxhash64(*slot_on), F.lit(slots)) if slots > 1 else F.lit(0).cast("long")
        parts = work.save(parts.withColumn(OWN + "slot", slot).groupBy(key, OWN + "slot").applyInArrow(merge, parts.schema), f"{name}{step}")
    return parts
