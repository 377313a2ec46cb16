"""WITH RECURSIVE as rounds of DataFrames; each round is written to reliable storage, so plans stay short."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MOST_ROUNDS = 10_000


def _folder(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only where it names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return f"{found or 'file://' + tempfile.mkdtemp(prefix='marlstone-')}/recursive-{uuid.uuid4().hex[:12]}"


def recursive_union(base: DataFrame, step: Callable[[DataFrame], DataFrame], all: bool = False, most_rounds: int = MOST_ROUNDS) -> DataFrame:  # noqa: A002
    """base UNION [ALL] step(rows of the round before), until a round gives nothing (new).

    Without `all`, rows that were seen before are dropped, so cycles end.
    """
    spark, folder = base.sparkSession, _folder(base.sparkSession)

    def kept(df: DataFrame, n: int) -> DataFrame:
        df.write.parquet(f"{folder}/round={n}")
        return spark.read.schema(df.schema).parquet(f"{folder}/round={n}")

    columns = base.columns
    rows = kept(base if all else base.distinct(), 0)
    seen, n = rows, 0
    while not rows.isEmpty():
        n += 1
        if n > most_rounds:
            raise RuntimeError(f"recursive query took over {most_rounds} rounds")
        new = step(rows).toDF(*columns)
        new = new.select(*[new[c].cast(f.dataType) for c, f in zip(columns, base.schema, strict=True)])
        if not all:
            new = new.distinct().join(seen, [new[c].eqNullSafe(seen[c]) for c in columns], "left_anti")
        rows = kept(new, n)
        seen = seen.unionAll(rows)
    return seen
