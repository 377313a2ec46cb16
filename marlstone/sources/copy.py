"""COPY FROM and COPY TO in text and CSV form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def copy_from(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv", header: bool | str = False, delimiter: str | None = None, null: str | None = None, quote: str = '"', escape: str = '"', force_null: list[str] | None = None, force_not_null: list[str] | None = None) -> DataFrame:
    """CSV: an unquoted empty field is NULL, a quoted one the empty text.  Text: tabs, backslash escapes and \\N.

    Bad values raise.  header="match" also compares the names with the schema's.
    """
    if fmt == "text":
        return _text(spark, path, schema, delimiter or "\t", "\\N" if null is None else null)
    texts = StructType([StructField(f.name, StringType()) for f in schema])
    read = spark.read.option("sep", delimiter or ",").option("quote", quote).option("escape", escape).option("multiLine", True).option("mode", "FAILFAST").option("enforceSchema", header != "match")
    # Marks for NULL and for the quoted empty text, told apart and put in place below.
    read = read.option("header", bool(header)).option("nullValue", "" if null is None else null).option("emptyValue", "")
    rows = read.schema(texts).csv(path)
    missing = "" if null is None else null

    def column(f: StructField):
        x = F.col(f"`{f.name}`")
        if force_null and f.name in force_null:
            x = F.nullif(x, F.lit(missing))
        if force_not_null and f.name in force_not_null:
            x = F.coalesce(x, F.lit(missing))
        return x.cast(f.dataType).alias(f.name)

    return rows.select(*[column(f) for f in schema])


def _text(spark: SparkSession, path: str, schema: StructType, delimiter: str, null: str) -> DataFrame:
    import re

    parts = F.split(F.col("value"), "(?<!\\\\)" + re.escape(delimiter), -1)
    lines = spark.read.text(path).where("value <> '\\\\.'").select(parts.alias("p"))
    plain = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\\\\"), F.lit("\\"))
    return lines.select(*[F.when(F.get("p", F.lit(i)) == null, None).otherwise(plain(F.get("p", F.lit(i)))).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])


def _shown(df: DataFrame):
    out = []
    for f in df.schema:
        x = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind == "boolean":
            x = F.when(x, "t").when(~x, "f")
        elif kind == "binary":
            x = F.concat(F.lit("\\x"), F.lower(F.hex(x)))
        elif kind == "array":
            x = F.concat(F.lit("{"), F.array_join(x.cast("array<string>"), ",", "NULL"), F.lit("}"))
        out.append(x.cast("string").alias(f.name))
    return df.select(*out)


def copy_to(df: DataFrame, path: str, fmt: str = "csv", header: bool = False, delimiter: str | None = None, null: str | None = None, quote: str = '"', escape: str = '"', mode: str = "errorifexists") -> None:
    """Files of rows in PostgreSQL's text forms."""
    shown = _shown(df)
    if fmt == "csv":
        shown.write.mode(mode).option("sep", delimiter or ",").option("header", header).option("quote", quote).option("escape", escape).option("nullValue", null or "").option("emptyValue", '""').csv(path)
        return
    escaped = [F.coalesce(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(f"`{c}`", r"\\", r"\\\\"), "\t", r"\\t"), "\n", r"\\n"), "\r", r"\\r"), F.lit("\\N" if null is None else null)) for c in shown.columns]
    shown.select(F.concat_ws(delimiter or "\t", *escaped).alias("value")).write.mode(mode).text(path)
