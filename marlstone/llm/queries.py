"""The queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, line_dedup, near_dedup, packing, pii, pitman_yor, quality, tiff, token_output, tokenize
from .common import OWN, table, with_uid


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(with_uid(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return found.select(F.col(OWN + "id").alias("doc_id"), "lang", "n_tokens", "log10_prob", "log10_perplexity", "threshold", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup_lines(docs)
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(with_uid(table(spark, sf_dir, "documents")), keep="max")
    return found.select(F.col(exact_dedup.ID).alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex(exact_dedup.DIGEST)).alias("text_sha256"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(with_uid(table(spark, sf_dir, "documents")))
    return found.select(F.col(OWN + "id").alias("doc_id"), "class_id", "class_size", "kept")



def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary files are installed; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())



def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = token_output.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"))
    n_tokens = F.element_at("cu_seqlens", -1).cast("long").alias("n_tokens")
    return packed.select("block", "row", n_tokens, F.size("doc_ids").alias("n_segments"), "doc_ids", "starts", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.stored_features(table(spark, sf_dir, "documents"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op4_token_output": op4_token_output,
    "op5_tiff": op5_tiff,
    "op6_pitman_yor": op6_pitman_yor,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_bpe": op10_bpe,
}
SQL: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL,
}
