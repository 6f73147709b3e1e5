"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dedup, html_text, licenses, mixing, packing, quality, simhash, token_rollup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of ``embeddings``, one row per vector; unusable vectors link with nothing."""
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and components of ``documents``; null and blank texts have the fingerprint zero."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``; null html has an empty text."""
    found = html_text.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all ``conversations`` and of one that tries to break the template; null texts are empty."""
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_conversations(rows))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all ``documents`` takes of each; null texts have size zero, null sources are one source."""
    return mixing.shares(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all ``documents``; null texts have no words and fail the base rule."""
    return quality.measure(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence family of every row of ``documents``; texts without a notice, null ones too, are unknown."""
    return licenses.summarise(licenses.scan(_table(spark, sf_dir, "documents")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the words of all ``documents`` are packed; blank and null texts take no room."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens of ``documents`` by source and language, through loads, revisions and deletes."""
    return token_rollup.count_documents(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC records and read back; null html is an empty payload."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_simhash": op2_simhash,
    "op3_html_text": op3_html_text,
    "op4_chat_format": op4_chat_format,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_licenses": op7_licenses,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_warc": op10_warc,
}
ORACLES: dict[str, str] = {
    "op1_embedding_dedup": embedding_dedup.ORACLE, "op4_chat_format": chat.ORACLE, "op5_mixing": mixing.ORACLE, "op10_warc": warc.ORACLE
}
