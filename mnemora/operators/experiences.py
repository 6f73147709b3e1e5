"""Experiences: validated stores, searches, statistics, cleanup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..functions.stemming import stems


def validation_error(context: Column, outcome: Column, confidence: Column, kind: Column) -> Column:
    """The first rule that an experience breaks; null if it is valid. Lengths are in characters."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(blank(context), "blank context").when(blank(outcome), "blank outcome").when(F.length(context) > 500, "context too long").when(
            F.length(outcome) > 1000, "outcome too long"
        )
        .when(
            confidence.isNull() | F.isnan(confidence) | ~confidence.between(0.0, 1.0), "confidence out of range"
        ).when(kind.isNull() | ~kind.isin(*vocab.EXPERIENCE_TYPES), "unknown type")
    )


def store(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows to append, rejected (experience_id, error))``: valid experiences under new ids."""
    error = validation_error(F.col("context"), F.col("outcome"), F.col("confidence"), F.col("experience_type"))
    known = existing.select("experience_id", F.lit("duplicate id").alias("__taken")).distinct()
    checked = new.withColumn("__error", error).join(known, "experience_id", "left").withColumn("__error", F.coalesce("__error", "__taken")).drop("__taken")
    return checked.where("__error is null").drop("__error"), checked.where("__error is not null").select("experience_id", F.col("__error").alias("error"))


def _kept(df: DataFrame, kind: str | None, min_confidence: float) -> DataFrame:
    df = df.where(F.col("confidence") >= min_confidence)
    return df if kind is None else df.where(F.col("experience_type") == kind)


def _newest(df: DataFrame, limit: int | None) -> DataFrame:
    ordered = df.orderBy(F.desc("timestamp"), "experience_id")
    return ordered if limit is None else ordered.limit(limit)


def retrieve(df: DataFrame, limit: int | None = None, kind: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    return _newest(_kept(df, kind, min_confidence), limit)


def search_contains(df: DataFrame, query: str, kind: str | None = None, min_confidence: float = 0.0, limit: int = 10) -> DataFrame:
    """The whole query in context or outcome, in any case."""
    hit = F.contains(F.lower("context"), F.lit(query.lower())) | F.contains(F.lower("outcome"), F.lit(query.lower()))
    return _newest(_kept(df, kind, min_confidence).where(hit), limit)


def search_stemmed(df: DataFrame, query: str, kind: str | None = None, min_confidence: float = 0.0, limit: int = 10) -> DataFrame:
    """Every term of the query, Porter-stemmed, among the stems of context, outcome and id; a blank query takes all."""
    terms = F.array_distinct(F.filter(F.split(F.lower(F.lit(query)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    rows = _kept(df, kind, min_confidence)
    if not query.strip():
        return _newest(rows, limit)
    said = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", "context", "outcome", "experience_id")), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    marked = rows.withColumn("__stems", stems(said)).withColumn("__terms", stems(terms))
    return _newest(marked.where(F.size(F.array_except("__terms", "__stems")) == 0).drop("__stems", "__terms"), limit)


def statistics(df: DataFrame) -> DataFrame:
    """One row per type and ``total``: ``experience_type, n, n_compressed``."""
    return df.rollup("experience_type").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("compressed").alias("n_compressed")).select(
        F.when(F.col("g") == 1, "total").otherwise(F.col("experience_type")).alias("experience_type"), "n", "n_compressed"
    )


def compress_and_expire(df: DataFrame, now: Column, compress_days: int = 30, max_age_days: int | None = None) -> DataFrame:
    """Marks rows older than ``compress_days`` and drops those older than ``max_age_days``, both strictly."""
    marked = df.withColumn("compressed", F.col("compressed") | (F.col("timestamp") < now - F.make_dt_interval(F.lit(compress_days))))
    return marked if max_age_days is None else marked.where(F.col("timestamp") >= now - F.make_dt_interval(F.lit(max_age_days)))


def trim(df: DataFrame, max_experiences: int) -> DataFrame:
    """Beyond ``max_experiences`` rows: patterns of confidence 0.8 and more, and the newest ``max_experiences``; else all."""
    key = F.col("experience_id")
    sure = df.where((F.col("experience_type") == "pattern") & (F.col("confidence") >= 0.8)).select(key)
    newest = df.orderBy(F.desc("timestamp"), "experience_id").limit(max_experiences).select(key)
    over = df.agg((F.count("*") > max_experiences).alias("over"))
    every = df.select(key).crossJoin(F.broadcast(over.where(~F.col("over")))).select("experience_id")  # one row at most
    return df.join(sure.union(newest).union(every).distinct(), "experience_id", "left_semi")


def relevance(context: Column, kind: Column, confidence: Column, timestamp: Column, query: str, now: Column) -> Column:
    """Shared content words, weighted by type, confidence and age; 1 at most. Ages below zero count as zero."""
    weight = F.when(kind == "pattern", 1.5).when(kind == "insight", 1.3).otherwise(1.0)
    age = F.greatest(F.floor((now.cast("double") - timestamp.cast("double")) / 86400), F.lit(0))
    fresh = F.greatest(F.lit(0.7), 1.0 - age / 90.0 * 0.3)
    return F.least(T.jaccard(T.tokens(context), T.query_tokens(query)) * weight * (0.5 + confidence * 0.5) * fresh, F.lit(1.0))


def retrieve_relevant(
    df: DataFrame, query: str, now: Column, top_k: int = 10, min_similarity: float = 0.0, order: Sequence[str] = ("experience_id",)
) -> DataFrame:
    """The most relevant experiences, ties in ``order``."""
    score = relevance(F.col("context"), F.col("experience_type"), F.col("confidence"), F.col("timestamp"), query, now)
    return df.withColumn("relevance", score).where(F.col("relevance") >= min_similarity).orderBy(F.desc("relevance"), *order).limit(top_k)


def as_map(df: DataFrame) -> DataFrame:
    """``(experience_id, json)``: an experience as a JSON object."""
    return df.select("experience_id", F.to_json(F.struct(*df.columns)).alias("json"))


def from_map(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("json", schema).alias("e")).select("e.*")
