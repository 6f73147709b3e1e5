"""Recurring discoveries: counting, thresholds, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def confidence(n: Column) -> Column:
    return F.least(0.5 + n * 0.1, F.lit(0.95))


def detect(discoveries: DataFrame, threshold: int = vocab.PATTERN_THRESHOLD, max_examples: int = vocab.PATTERN_EXAMPLES) -> DataFrame:
    """``(pattern_key, n, first_seen, confidence, examples)`` of patterns seen ``threshold`` times and more.

    ``discoveries``: discovery_id, type, link_type, file, seen_at. Examples are the first ones; per task only as
    many are kept as are shown.
    """
    keyed = discoveries.withColumn("pattern_key", T.pattern_key(F.col("type"), F.col("link_type"), F.col("file")))
    grouped = keyed.groupBy("pattern_key").agg(
        F.count("*").alias("n"), F.min("seen_at").alias("first_seen"),
        F.slice(F.sort_array(F.collect_list(F.struct("seen_at", "discovery_id"))), 1, max_examples).alias("e")
    )
    return grouped.where(F.col("n") >= threshold).select(
        "pattern_key", "n", "first_seen", confidence(F.col("n")).alias("confidence"), F.transform("e", lambda e: e["discovery_id"]).alias("examples")
    )


def validate(patterns: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Patterns with confidence revised by ``outcomes`` (pattern_key, success)."""
    seen = outcomes.groupBy("pattern_key").agg(F.count_if("success").alias("good"), F.count_if(~F.col("success")).alias("failed"))
    total = F.col("good") + F.col("failed")
    penalty = F.when(F.col("failed") > 5, F.least((F.col("failed") - 5) * 0.02, F.lit(0.2))).otherwise(0.0)
    revised = F.col("confidence") * (0.7 + 0.4 * F.try_divide(F.col("good"), total) - penalty)
    bounded = F.least(F.greatest(revised, F.lit(0.1)), F.lit(0.95))
    return patterns.join(seen, "pattern_key", "left").withColumn(
        "confidence", F.when(total > 0, bounded).otherwise(F.col("confidence"))
    ).drop("good", "failed")


def recognise(discoveries: DataFrame, known: DataFrame, threshold: int = vocab.PATTERN_THRESHOLD) -> DataFrame:
    """Patterns that no experience in ``known`` (context) describes yet."""
    named = known.select(F.regexp_extract("context", "Pattern '([^']*)'", 1).alias("pattern_key")).where("pattern_key <> ''").distinct()
    return detect(discoveries, threshold).join(named, "pattern_key", "left_anti")
