"""The lifecycle of creative ideas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab


def parse_status(name: str) -> str:
    """``name`` if it is a status; anything else is an error, never a default."""
    if name not in vocab.TRANSITIONS:
        raise ValueError(f"unknown status: {name!r}")
    return name


def is_terminal(name: str) -> bool:
    return not vocab.TRANSITIONS[parse_status(name)]


def transitions(spark: SparkSession) -> DataFrame:
    """``(from_status, to_status)``: the legal moves."""
    return spark.createDataFrame([(a, b) for a, bs in vocab.TRANSITIONS.items() for b in bs], "from_status string, to_status string")


def judged(moves: DataFrame) -> DataFrame:
    """``moves`` (from_status, to_status, ...) with ``allowed`` and ``terminal``; unknown names are not allowed."""
    legal = F.create_map(*(x for a, bs in vocab.TRANSITIONS.items() for x in (F.lit(a), F.array(*map(F.lit, bs)).cast("array<string>"))))
    ends = [k for k, v in vocab.TRANSITIONS.items() if not v]
    return moves.withColumns(
        {
            "allowed": F.coalesce(F.array_contains(legal[F.col("from_status")], F.col("to_status")), F.lit(False)),
            "terminal": F.coalesce(F.col("to_status").isin(*ends), F.lit(False))
        }
    )
