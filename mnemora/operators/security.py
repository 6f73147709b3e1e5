"""Capabilities, scrubbing and checks around experiences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from . import experiences


class NotPermitted(PermissionError):
    """An agent asked for what its capabilities don't include."""


@dataclass(frozen=True)
class Capabilities:
    """What an agent may do; no allowed types means all types."""

    scope: str = "session_only"
    allowed_types: tuple[str, ...] = ()
    max_query_cost: int = 100
    can_access_patterns: bool = False
    memory_quota_mb: int = 100

    def __post_init__(self) -> None:
        if self.scope not in vocab.SCOPES:
            raise ValueError(f"unknown scope: {self.scope!r}")
        if unknown := set(self.allowed_types) - set(vocab.EXPERIENCE_TYPES):
            raise ValueError(f"unknown types: {sorted(unknown)}")
        if self.max_query_cost <= 0 or self.memory_quota_mb <= 0:
            raise ValueError("limits must be positive")

    def can_store(self, kind: str) -> bool:
        return not self.allowed_types or kind in self.allowed_types

    def can_retrieve(self, kind: str) -> bool:
        if not self.allowed_types:
            return True
        return kind in self.allowed_types and (kind != "pattern" or self.can_access_patterns)

    def can_access(self, scope: str) -> bool:
        return vocab.SCOPES.index(self.scope) >= vocab.SCOPES.index(scope)


def scrub_experiences(df: DataFrame) -> DataFrame:
    """Experiences without credentials; those that had any carry a tag."""
    found = T.has_credentials(F.col("context")) | T.has_credentials(F.col("outcome"))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    tagged = F.when(found & ~F.array_contains(tags, vocab.SCRUBBED_TAG), F.concat(tags, F.array(F.lit(vocab.SCRUBBED_TAG)))).otherwise(tags)
    return df.withColumns({"tags": tagged, "context": T.scrub(F.col("context")), "outcome": T.scrub(F.col("outcome"))})


def query_report(queries: DataFrame, max_cost: int) -> DataFrame:
    """``(sql, cost, within_cost, safe)`` of every query in ``queries`` (sql)."""
    return queries.select(
        "sql", T.query_cost(F.col("sql")).alias("cost"), (T.query_cost(F.col("sql")) <= max_cost).alias("within_cost"),
        T.safe_query(F.col("sql")).alias("safe")
    )


class SecureExperiences:
    """Experiences behind capabilities: what may not be stored or seen is refused or left out."""

    def __init__(self, df: DataFrame, capabilities: Capabilities):
        self.df, self.capabilities = df, capabilities

    def add(self, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``(rows to append, rejected)``: scrubbed, validated, of permitted types."""
        if not self.capabilities.can_access("cross_session_write") and self.capabilities.scope != "session_only":
            raise NotPermitted("this scope only reads")
        kinds = [k for k in vocab.EXPERIENCE_TYPES if self.capabilities.can_store(k)]
        allowed = new.where(F.col("experience_type").isin(*kinds))
        refused = new.where(
            ~F.coalesce(F.col("experience_type").isin(*kinds), F.lit(False))
        ).select("experience_id", F.lit("type not permitted").alias("error"))
        good, rejected = experiences.store(self.df, scrub_experiences(allowed))
        return good, rejected.unionByName(refused)

    def visible(self) -> DataFrame:
        return self.df.where(F.col("experience_type").isin(*[k for k in vocab.EXPERIENCE_TYPES if self.capabilities.can_retrieve(k)]))

    def search(self, query: str, kind: str | None = None, min_confidence: float = 0.0, limit: int = 10) -> DataFrame:
        if kind is not None and not self.capabilities.can_retrieve(kind):
            raise NotPermitted(f"type not permitted: {kind}")
        return experiences.search_contains(self.visible(), query, kind, min_confidence, limit)

    def validated(self, sql: str) -> str:
        """``sql`` if it is a safe query within the permitted cost, judged by the same expressions as a table of queries."""
        row = query_report(self.df.sparkSession.createDataFrame([(sql,)], "sql string"), self.capabilities.max_query_cost).first()
        if not row.safe:
            raise NotPermitted("not a safe query")
        if not row.within_cost:
            raise NotPermitted(f"query cost ({row.cost}) exceeds the limit ({self.capabilities.max_query_cost})")
        return sql
