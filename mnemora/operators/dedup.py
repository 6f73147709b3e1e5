"""Duplicate facts, supersession, upserts and retention."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import similarity


def _agent(df: DataFrame) -> Column:
    """The tenant; frames without one belong to none."""
    return (F.col("agent_id").cast("string") if "agent_id" in df.columns else F.lit(None).cast("string")).alias("agent_id")


def find_duplicates(facts: DataFrame, by: str = "hash", limit: int | None = None, threshold: float = 0.85) -> DataFrame:
    """``(agent_id, key, fact_ids, representative_id, n)``: groups of two and more live facts of one agent, oldest first.

    ``by``: ``hash`` (concept and content), ``key`` (the caller's dedup_key) or ``similarity`` (within
    one concept; a fact joins the oldest earlier fact that heads a group and is similar enough).
    Largest groups first, ties by key and agent. Columns of ``facts`` beyond those named are left alone, whatever
    their names; no facts give no groups.
    """
    kept = facts.where(~F.coalesce("archived", F.lit(False)))
    if by == "hash":
        key = T.content_hash(F.col("concept"), F.col("content"))
    elif by == "key":
        kept, key = kept.where(F.col("dedup_key").isNotNull()), F.col("dedup_key")
    elif by == "similarity":
        clusters = greedy_clusters(kept, threshold).select(F.col("node_id").alias("member"), F.col("key").alias("cluster"))
        kept, key = kept.join(clusters, F.col("node_id") == F.col("member")), F.col("cluster")
    else:
        raise ValueError(f"unknown way to group: {by!r}")
    keyed = kept.select(_agent(facts), key.alias("key"), F.struct("created_at", "node_id").alias("m"))
    groups = keyed.groupBy("agent_id", "key").agg(F.sort_array(F.collect_list("m")).alias("m"), F.count("*").alias("n")).where("n > 1")
    ids = F.transform("m", lambda m: m["node_id"])
    found = groups.select("agent_id", "key", ids.alias("fact_ids"), F.element_at("m", 1)["node_id"].alias("representative_id"), "n")
    return found if limit is None else found.orderBy(F.desc("n"), "key", "agent_id").limit(limit)


def greedy_clusters(facts: DataFrame, threshold: float) -> DataFrame:
    """``(node_id, key)``: the head of each fact's cluster within its agent and concept.

    Facts are visited in order of (created_at, node_id); only similar pairs, found through the inverted
    index, take part in the fold, which streams the pairs of an agent's concept in order and holds the ids taken so far.
    Facts with a true column ``head`` come first and head a cluster of their own in any case: among themselves
    they aren't compared.
    """
    heads = "head" in facts.columns
    head = F.col("head") if heads else F.lit(False)
    place = F.struct((~head).alias("later"), "created_at", "node_id")
    order = facts.select(_agent(facts), "node_id", place.alias("place"), "concept")
    pairs = similarity.similar_pairs(facts.where("head"), threshold, facts.where("not head")) if heads else similarity.similar_pairs(facts, threshold)
    end = lambda x: order.select(F.col("node_id").alias(x), F.struct("place", "concept", "agent_id").alias(f"{x}_at"))
    pairs = pairs.join(end("a"), "a").join(end("b"), "b").where(F.col("a_at.concept").eqNullSafe(F.col("b_at.concept")))
    first = F.col("a_at.place") < F.col("b_at.place")
    older = pairs.select(
        F.col("a_at.agent_id").alias("agent_id"), F.col("a_at.concept").alias("concept"), F.when(
            first, F.col("a")
        ).otherwise(F.col("b")).alias("old"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("new"), F.least(
            "a_at.place", "b_at.place"
        ).alias("told"), F.greatest("a_at.place", "b_at.place").alias("tnew"),
    )

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # pairs come by (agent, concept, old), so a head's pairs are complete when they come; what a head takes is no head itself
        taken: dict[str, str] = {}
        place: object = object()
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if (row.agent_id, row.concept) != place:
                    place, taken = (row.agent_id, row.concept), {}
                if row.old not in taken and row.new not in taken:
                    taken[row.new] = row.old
                    out.append((row.new, row.old))
            yield pd.DataFrame(out, columns=["node_id", "key"])

    group = ["agent_id", "concept"]
    sorted_pairs = older.repartition(*group).sortWithinPartitions(*group, "told", "tnew")
    joined = sorted_pairs.select(*group, "old", "new").mapInPandas(fold, "node_id string, key string")
    return facts.select("node_id").join(joined, "node_id", "left").select("node_id", F.coalesce("key", "node_id").alias("key"))


def supersede(facts: DataFrame, edges: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(facts, SUPERSEDES edges to append, rejected)`` for ``changes`` (old_id, new_id, reason).

    Old facts are archived and point to their successor. A fact can't supersede itself, and both must exist.
    """
    ids = facts.select("node_id").distinct()
    known = changes.join(
        ids.withColumnRenamed("node_id", "old_id"), "old_id", "left_semi"
    ).join(ids.withColumnRenamed("node_id", "new_id"), "new_id", "left_semi").where("old_id <> new_id")
    last = known.groupBy("old_id").agg(F.max("new_id").alias("new_id"), F.max_by("reason", "new_id").alias("reason"))
    after = facts.drop("superseded_by").join(
        facts.select("node_id", F.col("superseded_by").alias("before")).join(
            last.select(F.col("old_id").alias("node_id"), F.col("new_id").alias("successor")), "node_id", "left"
        ),
        "node_id"
    )
    after = after.withColumns(
        {"archived": F.coalesce("archived", F.lit(False)) | F.col("successor").isNotNull(), "superseded_by": F.coalesce("successor", "before")}
    ).select(*facts.columns)
    new_edges = last.select(F.col("new_id").alias("source_id"), F.col("old_id").alias("target_id"), F.lit("SUPERSEDES").alias("edge_type"), "reason")
    key = ["source_id", "target_id", "edge_type"]
    rejected = changes.join(last.select("old_id"), "old_id", "left_anti")
    return after, new_edges.join(edges.select(*key), key, "left_anti"), rejected


def upsert(facts: DataFrame, inputs: DataFrame, mode: str = "hash", threshold: float = 0.85) -> DataFrame:
    """One row per input: ``node_id, action, target_id`` with action inserted, reused, superseded or invalid.

    ``inputs``: node_id, agent_id, concept, content, confidence, tags, created_at[, dedup_key], in order of
    (created_at, node_id); ``facts`` hold the same columns. ``none`` inserts all. ``hash`` reuses the agent's live
    fact of equal concept and content. ``key`` reuses its live fact of the key if the content is equal and
    supersedes it if not. ``similarity`` reuses its oldest similar fact of the concept. Within a batch an
    input meets the inputs before it; agents never meet each other's facts. The first holder of a hash is
    found by an aggregation; runs of a key are a window over the key's rows.
    """
    bad = F.isnan("confidence") | F.col("confidence").isNull() | ~F.col("confidence").between(0.0, 1.0)

    def shape(df: DataFrame, old: bool) -> DataFrame:
        key = F.col("dedup_key") if "dedup_key" in df.columns else F.lit(None).cast("string")
        digest = T.content_hash(F.col("concept"), F.col("content"))
        return df.select(
            _agent(df), "node_id", "created_at", key.alias("dedup_key"), F.lit(old).alias("old"), (F.lit(False) if old else bad).alias("bad"),
            digest.alias("hash")
        )

    live = facts.where(~F.coalesce("archived", F.lit(False)))
    every = shape(live, True).unionAll(shape(inputs, False))
    order = [F.desc("old"), F.col("created_at"), F.col("node_id")]
    fresh = every.where("not old and not bad")
    if mode == "none":
        decided = fresh.select("node_id", F.lit("inserted").alias("action"), F.col("node_id").alias("target_id"))
    elif mode == "hash":
        good = every.where("not bad")
        first = good.groupBy("agent_id", "hash").agg(F.min(F.struct(~F.col("old"), "created_at", "node_id"))["node_id"].alias("target_id"))
        first = first.select(F.col("agent_id").alias("agent"), F.col("hash").alias("digest"), "target_id")
        decided = fresh.join(first, F.col("agent_id").eqNullSafe(F.col("agent")) & F.col("hash").eqNullSafe(F.col("digest")))
        decided = decided.select(
            "node_id", F.when(F.col("target_id") == F.col("node_id"), "inserted").otherwise("reused").alias("action"), "target_id"
        )
    elif mode == "key":
        line = Window.partitionBy("agent_id", "dedup_key").orderBy(*order)
        runs = every.where("not bad and dedup_key is not null").withColumn("before", F.lag("hash").over(line))
        changed = F.col("before").isNull() | (F.col("before") != F.col("hash"))
        holder = F.last(F.when(changed, F.col("node_id")), ignorenulls=True).over(line)
        runs = runs.withColumns({"changed": changed, "holder": holder})
        action = F.when(F.col("before").isNull(), "inserted").when(F.col("changed"), "superseded").otherwise("reused")
        decided = runs.where("not old").select(
            "node_id", action.alias("action"), F.when(F.col("changed"), F.col("node_id")).otherwise(F.col("holder")).alias("target_id")
        )
        decided = decided.unionAll(fresh.where("dedup_key is null").select("node_id", F.lit("inserted"), "node_id"))
    elif mode == "similarity":
        own = lambda df, head: df.select("node_id", "concept", "content", "tags", "created_at", _agent(df), F.lit(head).alias("head"))
        pool = own(live, True).unionAll(own(inputs.where(~bad), False))
        block = F.concat(F.coalesce("agent_id", F.lit("")), F.lit("\x1f"), F.coalesce("concept", F.lit("")))  # only facts of one concept are compared
        clusters = greedy_clusters(pool.withColumn("agent_id", block), threshold)
        decided = inputs.where(~bad).select("node_id").join(clusters, "node_id")
        decided = decided.select(
            "node_id", F.when(F.col("key") == F.col("node_id"), "inserted").otherwise("reused").alias("action"), F.col("key").alias("target_id")
        )
    else:
        raise ValueError(f"unknown mode: {mode!r}")
    return decided.unionAll(every.where("not old and bad").select("node_id", F.lit("invalid"), F.lit(None).cast("string")))


def apply_upserts(facts: DataFrame, inputs: DataFrame, decided: DataFrame) -> DataFrame:
    """The live facts afterwards: reuse counts a use and takes the last input's confidence, importance stays."""
    rows = inputs.join(decided, "node_id")
    inserted = rows.where(F.col("action").isin("inserted", "superseded")).select(*[c for c in facts.columns if c in inputs.columns])
    reused = rows.where("action = 'reused'").groupBy("target_id").agg(
        F.count("*").alias("uses"), F.max_by("confidence", F.struct("created_at", "node_id")).alias("new_confidence")
    )
    every = facts.unionByName(inserted, allowMissingColumns=True)
    joined = every.join(reused.withColumnRenamed("target_id", "node_id"), "node_id", "left")
    return joined.withColumns(
        {"usage_count": F.coalesce("usage_count", F.lit(0)) + F.coalesce("uses", F.lit(0)), "confidence": F.coalesce("new_confidence", "confidence")}
    ).select(*facts.columns)


@dataclass(frozen=True)
class RetentionPolicy:
    min_importance: float = 0.0
    max_per_concept: int | None = None
    ttl_seconds_by_concept: Mapping[str, int] = field(default_factory=dict)
    include_superseded: bool = False


def age_basis() -> Column:
    return F.coalesce("last_accessed_at", "created_at")


def retention(facts: DataFrame, derived: DataFrame, now: Column, policy: RetentionPolicy) -> DataFrame:
    """``(node_id, action)`` of every fact: keep, archive or delete. Nothing is changed.

    A candidate is unimportant, expired, past its concept's time to live, beyond the cap of its concept
    (live before archived, important first, newest first) or, on request, superseded. A live
    candidate is archived; an archived one is deleted unless it has provenance (``derived``: node_id) and
    is important enough.
    """
    archived, importance = F.coalesce("archived", F.lit(False)), F.col("importance")
    candidate = (importance < policy.min_importance) | F.coalesce(F.col("expires_at") <= now, F.lit(False))
    for concept, seconds in policy.ttl_seconds_by_concept.items():
        candidate = candidate | ((F.col("concept") == concept) & (now.cast("double") - age_basis().cast("double") >= seconds))
    ranked = facts
    if policy.max_per_concept is not None:
        order = Window.partitionBy("agent_id", "concept").orderBy(archived.cast("int"), F.desc("importance"), F.desc(age_basis()), "node_id")
        ranked = ranked.withColumn("__n", F.row_number().over(order))
        candidate = candidate | (F.col("__n") > policy.max_per_concept)
    if policy.include_superseded:
        candidate = candidate | F.col("superseded_by").isNotNull()
    held = derived.select("node_id").distinct().withColumn("__held", F.lit(True))
    judged = ranked.join(held, "node_id", "left").withColumn("__c", F.coalesce(candidate, F.lit(False)))
    protected = F.coalesce("__held", F.lit(False)) & (importance >= policy.min_importance)
    return judged.select(
        "node_id", F.when(~F.col("__c"), "keep").when(~archived, "archive").when(protected, "keep").otherwise("delete").alias("action")
    )


def apply_retention(facts: DataFrame, actions: DataFrame) -> DataFrame:
    judged = facts.join(actions, "node_id").where("action <> 'delete'")
    return judged.withColumn("archived", F.coalesce("archived", F.lit(False)) | (F.col("action") == "archive")).select(*facts.columns)
