"""What intents of the change log become: rows with ids that depend on the intent alone.

A row made from an intent twice is the same row, so an applier that dies between writing rows and entering
them in its ledger may write them again under the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, memory
from ..plans.lineage import materialise
from ..sources.catalog import Catalog

#: Payload layouts and id prefixes of the kinds that make rows.
ROWS = {
    "store_fact": ("sem_", "concept string, content string, confidence double, source_id string, tags array<string>, metadata string"),
    "upsert_fact": (
        "sem_", "concept string, content string, confidence double, source_id string, tags array<string>, metadata string, dedup_key string"
    ),
    "store_episode": ("epi_", "content string, source_label string, temporal_index bigint"),
    "store_prospective": ("pro_", "description string, trigger_condition string, action_on_trigger string, priority int"),
    "store_procedure": ("proc_", "name string, steps array<string>, prerequisites array<string>"),
}
#: Payload layouts of the kinds that change or link rows.
CHANGES = {
    "record_access": "node_id string, accessed_at timestamp",
    "link_fact_to_episodes": "fact_id string, episode_ids array<string>",
    "link_similar_facts": "fact_id_a string, fact_id_b string, similarity_score double",
}


def rows_of(intents: DataFrame, kind: str, now: Column) -> DataFrame:
    """The rows that intents of ``kind`` make: node_id, agent_id, the payload's fields, created_at."""
    prefix, layout = ROWS[kind]
    parsed = intents.where(F.col("kind") == kind).select("intent_id", "agent_name", F.from_json("payload", layout).alias("p"))
    return parsed.select(F.concat(F.lit(prefix), "intent_id").alias("node_id"), F.col("agent_name").alias("agent_id"), "p.*", now.alias("created_at"))


def changes_of(intents: DataFrame, kind: str) -> DataFrame:
    """The payloads of intents of ``kind``, with the intent and its agent."""
    return intents.where(F.col("kind") == kind).select(
        "intent_id", F.col("agent_name").alias("agent_id"), F.from_json("payload", CHANGES[kind]).alias("p")
    ).select("intent_id", "agent_id", "p.*")


def edges_of(intents: DataFrame) -> DataFrame:
    """``intent_id, source_id, target_id, edge_type, similarity_score`` of the linking intents."""
    derived = changes_of(intents, "link_fact_to_episodes").select(
        "intent_id", F.col("fact_id").alias("source_id"), F.explode("episode_ids").alias("target_id"), F.lit("DERIVES_FROM").alias("edge_type"), F.lit(None).cast("double").alias(
            "similarity_score"
        )
    )
    similar = changes_of(intents, "link_similar_facts").select(
        "intent_id", F.col("fact_id_a").alias("source_id"), F.col("fact_id_b").alias("target_id"), F.lit(
            "SIMILAR_TO"
        ).alias("edge_type"), "similarity_score"
    )
    return derived.unionAll(similar)


class Applier:
    """Applies intents of all agents to a catalog's tables; give :meth:`apply` to ``IntentLog.drain``.

    Rows that an earlier, unfinished run of the same batch wrote are recognised by their ids and left alone,
    so the batch may run again: appended rows by node_id, accesses by access_id, links by their ends.
    """

    def __init__(self, catalog: Catalog, now: Column | None = None):
        if catalog.agent is not None:
            raise ValueError("intents of all agents need a catalog of all")
        self.catalog, self.now = catalog, F.current_timestamp() if now is None else now

    def _append(self, table: str, rows: DataFrame, key: str = "node_id") -> None:
        known = self.catalog.load(table)
        whole = known.limit(0).unionByName(rows.select(*[c for c in known.columns if c in rows.columns]), allowMissingColumns=True)
        own = whole.select(F.col("agent_id").alias("agent")).distinct()
        old = known.join(own, F.col("agent_id") == F.col("agent"), "left_semi").select(key)
        self.catalog.save(table, materialise(whole.dropDuplicates([key]).join(old, key, "left_anti")))

    def apply(self, intents: DataFrame, batch: int) -> None:
        defaults = {"archived": F.lit(False), "usage_count": F.lit(0).cast("long")}
        fact = rows_of(intents, "store_fact", self.now)
        self._append("semantic", fact.withColumns(defaults | {"entity_name": T.entity_name(F.col("content"), F.col("concept"))}))
        named = fact.where("source_id is not null").select(
            F.col("node_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("DERIVES_FROM").alias("edge_type"), "agent_id"
        )
        self._append("episodic", rows_of(intents, "store_episode", self.now).withColumns({"compressed": F.lit(False), "distilled": F.lit(False)}))
        self._append("prospective", memory.store_prospective(rows_of(intents, "store_prospective", self.now)))
        self._procedures(rows_of(intents, "store_procedure", self.now))
        self._upserts(
            rows_of(intents, "upsert_fact", self.now).withColumns(
                defaults | {"importance": F.col("confidence"), "content_hash": T.content_hash(F.col("concept"), F.col("content"))}
            )
        )
        access = changes_of(intents, "record_access")
        self._append(
            "accesses", access.select(F.col("intent_id").alias("access_id"), "node_id", "agent_id", F.lit("fact").alias("kind"), "accessed_at"),
            "access_id"
        )
        self._links(named, intents)

    def _touched(self, table: str, rows: DataFrame) -> DataFrame:
        own = rows.select(F.col("agent_id").alias("agent")).distinct()
        return self.catalog.load(table).join(own, F.col("agent_id") == F.col("agent"), "left_semi")

    def _procedures(self, rows: DataFrame) -> None:
        if not rows.isEmpty():
            known = self._touched("procedural", rows)
            self.catalog.replace_agents("procedural", known.limit(0).unionByName(memory.store_procedures(known, rows), allowMissingColumns=True))

    def _upserts(self, rows: DataFrame) -> None:
        """By key where an intent has one, else by content; only the agents that are touched are rewritten."""
        if rows.isEmpty():
            return
        facts = self._touched("semantic", rows)
        fresh = materialise(facts.limit(0).unionByName(rows, allowMissingColumns=True).join(facts.select("node_id"), "node_id", "left_anti"))
        for mode, part in (("hash", fresh.where("dedup_key is null")), ("key", fresh.where("dedup_key is not null"))):
            if part.isEmpty():
                continue
            facts = self._touched("semantic", part)
            decided = materialise(dedup.upsert(facts, part, mode))
            after = materialise(dedup.apply_upserts(facts, part, decided))
            if mode == "key":
                key = ["agent_id", "dedup_key"]
                live = after.where("dedup_key is not null and not archived")
                newest = live.groupBy(*key).agg(F.max(F.struct("created_at", "node_id"))["node_id"].alias("new_id"))
                changes = live.join(newest, key).where("node_id <> new_id").select(
                    F.col("node_id").alias("old_id"), "new_id", F.lit("new content under the same key").alias("reason")
                )
                after, edges, _ = dedup.supersede(after, self.catalog.load("edges"), changes)
                owned = edges.join(after.select(F.col("node_id").alias("source_id"), "agent_id"), "source_id")
                self._save_links(owned.withColumn("properties", F.create_map(F.lit("reason"), "reason")))
            self.catalog.replace_agents("semantic", after.select(*facts.columns))

    def _links(self, named: DataFrame, intents: DataFrame) -> None:
        made = edges_of(intents).join(intents.select("intent_id", F.col("agent_name").alias("agent_id")), "intent_id")
        score = F.when(F.col("similarity_score").isNotNull(), F.create_map(F.lit("similarity_score"), F.col("similarity_score").cast("string")))
        own = made.select("source_id", "target_id", "edge_type", "agent_id", score.alias("properties"))
        self._save_links(named.withColumn("properties", F.lit(None).cast("map<string,string>")).unionByName(own))

    def _save_links(self, links: DataFrame) -> None:
        known = self.catalog.load("edges")
        key = ["source_id", "target_id", "edge_type"]
        new = links.dropDuplicates(key).join(known.select(*key), key, "left_anti")
        new = new.withColumns({"edge_id": F.concat_ws("->", "source_id", "edge_type", "target_id"), "graph_origin": F.lit("local")})
        self.catalog.save("edges", materialise(new.select(*known.columns)))
