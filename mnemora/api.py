"""One agent's memory behind method names: a thin layer over the catalog and the operators.

Reads return DataFrames. Writes append to the catalog's tables. Accesses and changes of status are
appended to logs, which reads fold into the rows; ``compact`` does so for good. Other changes of existing rows
replace this agent's partition, which is materialised first so that no table is read while it is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import dedup, graphstore, memory, recall, similarity
from .operators.recall import RecallOptions
from .plans.lineage import materialise
from .sources.catalog import Catalog


class AgentMemory:
    """Six kinds of memory of ``catalog.agent``. ``now`` is given to every operation that needs the time."""

    def __init__(self, catalog: Catalog):
        if catalog.agent is None:
            raise ValueError("an agent's memory needs a catalog of that agent")
        self.catalog, self.agent, self.spark = catalog, catalog.agent, catalog.spark

    def _rows(self, rows: DataFrame | Sequence[Mapping], table: str) -> DataFrame:
        """Rows in the table's layout, owned by this agent."""
        layout = self.catalog.load(table).limit(0)
        if not isinstance(rows, DataFrame):
            names = list(dict.fromkeys(k for r in rows for k in r))
            fields = ", ".join(f"{n} {layout.schema[n].dataType.simpleString()}" for n in names)
            rows = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], fields)
        return layout.unionByName(rows, allowMissingColumns=True).withColumn("agent_id", F.lit(self.agent))

    def _replace(self, table: str, rows: DataFrame) -> None:
        """This agent's part of a table, also where nothing of it is left; other agents' partitions stay."""
        self.catalog.replace(table, materialise(rows))

    def _note_accesses(self, nodes: DataFrame, kind: str, now: Column | None = None) -> None:
        """Appends one access of each of ``nodes`` (node_id)."""
        at = (F.lit(None) if now is None else now).cast("timestamp")
        rows = nodes.select(
            F.expr("uuid()").alias("access_id"), "node_id", F.lit(self.agent).alias("agent_id"), F.lit(kind).alias("kind"), at.alias("accessed_at")
        )
        self.catalog.save("accesses", materialise(rows))

    def _accesses(self, kind: str) -> DataFrame:
        return self.catalog.load("accesses").where(F.col("kind") == kind)

    def compact(self) -> None:
        """Folds the logs into their tables. A crash in between loses what the logs held rather than counting it twice."""
        folded = {"semantic": self.facts(), "procedural": self.procedures(), "prospective": self.prospective()}
        ready = {table: materialise(df.select(*self.catalog.load(table).columns)) for table, df in folded.items()}
        for log in ("accesses", "statuses"):
            self.catalog.replace(log, self.catalog.load(log).limit(0))
        for table, rows in ready.items():
            self.catalog.replace(table, rows)

    # sensory and working
    def record_sensory(self, rows: DataFrame | Sequence[Mapping], now: Column, ttl_seconds: int = 300) -> None:
        seen = self._rows(rows, "sensory").select("node_id", "agent_id", "modality", "raw_data")
        self.catalog.save("sensory", memory.record_sensory(self.catalog.load("sensory"), seen, now, ttl_seconds))

    def get_recent_sensory(self, now: Column, limit: int = 10) -> DataFrame:
        return memory.recent_sensory(self.catalog.load("sensory"), now, limit)

    def prune_expired_sensory(self, now: Column) -> int:
        kept, pruned = memory.prune_sensory(self.catalog.load("sensory"), now)
        n = pruned.first().n_pruned
        self._replace("sensory", kept)
        return n

    def push_working(self, rows: DataFrame | Sequence[Mapping]) -> None:
        self._replace("working", memory.replay_working(self.catalog.load("working").unionByName(self._rows(rows, "working"))))

    def attend_to_sensory(self, node_id: str, reason: str, now: Column) -> bool:
        """Makes an episode of an unexpired observation; False if there is none."""
        wanted = self.spark.createDataFrame([(node_id, reason)], "node_id string, reason string")
        last = self.catalog.load("episodic").agg(F.coalesce(F.max("temporal_index"), F.lit(0))).first()[0]
        episodes, edges = memory.attend_to_sensory(self.catalog.load("sensory"), wanted, now, last)
        episodes = materialise(episodes)
        if episodes.isEmpty():
            return False
        made = self._rows(episodes, "episodic").withColumns(
            {"compressed": F.lit(False), "distilled": F.lit(False), "created_at": F.coalesce("created_at", now)}
        )
        self.catalog.save("episodic", made)
        self._add_edges(edges)
        return True

    def clear_working(self, task_id: str) -> int:
        kept, cleared = memory.clear_working(self.catalog.load("working"), task_id)
        n = cleared.first().n_cleared
        self._replace("working", kept)
        return n

    def get_working(self, task_id: str) -> DataFrame:
        return memory.get_working(self.catalog.load("working"), task_id)

    # episodes
    def store_episodes(self, rows: DataFrame | Sequence[Mapping], now: Column) -> None:
        new = memory.store_episodes(
            self.catalog.load("episodic"), self._rows(rows, "episodic").select("node_id", "agent_id", "content", "source_label", "temporal_index")
        )
        self.catalog.save("episodic", new.withColumns({"compressed": F.lit(False), "distilled": F.lit(False), "created_at": now}))

    def get_episodes(self, limit: int = 50, include_compressed: bool = False) -> DataFrame:
        return memory.get_episodes(self.catalog.load("episodic"), limit, include_compressed)

    def search_episodes(self, query: str, limit: int = 10) -> DataFrame:
        return memory.search_episodes(self.catalog.load("episodic"), query, limit)

    def list_undistilled_episodes(self, limit: int = 50) -> DataFrame:
        return memory.undistilled_episodes(self.catalog.load("episodic"), limit)

    def mark_episode_distilled(self, node_id: str) -> bool:
        """True if there is such an episode; the mark is never taken back."""
        episodes = self.catalog.load("episodic")
        wanted = self.spark.createDataFrame([(node_id,)], "node_id string")
        known = not episodes.join(wanted, "node_id", "left_semi").isEmpty()
        if known:
            self._replace("episodic", memory.mark_distilled(episodes, wanted, self.agent).select(*episodes.columns))
        return known

    def consolidate_episodes(self, now: Column, batch: int = 10) -> DataFrame:
        episodes = self.catalog.load("episodic")
        made = materialise(memory.consolidate_episodes(episodes, batch))
        ids = F.concat(F.lit("con_"), F.substring(F.sha2(F.array_join("episode_ids", ","), 256), 1, 12))
        self.catalog.save("consolidated", made.select(ids.alias("node_id"), "agent_id", "summary", "original_count", now.alias("created_at")))
        self._replace("episodic", memory.compress_consolidated(episodes, made).select(*episodes.columns))
        return made

    # facts
    def store_facts(
        self, rows: DataFrame | Sequence[
            Mapping
        ], now: Column, sources: DataFrame | None = None, strict: bool = False, link_threshold: float | None = None
    ) -> DataFrame:
        """Stores valid facts with their provenance, and links them with similar ones on request; returns the rejected ones."""
        new = self._rows(rows, "semantic")
        new = new.withColumns(
            {
                "created_at": F.coalesce("created_at", now), "usage_count": F.coalesce("usage_count", F.lit(0)),
                "archived": F.coalesce("archived", F.lit(False))
            }
        )
        named = sources if sources is not None else new.where("source_id is not null").select("node_id", F.col("source_id").alias("episode_id"))
        good, edges, rejected = memory.store_facts(new, self.catalog.load("episodic"), named, strict)
        good = materialise(good.withColumn("entity_name", F.coalesce("entity_name", T.entity_name(F.col("content"), F.col("concept")))))
        rejected = materialise(rejected)
        old = self.catalog.load("semantic")
        if link_threshold is not None:  # new facts look for partners; old ones aren't compared among themselves
            similar = similarity.link_similar(old, self.catalog.load("edges"), link_threshold, new=good)
            similar = materialise(similar.withColumn("properties", F.create_map(F.lit("similarity_score"), F.col("similarity_score").cast("string"))))
        self.catalog.save("semantic", good)
        self._add_edges(edges)
        if link_threshold is not None:
            self._add_edges(similar)
        return rejected

    def _add_edges(self, edges: DataFrame) -> None:
        known = self.catalog.load("edges")
        new = memory.link_once(known, edges)
        own = [c for c in ("source_id", "target_id", "edge_type", "properties") if c in new.columns]
        ready = known.limit(0).unionByName(new.select(*own), allowMissingColumns=True)
        named = {"edge_id": F.concat_ws("->", "source_id", "edge_type", "target_id"), "agent_id": F.lit(self.agent)}
        self.catalog.save("edges", materialise(ready.withColumns(named)))

    def link_similar_facts(self, fact_id_a: str, fact_id_b: str, similarity_score: float) -> None:
        rows = [(a, b, "SIMILAR_TO", {"similarity_score": str(similarity_score)}) for a, b in ((fact_id_a, fact_id_b), (fact_id_b, fact_id_a))]
        self._add_edges(self.spark.createDataFrame(rows, "source_id string, target_id string, edge_type string, properties map<string,string>"))

    def link_fact_to_episodes(self, fact_id: str, episode_ids: Sequence[str]) -> None:
        self._add_edges(
            self.spark.createDataFrame([(fact_id, e, "DERIVES_FROM") for e in episode_ids], "source_id string, target_id string, edge_type string")
        )

    def facts(self) -> DataFrame:
        """This agent's facts, with the accesses noted so far."""
        stored = self.catalog.load("semantic")
        return memory.record_access(stored, self._accesses("fact")).select(*stored.columns)

    def record_access(self, node_id: str, now: Column) -> bool:
        """Notes a use of a fact; False if the agent has no such fact."""
        hit = materialise(self.catalog.load("semantic").where(F.col("node_id") == node_id).select("node_id"))
        if hit.isEmpty():
            return False
        self._note_accesses(hit, "fact", now)
        return True

    def get_all_facts(self, limit: int = 50) -> DataFrame:
        return memory.all_facts(self.facts(), limit)

    def search_facts(self, query: str, limit: int = 10, min_confidence: float = 0.0, embedding: Sequence[float] | None = None) -> DataFrame:
        """Facts by the query's ``embedding`` if it has one and it finds any, else by keyword, with the neighbours of what was found."""
        facts = self.facts()
        seeds = None
        if embedding is not None:
            near = materialise(recall.vector_search(facts, embedding, limit, min_confidence))
            seeds = None if near.isEmpty() else near.select("node_id", F.col("similarity").alias("by"))
        if seeds is None:
            seeds = memory.search_facts(facts, query, limit, min_confidence).select("node_id", F.col("confidence").alias("by"))
        ranked = seeds.withColumn(
            "rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("by"), "node_id")) - 1
        ).select("node_id", "rank")
        edges = self.catalog.load("edges").withColumn("similarity_score", F.col("properties")["similarity_score"].try_cast("double"))
        found = recall.expand(facts, materialise(ranked), edges, query, limit, min_confidence)
        return facts.join(F.broadcast(found), "node_id").orderBy(F.desc("score"), "node_id")  # no more than ``limit`` rows

    def recall_facts_ranked(self, query: str, now: Column, options: RecallOptions = RecallOptions(), record_access: bool = True) -> DataFrame:
        hits = materialise(recall.recall_facts(self.facts(), query, now, options, self.catalog.load("edges"), self.catalog.load("episodic")))
        if record_access:
            self._note_accesses(hits.select("node_id"), "fact", now)
        return hits

    def read_facts_ranked(self, query: str, now: Column, options: RecallOptions = RecallOptions()) -> DataFrame:
        """Ranked recall for readers: nothing is recorded, and no more rows than a reader may ask for."""
        return self.recall_facts_ranked(query, now, recall.read_only(options), record_access=False)

    def recall_episodes_ranked(self, query: str, now: Column, options: RecallOptions = RecallOptions()) -> DataFrame:
        return recall.recall_episodes(self.catalog.load("episodic"), query, now, options, self.catalog.load("edges"), self.facts())

    def upsert_facts(self, rows: DataFrame | Sequence[Mapping], now: Column, mode: str = "hash", threshold: float = 0.85) -> DataFrame:
        """Inserts, reuses or supersedes; returns what happened to every input."""
        facts = self.catalog.load("semantic")
        derived = {"created_at": F.coalesce("created_at", now), "importance": F.coalesce("importance", "confidence"), "archived": F.lit(False)}
        inputs = self._rows(rows, "semantic").withColumns(derived | {"content_hash": T.content_hash(F.col("concept"), F.col("content"))})
        decided = materialise(dedup.upsert(facts, inputs, mode, threshold))
        after = dedup.apply_upserts(facts, inputs, decided)
        if mode == "key":
            later = after.where("dedup_key is not null and not archived")
            newest = later.groupBy("dedup_key").agg(
                F.max(F.struct("created_at", "node_id")).alias("m")
            ).select("dedup_key", F.col("m.node_id").alias("new_id"))
            changes = later.join(newest, "dedup_key").where("node_id <> new_id")
            changes = changes.select(F.col("node_id").alias("old_id"), "new_id", F.lit("new content under the same key").alias("reason"))
            after, edges, _ = dedup.supersede(materialise(after), self.catalog.load("edges"), changes)
            self._add_edges(edges)
        self._replace("semantic", after.select(*facts.columns))
        return decided

    def supersede_fact(self, old_id: str, new_id: str, reason: str) -> None:
        facts = self.catalog.load("semantic")
        changes = self.spark.createDataFrame([(old_id, new_id, reason)], "old_id string, new_id string, reason string")
        after, edges, rejected = dedup.supersede(facts, self.catalog.load("edges"), changes)
        if rejected.count():
            raise ValueError(f"{old_id} can't be superseded by {new_id}")
        edges = materialise(edges.withColumn("properties", F.create_map(F.lit("reason"), "reason")))
        self._replace("semantic", after.select(*facts.columns))
        self._add_edges(edges)

    def find_duplicate_facts(self, by: str = "hash", limit: int | None = None) -> DataFrame:
        return dedup.find_duplicates(self.facts(), by, limit)

    def prune_semantic_memory(self, now: Column, policy: dedup.RetentionPolicy, dry_run: bool = False) -> DataFrame:
        """``(action, n)``; with ``dry_run`` nothing is written."""
        stored = self.catalog.load("semantic")
        actions = materialise(dedup.retention(self.facts(), graphstore.provenance(self.catalog.load("edges")), now, policy))
        if not dry_run:
            self._replace("semantic", dedup.apply_retention(stored, actions))
        return actions.groupBy("action").agg(F.count("*").alias("n"))

    def fact_provenance(self, node_id: str) -> DataFrame:
        return graphstore.provenance(self.catalog.load("edges")).where(F.col("node_id") == node_id)

    # procedures and intentions
    def store_procedures(self, rows: DataFrame | Sequence[Mapping]) -> None:
        known = self.catalog.load("procedural")
        self._replace(
            "procedural", known.limit(0).unionByName(memory.store_procedures(known, self._rows(rows, "procedural")), allowMissingColumns=True)
        )

    def procedures(self) -> DataFrame:
        """This agent's procedures, with the uses noted so far."""
        return memory.fold_uses(self.catalog.load("procedural"), self._accesses("procedure"))

    def recall_procedure(self, query: str, limit: int = 5) -> DataFrame:
        """Procedures with their uses so far; each counts as used once more from now on."""
        found = materialise(memory.recall_procedures(self.procedures(), query, limit)[0])
        self._note_accesses(found.select("node_id"), "procedure")
        return found

    def procedure_provenance(self, node_id: str) -> DataFrame:
        return graphstore.provenance(self.catalog.load("edges"), "PROCEDURE_DERIVES_FROM").where(F.col("node_id") == node_id)

    def link_procedure_to_episodes(self, node_id: str, episode_ids: Sequence[str]) -> None:
        self._add_edges(
            self.spark.createDataFrame(
                [(node_id, e, "PROCEDURE_DERIVES_FROM") for e in episode_ids], "source_id string, target_id string, edge_type string"
            )
        )

    def prospective(self) -> DataFrame:
        """This agent's intentions, with the statuses noted so far."""
        return memory.fold_statuses(self.catalog.load("prospective"), self.catalog.load("statuses"))

    def store_prospective(self, rows: DataFrame | Sequence[Mapping], now: Column) -> None:
        self.catalog.save(
            "prospective", memory.store_prospective(self._rows(rows, "prospective").withColumn("created_at", F.coalesce("created_at", now)))
        )

    def get_all_prospective(self, limit: int = 50) -> DataFrame:
        return memory.all_prospective(self.prospective(), limit)

    def get_prospective_by_trigger(self, trigger: str, limit: int = 50) -> DataFrame:
        return memory.prospective_by_trigger(self.prospective(), trigger, limit)

    def _note_status(self, nodes: DataFrame, status: str) -> None:
        self.catalog.save("statuses", materialise(nodes.select("node_id", F.lit(self.agent).alias("agent_id"), F.lit(status).alias("status"))))

    def check_triggers(self, content: str, mode: str = "word") -> DataFrame:
        """Intentions that ``content`` triggers, most urgent first; they are marked as triggered."""
        known = self.prospective()
        said = self.spark.range(1).select(F.lit("now").alias("content_id"), F.lit(content).alias("content"))
        hit = memory.check_triggers(known, said, mode).select("node_id")
        fired = materialise(known.join(hit, "node_id", "left_semi").orderBy(F.desc("priority"), "node_id"))
        self._note_status(fired, "triggered")
        return fired

    def resolve_prospective(self, node_id: str) -> None:
        self._note_status(self.catalog.load("prospective").where(F.col("node_id") == node_id), "resolved")

    def get_statistics(self) -> DataFrame:
        return memory.statistics({k: self.catalog.load(k) for k in ("sensory", "working", "episodic", "semantic", "procedural", "prospective")})
