"""Stores as objects over a catalog: experiences, the knowledge graph, plain graphs, the hive and federations.

Each method loads tables, applies operators and, where it changes something, appends rows or replaces the
agent's partition. Reads return DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import text as T
from .operators import experiences, federation, graphstore, hierarchical
from .plans.lineage import materialise
from .sources import exchange
from .sources.catalog import Catalog


def _frame(spark: SparkSession, rows: DataFrame | Sequence[Mapping], schema: str, owner: Mapping[str, str]) -> DataFrame:
    """``rows`` in the layout of a table; what they lack is null, and ``owner`` columns are set."""
    layout = spark.createDataFrame([], schema)
    if not isinstance(rows, DataFrame):
        names = list(dict.fromkeys(k for r in rows for k in r))
        fields = ", ".join(f"{n} {layout.schema[n].dataType.simpleString()}" for n in names)
        rows = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], fields)
    return layout.unionByName(rows, allowMissingColumns=True).withColumns({k: F.lit(v) for k, v in owner.items()})


class ExperienceStore:
    """One agent's experiences: validated on entry, bounded by age, number and the catalog's quota."""

    def __init__(self, catalog: Catalog):
        if catalog.agent is None:
            raise ValueError("experiences need a catalog of one agent")
        self.catalog, self.spark = catalog, catalog.spark

    def _all(self) -> DataFrame:
        return self.catalog.load("experiences")

    def add(self, rows: DataFrame | Sequence[Mapping], now: Column) -> DataFrame:
        """Stores valid experiences under new ids; returns the rejected ones as ``(experience_id, error)``."""
        new = _frame(self.spark, rows, schemas.EXPERIENCES, {"agent_name": self.catalog.agent})
        new = new.withColumns({"timestamp": F.coalesce("timestamp", now), "compressed": F.coalesce("compressed", F.lit(False))})
        new = new.withColumn("experience_id", F.coalesce("experience_id", T.experience_id(F.col("context"), F.col("outcome"), F.col("timestamp"))))
        good, rejected = experiences.store(self._all(), materialise(new))
        good, rejected = materialise(good), materialise(rejected)
        self.catalog.save("experiences", good)
        return rejected

    def retrieve_experiences(self, limit: int | None = None, kind: str | None = None, min_confidence: float = 0.0) -> DataFrame:
        return experiences.retrieve(self._all(), limit, kind, min_confidence)

    def search(self, query: str, kind: str | None = None, min_confidence: float = 0.0, limit: int = 10, stemmed: bool = False) -> DataFrame:
        find = experiences.search_stemmed if stemmed else experiences.search_contains
        return find(self._all(), query, kind, min_confidence, limit)

    def retrieve_relevant(self, query: str, now: Column, top_k: int = 10, min_similarity: float = 0.0) -> DataFrame:
        return experiences.retrieve_relevant(self._all(), query, now, top_k, min_similarity)

    def cleanup(self, now: Column, auto_compress: bool = True, max_age_days: int | None = None, max_experiences: int | None = None) -> int:
        """Marks old experiences as compressed, deletes those past an age and all but the newest; how many are gone."""
        before = self._all()
        kept = cleaned(before, now, auto_compress, max_age_days, max_experiences)
        n = before.count()
        self.catalog.replace("experiences", materialise(kept.select(*before.columns)))
        return n - self._all().count()

    def get_statistics(self) -> DataFrame:
        return experiences.statistics(self._all())


def cleaned(
    rows: DataFrame, now: Column, auto_compress: bool = True, max_age_days: int | None = None, max_experiences: int | None = None
) -> DataFrame:
    """What :meth:`ExperienceStore.cleanup` leaves of ``rows``: compression, then age, then number."""
    kept = rows
    if auto_compress or max_age_days is not None:
        aged = experiences.compress_and_expire(rows, now, max_age_days=max_age_days)
        kept = aged if auto_compress else aged.drop("compressed").join(
            rows.select("experience_id", "compressed"), "experience_id"
        ).select(*rows.columns)
    return kept if max_experiences is None else experiences.trim(kept, max_experiences)


class KnowledgeMemory:
    """One agent's knowledge graph: facts, episodes and the edges that storing derives."""

    def __init__(self, catalog: Catalog):
        if catalog.agent is None:
            raise ValueError("a knowledge graph needs a catalog of one agent")
        self.catalog, self.agent, self.spark = catalog, catalog.agent, catalog.spark

    def facts(self) -> DataFrame:
        return self.catalog.load("semantic")

    def episodes(self) -> DataFrame:
        return self.catalog.load("episodic")

    def edges(self) -> DataFrame:
        weight = F.col("properties")["weight"].try_cast("double")
        return self.catalog.load("edges").select(
            "source_id", "target_id", "edge_type", weight.alias("weight"), F.col("properties")["reason"].alias("reason")
        )

    def store_episode(self, rows: DataFrame | Sequence[Mapping], now: Column) -> None:
        new = _frame(self.spark, rows, schemas.EPISODIC, {"agent_id": self.agent})
        self.catalog.save(
            "episodic", new.withColumns({"created_at": F.coalesce("created_at", now), "compressed": F.lit(False), "distilled": F.lit(False)})
        )

    def store_knowledge(self, rows: DataFrame | Sequence[Mapping], now: Column) -> DataFrame:
        """Stores facts, derives and stores their edges, and returns the edges."""
        new = _frame(self.spark, rows, schemas.SEMANTIC, {"agent_id": self.agent})
        new = new.withColumns({"created_at": F.coalesce("created_at", now), "archived": F.lit(False), "usage_count": F.lit(0).cast("bigint")})
        made, edges = hierarchical.store_knowledge(self.facts(), materialise(new), self.episodes())
        layout = self.facts().columns
        made, edges = materialise(made.select(*layout)), materialise(edges)
        self.catalog.save("semantic", made)
        self._save_edges(edges)
        return edges

    def _save_edges(self, edges: DataFrame) -> None:
        own = {
            "edge_id": F.concat_ws("->", "source_id", "edge_type", "target_id"), "agent_id": F.lit(self.agent), "graph_origin": F.lit("local"),
            "properties": F.create_map(F.lit("weight"), F.col("weight").cast("string"), F.lit("reason"), F.col("reason")),
        }
        self.catalog.save("edges", edges.withColumns(own).select(*self.catalog.load("edges").columns))

    def get_all_knowledge(self, limit: int = 50, category: str | None = None) -> DataFrame:
        return hierarchical.all_knowledge(self.facts(), limit, category)

    def search_by_concept(self, words: list[str], limit: int = 10) -> DataFrame:
        return hierarchical.search_by_concept(self.facts(), words, limit)

    def retrieve_by_entity(self, entity: str, limit: int = 20) -> DataFrame:
        return hierarchical.retrieve_by_entity(self.facts(), entity, limit)

    def execute_aggregation(self, kind: str, contains: str | None = None, limit: int = 10) -> DataFrame:
        return hierarchical.aggregation(self.facts(), kind, contains, limit)

    def retrieve_subgraph(self, query: str, max_depth: int = 2, max_nodes: int = 20) -> tuple[DataFrame, DataFrame]:
        return hierarchical.retrieve_subgraph(self.facts(), self.edges(), self.episodes(), query, max_depth, max_nodes)

    def to_llm_context(self, query: str, chronological: bool = False) -> DataFrame:
        nodes, inside = self.retrieve_subgraph(query)
        return hierarchical.to_llm_context(nodes, inside.withColumn("edge_type", F.lit("SIMILAR_TO")), query, chronological)

    def get_statistics(self) -> DataFrame:
        return hierarchical.statistics(self.facts(), self.episodes(), self.edges())

    def _sections(self) -> dict[str, DataFrame]:
        edges = self.edges()
        of = lambda kind: edges.where(F.col("edge_type") == kind)
        kinds = ("SIMILAR_TO", "DERIVES_FROM", "SUPERSEDES")
        return {
            "semantic_nodes": self.facts(), "episodic_nodes": self.episodes(),
            **{name: of(kind) for name, kind in zip(exchange.EDGE_SECTIONS, kinds, strict=True)}
        }

    def export_to_json(self, path: str) -> DataFrame:
        return exchange.export_json(self._sections(), path)

    def import_from_json(self, path: str, merge: bool = False) -> DataFrame:
        """Puts the file in place of this agent's knowledge, or adds to it; ``(section, imported, skipped, errors)``."""
        after, stats = exchange.import_json(self.spark, path, self._sections(), merge)
        after, stats = {k: materialise(df) for k, df in after.items()}, materialise(stats)
        for table, name in (("semantic", "semantic_nodes"), ("episodic", "episodic_nodes")):
            self.catalog.replace(table, after[name].withColumn("agent_id", F.lit(self.agent)))
        kept = self.catalog.load("edges").where(~F.col("edge_type").isin("SIMILAR_TO", "DERIVES_FROM", "SUPERSEDES"))
        self.catalog.replace("edges", materialise(kept))
        for name in exchange.EDGE_SECTIONS:
            self._save_edges(after[name])
        return stats


class GraphStore:
    """Nodes and edges of one tenant, or of all."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark

    def nodes(self) -> DataFrame:
        return self.catalog.load("nodes")

    def edges(self) -> DataFrame:
        return self.catalog.load("edges")

    def _put(self, table: str, rows: DataFrame, owner: Mapping[str, str]) -> None:
        schema = schemas.TABLES[table]
        self.catalog.replace(table, materialise(_frame(self.spark, rows, schema, owner)))

    def _owner(self) -> dict[str, str]:
        return {} if self.catalog.agent is None else {"agent_id": self.catalog.agent}

    def add_nodes(self, rows: DataFrame | Sequence[Mapping]) -> None:
        new = _frame(self.spark, rows, schemas.NODES, {})
        self._put("nodes", graphstore.upsert_nodes(self.nodes(), new.withColumn("graph_origin", F.coalesce("graph_origin", F.lit("local")))), {})

    def update_nodes(self, changes: DataFrame | Sequence[Mapping]) -> None:
        """Overlays ``properties`` on those of known nodes."""
        named = _frame(self.spark, changes, schemas.NODES, {}).select("node_id", F.col("properties").alias("set_properties"))
        self._put("nodes", graphstore.update_nodes(self.nodes(), named), {})

    def delete_nodes(self, ids: Sequence[str]) -> None:
        """Nodes and the edges at them."""
        wanted = self.spark.createDataFrame([(i,) for i in ids], "node_id string")
        nodes, edges = graphstore.delete_nodes(self.nodes(), self.edges(), wanted)
        nodes, edges = materialise(nodes), materialise(edges)
        self._put("nodes", nodes, {})
        self._put("edges", edges, self._owner())

    def get_node(self, node_id: str) -> DataFrame:
        return graphstore.get_node(self.nodes(), node_id)

    def query_nodes(self, node_type: str, filters: Mapping[str, str] | None = None, limit: int = 50) -> DataFrame:
        return graphstore.query_nodes(self.nodes(), node_type, filters, limit)

    def count_nodes(self, node_type: str | None = None, filters: Mapping[str, str] | None = None) -> DataFrame:
        return graphstore.count_nodes(self.nodes(), node_type, filters)

    def search_nodes(self, node_type: str, fields: Sequence[str], query: str, filters: Mapping[str, str] | None = None, limit: int = 10) -> DataFrame:
        return graphstore.search_nodes(self.nodes(), node_type, fields, query, filters, limit)

    def add_edges(self, rows: DataFrame | Sequence[Mapping]) -> DataFrame:
        """Appends edges whose ends exist; returns the others."""
        new = _frame(self.spark, rows, schemas.EDGES, self._owner())
        made = F.concat_ws("->", "source_id", "edge_type", "target_id")
        new = new.withColumns({"edge_id": F.coalesce("edge_id", made), "graph_origin": F.coalesce("graph_origin", F.lit("local"))})
        after, rejected = graphstore.add_edges(self.nodes(), self.edges(), new)
        after, rejected = materialise(after), materialise(rejected)
        self._put("edges", after, self._owner())
        return rejected

    def delete_edges(self, keys: DataFrame) -> None:
        self._put("edges", graphstore.delete_edges(self.edges(), keys), self._owner())

    def _starts(self, node_ids: Sequence[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in node_ids], "node_id string")

    def query_neighbors(self, node_id: str, edge_type: str | None = None, direction: str = "outgoing", limit: int = 50) -> DataFrame:
        return graphstore.query_neighbors(self.nodes(), self.edges(), self._starts([node_id]), edge_type, direction, limit)

    def traverse(self, node_id: str, edge_types: Sequence[str] | None = None, max_hops: int = 3, direction: str = "outgoing") -> DataFrame:
        return graphstore.traverse(self.nodes(), self.edges(), self._starts([node_id]), edge_types, max_hops, direction)


class HiveStore:
    """Agents that share a graph: who they are, how far they are trusted, what each asserted."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark

    def agents(self) -> DataFrame:
        return Catalog(self.spark, self.catalog.root, None, self.catalog.max_memory_mb, self.catalog.backend).load("hive_agents")

    def _put(self, rows: DataFrame) -> None:
        self.catalog.save("hive_agents", materialise(_frame(self.spark, rows, schemas.HIVE_AGENTS, {})), mode="overwrite")

    def register_agents(self, rows: DataFrame | Sequence[Mapping]) -> None:
        self._put(federation.register_agents(self.agents(), _frame(self.spark, rows, schemas.HIVE_AGENTS, {})))

    def update_trust(self, changes: Sequence[tuple[str, float]]) -> None:
        self._put(
            federation.update_trust(
                self.agents(), self.spark.createDataFrame([(a, t, k) for k, (a, t) in enumerate(changes)], "agent_id string, trust double, at int")
            )
        )

    def get_agent_trust(self, agent_ids: Sequence[str]) -> DataFrame:
        return federation.agent_trust(self.agents(), self.spark.createDataFrame([(i,) for i in agent_ids], "agent_id string"))

    def get_expert_agents(self, domain: str, limit: int | None = None) -> DataFrame:
        return federation.expert_agents(self.agents(), domain, limit)


class FederatedStore:
    """Several graph stores asked as one; nodes of equal content count once, local ones first."""

    def __init__(self, stores: Sequence[tuple[str, GraphStore]]):
        self.stores = list(stores)

    def nodes(self) -> DataFrame:
        return federation.merge([(name, s.nodes()) for name, s in self.stores])

    def query(self, node_type: str, fields: Sequence[str], query: str, confirmations: DataFrame, limit: int = 10) -> DataFrame:
        return federation.federated_query([(name, s.nodes()) for name, s in self.stores], node_type, fields, query, confirmations, limit)

    def query_neighbors(self, node_id: str, direction: str = "outgoing") -> DataFrame:
        starts = self.stores[0][1]._starts([node_id])
        return federation.federated_neighbors([(name, s.nodes(), s.edges()) for name, s in self.stores], starts, direction)
