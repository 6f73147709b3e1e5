"""Queries O1-O50: scans, sources, changes, searches, statistics of the memory tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import embedding
from ..functions import text as T
from ..operators import experiences, graphstore, hierarchical, memory
from ..sources import exchange
from ..sources.catalog import Catalog, is_agent_name, is_identifier
from ..stores import cleaned
from . import sql as S
from .lineage import shared_folder
from .registry import query
from .tables import NOW, Views

WORDS = "the deploy worthless river"


def at(moment: str = NOW) -> Column:
    return F.lit(moment).cast("timestamp")


def mid() -> Column:
    return at("2024-01-15 00:00:00")


def nodes_of(v: Views) -> DataFrame:
    n = v.nodes
    named = F.map_filter(F.create_map(F.lit("name"), "name", F.lit("balance"), "balance", F.lit("segment"), "segment"), lambda _, x: x.isNotNull())
    return n.select("node_id", "node_type", named.alias("properties"), "graph_origin")


def edges_of(v: Views) -> DataFrame:
    return v.edges.select(
        F.concat_ws("->", "source_id", "target_id").alias("edge_id"), "source_id", "target_id", "edge_type",
        F.create_map().cast("map<string,string>").alias("properties"), F.lit("local").alias("graph_origin")
    )


@query("o1_query_nodes", "SELECT node_id, name FROM nodes WHERE node_type = 'customer' AND segment = 'BUILDING' ORDER BY node_id LIMIT 50")
def _(v: Views) -> DataFrame:
    return graphstore.query_nodes(nodes_of(v), "customer", {"segment": "BUILDING"}).select("node_id", F.col("properties")["name"].alias("name"))


@query(
    "o2_query_nodes_ordered",
    """SELECT node_id, balance FROM nodes WHERE node_type = 'customer' ORDER BY coalesce(try_cast(CASE WHEN regexp_full_match(balance,
    '[+-]?[0-9]+') THEN balance END AS BIGINT), -9223372036854775808) DESC, node_id LIMIT 25"""
)
def _(v: Views) -> DataFrame:
    return graphstore.query_nodes_ordered(
        nodes_of(v), "customer", None, "balance", numeric=True, descending=True, limit=25
    ).select("node_id", F.col("properties")["balance"].alias("balance"))


@query("o3_get_node", "SELECT node_id, node_type FROM nodes WHERE node_id = 'N7'")
def _(v: Views) -> DataFrame:
    return graphstore.get_node(nodes_of(v), "N7").select("node_id", "node_type")


@query("o4_count_nodes", "SELECT count(*) AS n FROM nodes WHERE node_type = 'customer' AND segment = 'MACHINERY'")
def _(v: Views) -> DataFrame:
    return graphstore.count_nodes(nodes_of(v), "customer", {"segment": "MACHINERY"})


@query("o5_node_and_edge_counts", "SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges")
def _(v: Views) -> DataFrame:
    return nodes_of(v).agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n").unionAll(
        edges_of(v).agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n")
    )


@query(
    "o6_bulk_edges",
    """SELECT source_id, target_id FROM edges WHERE edge_type = 'LIVES_IN' AND source_id IN (SELECT node_id FROM nodes) AND target_id IN (SELECT node_id
    FROM nodes)"""
)
def _(v: Views) -> DataFrame:
    return graphstore.bulk_edges(nodes_of(v), edges_of(v), "LIVES_IN")


@query(
    "o7_retrieve_experiences",
    """SELECT experience_id, confidence FROM experiences WHERE experience_type = 'failure' AND confidence >= 0.4 ORDER BY timestamp DESC,
    experience_id LIMIT 100"""
)
def _(v: Views) -> DataFrame:
    return experiences.retrieve(v.experiences, 100, "failure", 0.4).select("experience_id", "confidence")


@query(
    "o8_store_experiences",
    """SELECT 'stored' AS outcome, count(*) AS n FROM experiences WHERE experience_type = 'pattern' UNION ALL SELECT 'duplicate id', count(*)
    FROM experiences WHERE experience_type <> 'pattern'"""
)
def _(v: Views) -> DataFrame:
    every = v.experiences
    good, rejected = experiences.store(every.where("experience_type <> 'pattern'"), every)
    return good.agg(F.count("*").alias("n")).select(F.lit("stored").alias("outcome"), "n").unionAll(
        rejected.groupBy(F.col("error").alias("outcome")).agg(F.count("*").alias("n"))
    )


@query("o9_all_facts", "SELECT node_id, confidence FROM facts ORDER BY confidence DESC, node_id LIMIT 200")
def _(v: Views) -> DataFrame:
    return memory.all_facts(v.facts, 200).select("node_id", "confidence")


@query(
    "o10_all_knowledge",
    "SELECT node_id, created_at FROM facts WHERE coalesce(metadata ->> '$.category', 'semantic') = 'fr' ORDER BY created_at DESC, node_id LIMIT 60"
)
def _(v: Views) -> DataFrame:
    return hierarchical.all_knowledge(v.facts, 60, "fr").select("node_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


_SECTIONS = """SELECT 'semantic_nodes' AS section, node_id AS key FROM facts UNION ALL SELECT 'episodic_nodes', node_id FROM episodes
    UNION ALL SELECT lower(edge_type) || '_edges', source_id || '>' || target_id FROM links"""


def _keys(sections: dict[str, DataFrame]) -> DataFrame:
    """``(section, key)`` of every row of every section."""
    out = None
    for name, df in sections.items():
        key = F.col("node_id") if "node_id" in df.columns else F.concat("source_id", F.lit(">"), "target_id")
        rows = df.select(F.lit(name).alias("section"), key.alias("key"))
        out = rows if out is None else out.unionAll(rows)
    return out


@query("o11_export_json", _SECTIONS)
def _(v: Views) -> DataFrame:
    path = f"{shared_folder(v.spark)}/export-{uuid.uuid4().hex}"
    sections = sections_of(v)
    exchange.export_json(sections, path)
    return _keys({name: v.spark.read.schema(df.schema).json(f"{path}/{name}") for name, df in sections.items()})


def sections_of(v: Views) -> dict[str, DataFrame]:
    edge = lambda t: v.links.where(F.col("edge_type") == t)
    return {
        "semantic_nodes": v.facts, "episodic_nodes": v.episodes, "similar_to_edges": edge("SIMILAR_TO"), "derives_from_edges": edge("DERIVES_FROM"),
        "supersedes_edges": edge("SUPERSEDES")
    }


@query("o12_import_json", f"""SELECT section, key FROM ({_SECTIONS}) WHERE section NOT LIKE '%_edges' UNION ALL SELECT lower(edge_type) || '_edges',
    source_id || '>' || target_id FROM links
    WHERE source_id IN (SELECT node_id FROM facts) AND target_id IN (SELECT node_id FROM facts UNION ALL SELECT node_id FROM episodes)""")
def _(v: Views) -> DataFrame:
    new = sections_of(v)
    current = {k: d.limit(0) for k, d in new.items()} | {"semantic_nodes": v.facts.where("concept = 'src1'")}
    return _keys(exchange.combine(new, current, merge=True)[0])


@query("o12_import_counts", """WITH f AS (SELECT node_id FROM facts), e AS (SELECT node_id FROM episodes), known AS (SELECT node_id FROM facts
    WHERE concept = 'src1')
    SELECT 'semantic_nodes' AS section, count(*) FILTER (node_id NOT IN (SELECT node_id FROM known)) AS imported,
    count(*) FILTER (node_id IN (SELECT node_id FROM known)) AS skipped, 0 AS errors FROM f
    UNION ALL SELECT 'episodic_nodes', count(*), 0, 0 FROM e
    UNION ALL SELECT lower(edge_type) || '_edges', count(*) FILTER (ok), 0, count(*) FILTER (NOT ok) FROM (SELECT edge_type,
    source_id IN (SELECT node_id FROM f) AND (target_id IN (SELECT node_id FROM f) OR target_id IN (SELECT node_id FROM e)) AS ok FROM links)
    GROUP BY edge_type""")
def _(v: Views) -> DataFrame:
    new = sections_of(v)
    current = {k: d.limit(0) for k, d in new.items()} | {"semantic_nodes": v.facts.where("concept = 'src1'")}
    return exchange.combine(new, current, merge=True)[1]


@query("o13_ensure_columns", "SELECT node_id, node_type, name, CASE WHEN node_type = 'customer' THEN segment END AS segment FROM nodes")
def _(v: Views) -> DataFrame:
    path = f"{shared_folder(v.spark)}/ensure-{uuid.uuid4().hex}"
    catalog = Catalog(v.spark, path)
    catalog.save("things", v.nodes.where("node_type <> 'customer'").select("node_id", "node_type", "name"))
    catalog.save("things", v.nodes.where("node_type = 'customer'").select("node_id", "node_type", "name", "segment"))
    return catalog.load("things").select("node_id", "node_type", "name", "segment")


@query("o16_add_nodes", "SELECT node_id, node_type, name FROM nodes UNION ALL SELECT 'P' || p_partkey, 'part', p_name FROM part")
def _(v: Views) -> DataFrame:
    named = F.create_map(F.lit("name"), "p_name").alias("properties")
    new = v.part.select(
        F.concat(F.lit("P"), "p_partkey").alias("node_id"), F.lit("part").alias("node_type"), named, F.lit("local").alias("graph_origin")
    )
    return graphstore.upsert_nodes(nodes_of(v), new.unionByName(new)).select("node_id", "node_type", F.col("properties")["name"].alias("name"))


@query("o17_update_nodes", "SELECT node_id, CASE WHEN node_type = 'nation' THEN 'renamed' ELSE name END AS name, segment FROM nodes")
def _(v: Views) -> DataFrame:
    nodes = nodes_of(v)
    changes = nodes.where("node_type = 'nation'").select("node_id", F.create_map(F.lit("name"), F.lit("renamed")).alias("set_properties"))
    return graphstore.update_nodes(nodes, changes).select(
        "node_id", F.col("properties")["name"].alias("name"), F.col("properties")["segment"].alias("segment")
    )


@query("o18_delete_nodes", """SELECT node_id AS key FROM nodes WHERE node_type <> 'nation'
    UNION ALL SELECT source_id || '>' || target_id FROM edges WHERE source_id[1] <> 'N' AND target_id[1] <> 'N'""")
def _(v: Views) -> DataFrame:
    nodes = nodes_of(v)
    kept, edges = graphstore.delete_nodes(nodes, edges_of(v), nodes.where("node_type = 'nation'"))
    return kept.select(F.col("node_id").alias("key")).unionAll(edges.select(F.concat("source_id", F.lit(">"), "target_id")))


@query(
    "o19_add_edges", "SELECT 'C' || o_custkey AS source_id, o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AS added FROM orders"
)
def _(v: Views) -> DataFrame:
    nodes = nodes_of(v).where("graph_origin = 'local'")
    none = F.create_map().cast("map<string,string>").alias("properties")
    new = v.orders.select(
        F.lit(None).cast("string").alias("edge_id"), F.concat(F.lit("C"), "o_custkey").alias("source_id"), F.lit("R1").alias("target_id"),
        F.lit("ORDERED").alias("edge_type"), none, F.lit("local").alias("graph_origin"),
    )
    edges, rejected = graphstore.add_edges(nodes, edges_of(v).limit(0), new)
    return edges.select("source_id", F.lit(True).alias("added")).unionAll(rejected.select("source_id", F.lit(False)))


@query("o20_delete_edges", "SELECT source_id, target_id, edge_type FROM edges WHERE edge_type <> 'PART_OF'")
def _(v: Views) -> DataFrame:
    edges = edges_of(v)
    return graphstore.delete_edges(edges, edges.where("edge_type = 'PART_OF'")).select("source_id", "target_id", "edge_type")


@query("o21_live_nodes", "SELECT count(*) AS n FROM nodes WHERE node_type <> 'region'")
def _(v: Views) -> DataFrame:
    marked = nodes_of(v).withColumn(
        "properties",
        F.when(
            F.col("node_type") == "region", F.map_concat("properties", F.create_map(F.lit("_deleted"), F.lit("true")))
        ).otherwise(F.col("properties"))
    )
    return graphstore.live(marked).agg(F.count("*").alias("n"))


@query(
    "o22_store_facts",
    """SELECT 'facts' AS what, count(*) AS n FROM facts WHERE confidence <= 0.9 AND trim(content) <> '' UNION ALL SELECT 'edges', count(*) FROM facts f
    WHERE confidence <= 0.9 AND trim(content) <> '' AND source_id IN (SELECT node_id FROM episodes) UNION ALL SELECT 'confidence out of range',
    count(*) FROM facts WHERE confidence > 0.9"""
)
def _(v: Views) -> DataFrame:
    new = v.facts.withColumn("confidence", F.when(F.col("confidence") > 0.9, float("nan")).otherwise(F.col("confidence")))
    good, edges, rejected = memory.store_facts(new, v.episodes, v.facts.select("node_id", F.col("source_id").alias("episode_id")))
    n = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return n(good, "facts").unionAll(n(edges, "edges")).unionAll(rejected.groupBy(F.col("error").alias("what")).agg(F.count("*").alias("n")))


@query(
    "o23_store_procedures",
    """SELECT name, coalesce(max(usage_count) FILTER (node_id <= 'q000100'), 0) AS usage_count, arg_max(steps[1], node_id) AS first_step FROM procedures
    GROUP BY name"""
)
def _(v: Views) -> DataFrame:
    every = v.procedures.withColumn("prerequisites", F.array().cast("array<string>"))
    known = every.where("node_id <= 'q000100'").groupBy("agent_id", "name").agg(
        F.min("node_id").alias("node_id"), F.max("usage_count").alias("usage_count"), F.max_by("steps", "node_id").alias("steps"),
        F.max_by("prerequisites", "node_id").alias("prerequisites")
    )
    return memory.store_procedures(known, every).select("name", "usage_count", F.get("steps", F.lit(0)).alias("first_step"))


@query("o24_store_episodes", "SELECT node_id, 100 + row_number() OVER (PARTITION BY agent_id ORDER BY node_id) AS temporal_index FROM episodes")
def _(v: Views) -> DataFrame:
    before = v.episodes.select("agent_id").distinct().withColumn("temporal_index", F.lit(100))
    return memory.store_episodes(before, v.episodes.withColumn("temporal_index", F.lit(None).cast("long"))).select("node_id", "temporal_index")


@query("o25_record_sensory", "SELECT node_id, 7 + row_number() OVER (PARTITION BY agent_id ORDER BY node_id) AS observation_order FROM sensory")
def _(v: Views) -> DataFrame:
    before = v.sensory.select("agent_id").distinct().withColumn("observation_order", F.lit(7))
    return memory.record_sensory(before, v.sensory, at()).select("node_id", "observation_order")


@query(
    "o26_working_slots",
    """SELECT node_id, task_id FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, task_id ORDER BY relevance DESC, created_at DESC, node_id) AS n
    FROM working) WHERE n <= 20"""
)
def _(v: Views) -> DataFrame:
    return memory.working_slots(v.working).select("node_id", "task_id")


@query("o27_clear_working", "SELECT count(*) FILTER (task_id = 'u7') AS n_cleared FROM working")
def _(v: Views) -> DataFrame:
    return memory.clear_working(v.working, "u7")[1]


@query(
    "o28_store_prospective",
    "SELECT CASE WHEN status = 'pending' THEN 'pending' ELSE 'resolved' END AS status, count(*) AS n FROM prospective GROUP BY status"
)
def _(v: Views) -> DataFrame:
    return memory.store_prospective(
        v.prospective.withColumn("status", F.when(F.col("status") == "pending", "").otherwise(F.col("status")))
    ).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "o29_resolve_prospective", "SELECT CASE WHEN priority > 5 THEN 'resolved' ELSE status END AS status, count(*) AS n FROM prospective GROUP BY ALL"
)
def _(v: Views) -> DataFrame:
    return memory.resolve_prospective(v.prospective, v.prospective.where("priority > 5")).groupBy("status").agg(F.count("*").alias("n"))


@query("o30_mark_distilled", "SELECT node_id FROM episodes WHERE distilled OR agent_id = 'agent1'")
def _(v: Views) -> DataFrame:
    return memory.mark_distilled(v.episodes, v.episodes, "agent1").where("distilled").select("node_id")


@query(
    "o31_record_access",
    """SELECT f.node_id, f.usage_count + count(l.target_id) AS usage_count FROM facts f LEFT JOIN links l ON l.target_id = f.node_id
    AND l.edge_type = 'SIMILAR_TO' GROUP BY f.node_id, f.usage_count"""
)
def _(v: Views) -> DataFrame:
    accesses = v.links.where("edge_type = 'SIMILAR_TO'").select(F.col("target_id").alias("node_id"), at().alias("accessed_at"))
    return memory.record_access(v.facts, accesses).select("node_id", "usage_count")


@query("o32_link_once", "SELECT source_id, target_id FROM links WHERE edge_type = 'SIMILAR_TO' AND weight >= 0.5")
def _(v: Views) -> DataFrame:
    similar = v.links.where("edge_type = 'SIMILAR_TO'")
    return memory.link_once(similar.where("weight < 0.5"), similar.unionAll(similar)).select("source_id", "target_id")


@query("o36_search_nodes", "SELECT node_id FROM nodes WHERE node_type = 'nation' AND contains(lower(name), 'nation_1') ORDER BY node_id LIMIT 10")
def _(v: Views) -> DataFrame:
    return graphstore.search_nodes(nodes_of(v), "nation", ["name"], "NATION_1").select("node_id")


@query(
    "o37_search_all_properties",
    """SELECT node_id FROM nodes WHERE contains(lower(coalesce(name, '')), '00001') OR contains(lower(coalesce(balance, '')),
    '00001') OR contains(lower(coalesce(segment, '')), '00001') ORDER BY node_id LIMIT 50"""
)
def _(v: Views) -> DataFrame:
    return graphstore.search_all_properties(nodes_of(v), "00001").select("node_id")


#: The stems of "users numbered 7"; of the words in the table none but these has them.
_STEMS = "['user', 'number', '7']"


@query("o38_search_stemmed", f"""SELECT experience_id FROM experiences
    WHERE list_has_all(string_split_regex(lower(context || ' ' || outcome || ' ' || experience_id), '[^a-z0-9]+'), {_STEMS})
    ORDER BY timestamp DESC, experience_id LIMIT 100""")
def _(v: Views) -> DataFrame:
    return experiences.search_stemmed(v.experiences, "users numbered 7", limit=100).select("experience_id")


@query(
    "o39_search_contains",
    """SELECT experience_id FROM experiences WHERE contains(lower(context), 'user number 12') OR contains(lower(outcome), 'user number 12')
    ORDER BY timestamp DESC, experience_id LIMIT 100"""
)
def _(v: Views) -> DataFrame:
    return experiences.search_contains(v.experiences, "User number 12", limit=100).select("experience_id")


@query(
    "o40_search_facts",
    f"""SELECT node_id, confidence FROM facts WHERE confidence >= 0.2 AND {S.any_word(('concept', 'content'), WORDS)} ORDER BY confidence DESC,
    node_id LIMIT 300"""
)
def _(v: Views) -> DataFrame:
    return memory.search_facts(v.facts, WORDS, 300, 0.2).select("node_id", "confidence")


@query(
    "o41_search_episodes",
    "SELECT node_id FROM episodes WHERE NOT compressed AND contains(lower(content), 'the th') ORDER BY temporal_index DESC, node_id LIMIT 100"
)
def _(v: Views) -> DataFrame:
    return memory.search_episodes(v.episodes, "The th", 100).select("node_id")


@query("o42_get_episodes", "SELECT node_id FROM episodes WHERE NOT compressed ORDER BY temporal_index DESC, node_id LIMIT 50")
def _(v: Views) -> DataFrame:
    return memory.get_episodes(v.episodes).select("node_id")


@query("o43_undistilled_episodes", "SELECT node_id FROM episodes WHERE NOT distilled ORDER BY temporal_index DESC, node_id LIMIT 75")
def _(v: Views) -> DataFrame:
    return memory.undistilled_episodes(v.episodes, 75).select("node_id")


@query(
    "o44_recent_sensory",
    "SELECT node_id FROM sensory WHERE expires_at > TIMESTAMP '2024-01-15 00:00:00' ORDER BY observation_order DESC, node_id LIMIT 100"
)
def _(v: Views) -> DataFrame:
    return memory.recent_sensory(v.sensory, mid(), 100).select("node_id")


@query("o45_prune_sensory", "SELECT count(*) FILTER (expires_at <= TIMESTAMP '2024-01-15 00:00:00') AS n_pruned FROM sensory")
def _(v: Views) -> DataFrame:
    return memory.prune_sensory(v.sensory, mid())[1]


@query("o46_get_working", "SELECT node_id, relevance FROM working WHERE task_id = 'u3' ORDER BY relevance DESC, node_id")
def _(v: Views) -> DataFrame:
    return memory.get_working(v.working, "u3").select("node_id", "relevance")


@query(
    "o47_recall_procedures",
    f"""SELECT node_id, usage_count + 1 AS usage_count FROM procedures
    WHERE {S.any_word(('name', chr(34) + 's' + chr(34)), 'widget small').replace(chr(34) + 's' + chr(34), 'array_to_string(steps, chr(32))')}
    ORDER BY procedures.usage_count DESC, node_id LIMIT 20"""
)
def _(v: Views) -> DataFrame:
    return memory.recall_procedures(v.procedures, "widget small", 20)[1]


@query("o48_prospective_by_trigger", "SELECT node_id, priority FROM prospective WHERE status = 'pending' ORDER BY priority DESC, node_id LIMIT 15")
def _(v: Views) -> DataFrame:
    return memory.all_prospective(v.prospective.where("status = 'pending'"), 15).select("node_id", "priority")


@query("o49_search_by_concept", """WITH h AS (SELECT node_id, confidence, i AS keyword_pos FROM facts, (VALUES (0, 'src1'), (1, 'worthless'), (3,
    'the')) k(i, w) WHERE contains(lower(concept), w) OR contains(lower(content), w)),
    t AS (SELECT *, row_number() OVER (PARTITION BY keyword_pos ORDER BY confidence DESC, node_id) AS n FROM h)
    SELECT node_id, min(keyword_pos) AS keyword_pos FROM t WHERE n <= 10 GROUP BY node_id""")
def _(v: Views) -> DataFrame:
    return hierarchical.search_by_concept(v.facts, ["src1", "Worthless", "of", "the"])


@query("o50_retrieve_by_entity", "SELECT node_id FROM facts WHERE contains(entity_name, 'the') ORDER BY confidence DESC, node_id LIMIT 20")
def _(v: Views) -> DataFrame:
    return hierarchical.retrieve_by_entity(v.facts, "The").select("node_id")


@query("o50_retrieve_by_mention", "SELECT node_id FROM facts WHERE contains(lower(content), 'worthless') ORDER BY confidence DESC, node_id LIMIT 20")
def _(v: Views) -> DataFrame:
    return hierarchical.retrieve_by_entity(v.facts.withColumn("entity_name", F.lit("")), "Worthless").select("node_id")


@query("o51_validation", """SELECT CASE WHEN trim(context) = '' THEN 'blank context' WHEN length(context) > 500 THEN 'context too long'
    WHEN confidence > 0.9 THEN 'confidence out of range' ELSE 'valid' END AS verdict, count(*) AS n
    FROM (SELECT content AS context, confidence FROM facts) GROUP BY ALL""")
def _(v: Views) -> DataFrame:
    confidence = F.when(F.col("confidence") > 0.9, 7.0).otherwise(F.col("confidence"))
    error = experiences.validation_error(F.col("content"), F.lit("seen"), confidence, F.lit("insight"))
    return v.facts.groupBy(F.coalesce(error, F.lit("valid")).alias("verdict")).agg(F.count("*").alias("n"))


@query("o61_compress_and_expire", """SELECT experience_id, compressed OR timestamp < TIMESTAMP '2024-01-20' - INTERVAL 9 DAY AS compressed
    FROM experiences WHERE timestamp >= TIMESTAMP '2024-01-20' - INTERVAL 15 DAY""")
def _(v: Views) -> DataFrame:
    return experiences.compress_and_expire(v.experiences, at("2024-01-20 00:00:00"), 9, 15).select("experience_id", "compressed")


@query(
    "o62_trim",
    """SELECT experience_id FROM experiences WHERE experience_type = 'pattern' AND confidence >= 0.8 UNION SELECT experience_id
    FROM (SELECT experience_id FROM experiences ORDER BY timestamp DESC, experience_id LIMIT 500)"""
)
def _(v: Views) -> DataFrame:
    return experiences.trim(v.experiences, 500).select("experience_id")


@query("o63_replay_working")
def _(v: Views) -> DataFrame:
    return memory.replay_working(v.working).select("node_id", "task_id")


@query(
    "o64_experience_statistics",
    """SELECT coalesce(experience_type, 'total') AS experience_type, count(*) AS n, count(*) FILTER (compressed) AS n_compressed FROM experiences
    GROUP BY ROLLUP (experience_type)"""
)
def _(v: Views) -> DataFrame:
    return experiences.statistics(v.experiences)


@query("o65_cognitive_statistics", """WITH c AS (SELECT 'sensory' AS memory_type, count(*) AS n FROM sensory UNION ALL SELECT 'working', count(*)
    FROM working UNION ALL SELECT 'episodic', count(*) FROM episodes UNION ALL SELECT 'semantic', count(*) FROM facts
    UNION ALL SELECT 'procedural', 0 UNION ALL SELECT 'prospective', count(*) FROM prospective) SELECT * FROM c UNION ALL SELECT 'total',
    CAST(sum(n) AS BIGINT) FROM c""")
def _(v: Views) -> DataFrame:
    return memory.statistics({"sensory": v.sensory, "working": v.working, "episodic": v.episodes, "semantic": v.facts, "prospective": v.prospective})


@query(
    "o66_hierarchical_statistics",
    """SELECT 'semantic_nodes' AS what, count(*) AS n FROM facts UNION ALL SELECT 'episodic_nodes', count(*) FROM episodes UNION ALL
    SELECT lower(edge_type) || '_edges', count(*) FROM links GROUP BY edge_type"""
)
def _(v: Views) -> DataFrame:
    return hierarchical.statistics(v.facts, v.episodes, v.links)


for _kind, _sql in {
    "count_total": "SELECT count(*) AS n FROM facts WHERE contains(lower(concept), 'src1')",
    "count_entities": "SELECT count(DISTINCT entity_name) AS n FROM facts WHERE entity_name <> ''",
    "list_entities": "SELECT DISTINCT entity_name FROM facts WHERE entity_name <> ''",
    "count_concepts": "SELECT count(DISTINCT concept) AS n FROM facts WHERE contains(lower(concept), 'src1')",
    "list_concepts": "SELECT DISTINCT concept FROM facts WHERE contains(lower(concept), 'src1')",
    "count_by_concept": "SELECT concept, count(*) AS n FROM facts WHERE contains(lower(concept), 'src1') GROUP BY concept",
    "avg_confidence": "SELECT round(coalesce(avg(confidence), 0), 6) AS avg_confidence FROM facts WHERE contains(lower(concept), 'src1')",
    "top_concepts": """SELECT concept, count(*) AS n FROM facts WHERE contains(lower(concept), 'src1') GROUP BY concept ORDER BY n DESC, concept LIMIT 5""",
    "by_category": """SELECT coalesce(metadata ->> '$.category', 'semantic') AS category, count(*) AS n FROM facts WHERE contains(lower(concept), 'src1')
    GROUP BY ALL""",
}.items():
    _number = {
        "count_total": 67, "count_entities": 68, "list_entities": 68, "count_concepts": 69, "list_concepts": 69, "count_by_concept": 70,
        "avg_confidence": 71, "top_concepts": 72, "by_category": 73
    }[_kind]

    @query(f"o{_number}_{_kind}", _sql)
    def _(v: Views, kind: str = _kind) -> DataFrame:
        found = hierarchical.aggregation(v.facts, kind, "SRC1", limit=5)
        return found.select(F.round("avg_confidence", 6).alias("avg_confidence")) if kind == "avg_confidence" else found


@query("o83_recover_counters", "SELECT agent_id, max(temporal_index) AS last FROM episodes GROUP BY agent_id")
def _(v: Views) -> DataFrame:
    return memory.recover_counters(v.episodes, "temporal_index")


@query("o78_consolidate_episodes", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY temporal_index, node_id) AS n FROM episodes
    WHERE NOT compressed)
    SELECT agent_id, sha256(string_agg(content, ' | ' ORDER BY n)) AS summary_hash, count(*) AS original_count FROM r WHERE n <= 10 GROUP BY agent_id
    HAVING count(*) = 10""")
def _(v: Views) -> DataFrame:
    return memory.consolidate_episodes(v.episodes).select("agent_id", F.sha2("summary", 256).alias("summary_hash"), "original_count")


@query("o113_check_triggers", f"""WITH p AS (SELECT node_id, priority, unnest({S.plain('trigger_condition')}) AS word FROM prospective
    WHERE status = 'pending'), c AS (SELECT node_id AS content_id, unnest({S.plain('content')}) AS word FROM facts)
    SELECT DISTINCT node_id, priority, content_id FROM p JOIN c USING (word)""")
def _(v: Views) -> DataFrame:
    return memory.check_triggers(v.prospective, v.facts.select(F.col("node_id").alias("content_id"), "content"))


@query("o113_check_triggers_substring", f"""WITH p AS (SELECT node_id, priority, unnest({S.plain('trigger_condition')}) AS word FROM prospective
    WHERE status = 'pending'), c AS (SELECT node_id AS content_id, lower(content) AS t FROM episodes)
    SELECT DISTINCT node_id, priority, content_id FROM p JOIN c ON contains(t, word)""")
def _(v: Views) -> DataFrame:
    return memory.check_triggers(v.prospective, v.episodes.select(F.col("node_id").alias("content_id"), "content"), mode="substring")


@query(
    "o114_attend_to_sensory",
    """SELECT 'epi_' || node_id AS node_id, '[' || modality || '] ' || raw_data || ' -- attended: loud' AS content FROM sensory
    WHERE expires_at > TIMESTAMP '2024-01-15 00:00:00' AND modality = 'error'"""
)
def _(v: Views) -> DataFrame:
    attended = v.sensory.where("modality = 'error'").select("node_id", F.lit("loud").alias("reason"))
    return memory.attend_to_sensory(v.sensory, attended, mid())[0].select("node_id", "content")


@query(
    "o8_experience_ids",
    """SELECT experience_id, 'exp_' || strftime(timestamp, '%Y%m%d_%H%M%S') || '_' || substr(sha256(context || outcome || strftime(timestamp,
    '%Y-%m-%dT%H:%M:%S.%f')), 1, 16) AS derived_id FROM experiences"""
)
def _(v: Views) -> DataFrame:
    return v.experiences.select("experience_id", T.experience_id(F.col("context"), F.col("outcome"), F.col("timestamp")).alias("derived_id"))


# -- stores, names and logs ------------------------------------------------------------------------


@query(
    "o14_backends", """SELECT experience_id, backend FROM experiences, (VALUES ('parquet'), ('view')) b(backend) WHERE experience_type = 'failure'"""
)
def _(v: Views) -> DataFrame:
    rows = v.experiences.where("experience_type = 'failure'").drop("compressed")
    out = None
    for backend in ("parquet", "view"):
        table = "experiences" if backend == "parquet" else f"experiences_{uuid.uuid4().hex}"
        catalog = Catalog(v.spark, f"{shared_folder(v.spark)}/store-{uuid.uuid4().hex}", backend=backend)
        catalog.save(table, rows)
        found = catalog.load(table).select("experience_id", F.lit(backend).alias("backend"))
        out = found if out is None else out.unionAll(found)
    return out


@query("o15_salvage", "SELECT node_id, label FROM (SELECT node_id, content AS label FROM episodes)")
def _(v: Views) -> DataFrame:
    root = f"{shared_folder(v.spark)}/salvage-{uuid.uuid4().hex}"
    broken, fresh = Catalog(v.spark, f"{root}/a", max_memory_mb=1 << 20), Catalog(v.spark, f"{root}/b", max_memory_mb=1 << 20)
    broken.save("episodic", v.episodes)
    v.spark.range(1).select(F.lit("no parquet").alias("value")).write.mode("append").text(f"{root}/a/episodic/agent_id=agent0")
    broken.salvage(fresh, ["episodic", "working"])
    return fresh.load("episodic").select("node_id", F.col("content").alias("label"))


@query("o34_cleanup", """WITH a AS (SELECT experience_id, experience_type, confidence, timestamp,
    compressed OR timestamp < TIMESTAMP '2024-02-05' - INTERVAL 30 DAY AS compressed
      FROM experiences WHERE timestamp >= TIMESTAMP '2024-02-05' - INTERVAL 33 DAY)
    SELECT experience_id, compressed FROM a WHERE (SELECT count(*) FROM a) <= 600 OR (experience_type = 'pattern' AND confidence >= 0.8)
      OR experience_id IN (SELECT experience_id FROM a ORDER BY timestamp DESC, experience_id LIMIT 600)""")
def _(v: Views) -> DataFrame:
    return cleaned(v.experiences, at("2024-02-05 00:00:00"), True, 33, 600).select("experience_id", "compressed")


@query(
    "o52_identifiers",
    """SELECT p_name AS name, regexp_full_match(p_name, '[A-Za-z_][A-Za-z0-9_]*') AS valid FROM part UNION ALL SELECT n_name, regexp_full_match(n_name,
    '[A-Za-z_][A-Za-z0-9_]*') FROM nation"""
)
def _(v: Views) -> DataFrame:
    names = v.part.select(F.col("p_name").alias("name")).unionAll(v.nation.select("n_name"))
    return names.withColumn("valid", is_identifier(F.col("name")))


@query(
    "o53_agent_names",
    """SELECT p_brand AS name, regexp_full_match(p_brand, '[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}') AS valid FROM part UNION ALL SELECT c_name,
    regexp_full_match(c_name, '[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}') FROM customer"""
)
def _(v: Views) -> DataFrame:
    names = v.part.select(F.col("p_brand").alias("name")).unionAll(v.customer.select("c_name"))
    return names.withColumn("valid", is_agent_name(F.col("name")))


def _lengths():
    """A model that anyone can check: characters and words of a text."""
    return lambda texts: [[float(len(t)), float(len(t.split(" ")))] for t in texts]


@query("o94_embed", "SELECT item_id, CAST(length(text) AS DOUBLE) AS chars, CAST(len(string_split(text, ' ')) AS DOUBLE) AS words FROM benchmark")
def _(v: Views) -> DataFrame:
    made = embedding.embed(v.benchmark.select("item_id", "text"), "text", _lengths, dimensions=2)
    return made.select("item_id", F.col("embedding")[0].cast("double").alias("chars"), F.col("embedding")[1].cast("double").alias("words"))
