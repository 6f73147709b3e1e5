"""Column layouts of the memory tables, as DDL strings."""

NODES = "node_id string, node_type string, properties map<string,string>, graph_origin string"
EDGES = "edge_id string, source_id string, target_id string, edge_type string, properties map<string,string>, graph_origin string, agent_id string"
SENSORY = "node_id string, agent_id string, modality string, raw_data string, observation_order bigint, expires_at timestamp, created_at timestamp"
WORKING = "node_id string, agent_id string, slot_type string, content string, relevance double, task_id string, created_at timestamp"
EPISODIC = "node_id string, agent_id string, content string, source_label string, temporal_index bigint, compressed boolean, distilled boolean, metadata string, created_at timestamp"
SEMANTIC = (
    "node_id string, agent_id string, concept string, content string, confidence double, source_id string, tags array<string>, metadata string, embedding array<float>, created_at timestamp, "
    "importance double, usage_count bigint, last_accessed_at timestamp, expires_at timestamp, archived boolean, superseded_by string, content_hash string, dedup_key string, entity_name string"
)
PROCEDURAL = "node_id string, agent_id string, name string, steps array<string>, prerequisites array<string>, usage_count bigint, created_at timestamp"
PROSPECTIVE = "node_id string, agent_id string, description string, trigger_condition string, action_on_trigger string, status string, priority int, created_at timestamp"
CONSOLIDATED = "node_id string, agent_id string, summary string, original_count bigint, created_at timestamp"
EXPERIENCES = "experience_id string, agent_name string, experience_type string, context string, outcome string, confidence double, timestamp timestamp, metadata string, tags array<string>, compressed boolean"
#: Append-only logs, folded into their tables when these are read.
ACCESSES = "access_id string, node_id string, agent_id string, kind string, accessed_at timestamp"
STATUSES = "node_id string, agent_id string, status string"
HIVE_AGENTS = "agent_id string, domain string, trust double, fact_count bigint, joined_at timestamp, status string"

TABLES = {
    "nodes": NODES, "edges": EDGES, "sensory": SENSORY, "working": WORKING, "episodic": EPISODIC, "semantic": SEMANTIC, "procedural": PROCEDURAL, "prospective": PROSPECTIVE,
    "accesses": ACCESSES, "statuses": STATUSES, "consolidated": CONSOLIDATED, "experiences": EXPERIENCES, "hive_agents": HIVE_AGENTS,
}
