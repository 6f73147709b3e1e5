"""Stores as objects: what is written survives a reopen, and agents are apart."""

from mnemora.sources.catalog import Catalog
from mnemora.stores import ExperienceStore, FederatedStore, GraphStore, HiveStore, KnowledgeMemory
from mnemora.streaming.applying import Applier
from mnemora.streaming.intent_log import IntentLog, offset
from pyspark.sql import functions as F


def now(day=1):
    return F.lit(f"2026-01-{day:02d} 00:00:00").cast("timestamp")


def test_experiences(spark, tmp_path):
    open_as = lambda agent: ExperienceStore(Catalog(spark, str(tmp_path / "e"), agent=agent))
    s, other = open_as("a1"), open_as("a2")
    row = lambda i, kind="success", conf=0.5: {"experience_id": f"e{i}", "experience_type": kind, "context": f"deploying number {i}", "outcome": "it worked", "confidence": conf}
    assert s.add([row(i) for i in range(5)], now(1)).count() == 0
    assert [r.error for r in s.add([row(7, conf=3.0)], now(1)).collect()] == ["confidence out of range"]
    s.add([row(10, "pattern", 0.9), row(11)], now(20))
    other.add([row(50)], now(1))
    assert open_as("a1").retrieve_experiences(2).first().experience_id == "e10"
    assert [r.experience_id for r in s.search("number 3").collect()] == ["e3"] and s.search("deployed", stemmed=True).count() == 7
    assert s.cleanup(now(25), max_age_days=10) == 5 and {r.experience_id for r in s.retrieve_experiences().collect()} == {"e10", "e11"}
    assert s.cleanup(now(25), max_experiences=1) == 1 and other.retrieve_experiences().count() == 1
    assert {r.experience_type: r.n for r in s.get_statistics().collect()}["total"] == 1
    assert s.add([{"experience_type": "insight", "context": "c", "outcome": "o", "confidence": 0.5}], now(26)).count() == 0
    assert s.retrieve_experiences(kind="insight").first().experience_id.startswith("exp_20260126_")


def test_knowledge_graph(spark, tmp_path):
    open_it = lambda where="k", agent="a1": KnowledgeMemory(Catalog(spark, str(tmp_path / where), agent=agent))
    k = open_it()
    k.store_episode([{"node_id": "ep1", "content": "read the meter", "source_label": "log"}], now(1))
    meta = lambda i: f'{{"temporal_index": {i}}}'
    k.store_knowledge([{"node_id": "f1", "concept": "meter reading", "content": "the meter shows 45 units", "source_id": "ep1", "metadata": meta(1), "tags": ["m"]}], now(1))
    edges = k.store_knowledge([{"node_id": "f2", "concept": "meter reading", "content": "the meter shows 72 units", "metadata": meta(2), "tags": ["m"]}], now(2))
    assert {(r.source_id, r.target_id, r.edge_type) for r in edges.collect()} == {("f2", "f1", "SUPERSEDES"), ("f1", "f2", "SIMILAR_TO")}
    k = open_it()
    nodes, inside = k.retrieve_subgraph("meter reading")
    assert {(r.node_id, r.source_label, r.superseded_by) for r in nodes.collect()} == {("f1", "log", "f2"), ("f2", None, None)} and inside.count() == 1
    assert {r.node_id for r in k.get_all_knowledge().collect()} == {"f1", "f2"} and "45 units" in k.to_llm_context("meter").first().context
    assert k.execute_aggregation("count_total").count() == 1
    k.export_to_json(str(tmp_path / "out"))
    fresh = open_it("k2")
    stats = {r.section: (r.imported, r.skipped, r.errors) for r in fresh.import_from_json(str(tmp_path / "out")).collect()}
    assert stats["semantic_nodes"] == (2, 0, 0) and stats["supersedes_edges"] == (1, 0, 0)
    again = {r.section: (r.imported, r.skipped, r.errors) for r in fresh.import_from_json(str(tmp_path / "out"), merge=True).collect()}
    assert again["semantic_nodes"] == (0, 2, 0) and fresh.facts().count() == 2 and fresh.edges().count() == 3
    assert open_it(agent="a2").facts().count() == 0


def test_graph_hive_and_federation(spark, tmp_path):
    g = GraphStore(Catalog(spark, str(tmp_path / "g")))
    node = lambda i, **p: {"node_id": i, "node_type": "t", "properties": p}
    g.add_nodes([node("a", name="Ann"), node("b", name="Bob"), node("c", name="Cyd")])
    lost = g.add_edges([{"source_id": "a", "target_id": "b", "edge_type": "KNOWS"}, {"source_id": "b", "target_id": "c", "edge_type": "KNOWS"}, {"source_id": "a", "target_id": "x", "edge_type": "KNOWS"}])
    assert [r.target_id for r in lost.collect()] == ["x"]
    g.update_nodes([node("a", age="7")])
    assert g.get_node("a").first().properties == {"name": "Ann", "age": "7"}
    assert {r.to_id for r in g.traverse("a", max_hops=2).collect()} == {"b", "c"} and g.query_neighbors("a").first().node_id == "b"
    g.delete_nodes(["b"])
    assert g.edges().count() == 0 and {r.node_id for r in g.query_nodes("t").collect()} == {"a", "c"}
    far = GraphStore(Catalog(spark, str(tmp_path / "h")))
    far.add_nodes([node("a", name="Ann", age="7"), node("z", name="Zoe")])
    both = FederatedStore([("local", g), ("far", far)])
    assert {(r.node_id, r.source) for r in both.nodes().collect()} == {("a", "local"), ("c", "local"), ("z", "far")}
    none = spark.createDataFrame([], "node_id string, confirmation_count long")
    assert [r.node_id for r in both.query("t", ["name"], "zoe", none).collect()] == ["z"]
    h = HiveStore(Catalog(spark, str(tmp_path / "hive")))
    h.register_agents([{"agent_id": "x", "domain": "Rivers", "trust": 0.2}, {"agent_id": "y", "domain": "rivers and towns", "trust": 0.4}])
    h.update_trust([("x", 0.9)])
    assert {r.agent_id: r.trust for r in h.get_agent_trust(["x", "q"]).collect()} == {"x": 0.9, "q": 0.0}
    assert [r.agent_id for r in h.get_expert_agents("RIVERS").collect()] == ["x", "y"]


def test_o107_intents_are_applied_once(spark, tmp_path):
    log, catalog = IntentLog(spark, str(tmp_path / "log")), Catalog(spark, str(tmp_path / "m"))
    rows = [
        ("i1", "store_fact", "a1", '{"concept": "c", "content": "d", "confidence": 0.5, "source_id": "epi_i2"}'), ("i2", "store_episode", "a1", '{"content": "e"}'),
        ("i3", "upsert_fact", "a1", '{"concept": "k", "content": "one", "confidence": 0.5, "dedup_key": "x"}'), ("i4", "record_access", "a1", '{"node_id": "sem_i1", "accessed_at": "2026-01-05T00:00:00Z"}'),
        ("i5", "link_similar_facts", "a1", '{"fact_id_a": "sem_i1", "fact_id_b": "q", "similarity_score": 0.7}'), ("i6", "store_procedure", "a2", '{"name": "n", "steps": ["s"]}'),
        ("i7", "store_prospective", "a2", '{"trigger_condition": "t", "priority": 1}'), ("i8", "link_fact_to_episodes", "a1", '{"fact_id": "sem_i1", "episode_ids": ["z"]}'),
    ]
    frame = lambda rs, first: spark.createDataFrame([(offset(0, first + n), i, k, a, 1, p) for n, (i, k, a, p) in enumerate(rs)], "offset string, intent_id string, kind string, agent_name string, epoch long, payload string")
    log.append(frame(rows, 0))
    applier = Applier(catalog, now(1))
    log.drain(applier.apply)
    applier.apply(frame(rows, 0), 0)  # as if the batch ran again before it was entered in the ledger
    log.append(frame([rows[0], ("i9", "upsert_fact", "a1", '{"concept": "k", "content": "two", "confidence": 0.5, "dedup_key": "x"}')], 20))
    log.drain(Applier(catalog, now(2)).apply, watermark=offset(0, 5))
    facts = {r.node_id: (r.agent_id, r.archived, r.superseded_by) for r in catalog.load("semantic").collect()}
    assert facts == {"sem_i1": ("a1", False, None), "sem_i3": ("a1", True, "sem_i9"), "sem_i9": ("a1", False, None)}
    assert catalog.load("episodic").count() == 1 and catalog.load("accesses").count() == 1 and catalog.load("procedural").count() == 1 and catalog.load("prospective").count() == 1
    assert {(r.source_id, r.target_id, r.edge_type) for r in catalog.load("edges").collect()} == {("sem_i1", "epi_i2", "DERIVES_FROM"), ("sem_i1", "q", "SIMILAR_TO"), ("sem_i1", "z", "DERIVES_FROM"), ("sem_i9", "sem_i3", "SUPERSEDES")}
    assert {r.intent_id for r in log.ledger().collect()} == {"i6", "i7", "i8", "i9"}  # pruned below the watermark, in one folder
    assert len(list((tmp_path / "log" / "ledger").iterdir())) <= 2
    assert [r.intent_id for r in log.read_next(offset(0, 6), 2).collect()] == ["i8", "i1"]


def test_o15_salvage(spark, tmp_path):
    whole, fresh = Catalog(spark, str(tmp_path / "a")), Catalog(spark, str(tmp_path / "b"))
    whole.save("working", spark.createDataFrame([("w1", "a1", "t"), ("w2", "a2", "t")], "node_id string, agent_id string, task_id string"))
    (tmp_path / "a" / "working" / "agent_id=a1" / "part-broken.parquet").write_bytes(b"no parquet at all")
    assert whole.salvage(fresh, ["working", "sensory"]) == {"working": 2, "sensory": None}
    assert {r.node_id for r in fresh.load("working").collect()} == {"w1", "w2"}
