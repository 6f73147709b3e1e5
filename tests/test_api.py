"""One agent's memory end to end: the six types survive a reopen, tenants are apart."""

import pytest
from mnemora.api import AgentMemory
from mnemora.functions import embedding
from mnemora.operators.dedup import RetentionPolicy
from mnemora.sources.catalog import Catalog
from mnemora.streaming import applying
from pyspark.sql import functions as F


def now(day=1):
    return F.lit(f"2026-01-{day:02d} 00:00:00").cast("timestamp")


def test_life_of_a_memory(spark, tmp_path):
    open_as = lambda agent: AgentMemory(Catalog(spark, str(tmp_path / "m"), agent=agent))
    m, other = open_as("a1"), open_as("a2")
    m.record_sensory([{"node_id": "s1", "modality": "text", "raw_data": "x"}, {"node_id": "s2", "modality": "text", "raw_data": "y"}], now(1))
    m.push_working([{"node_id": f"w{i}", "task_id": "t", "content": "c", "relevance": float(i)} for i in range(25)])
    m.store_episodes([{"node_id": f"e{i:02d}", "content": f"episode {i}", "source_label": "s"} for i in range(12)], now(1))
    rejected = m.store_facts([{"node_id": "f1", "concept": "Ada Lovelace", "content": "wrote the notes", "confidence": 0.9, "source_id": "e01", "tags": ["x"]}, {"node_id": "f2", "concept": "Ada Lovelace", "content": "wrote the notes twice", "confidence": 0.4, "tags": ["x"]}, {"node_id": "f3", "concept": "c", "content": "d", "confidence": 7.0}], now(1), link_threshold=0.6)
    assert [r.node_id for r in rejected.collect()] == ["f3"]
    other.store_facts([{"node_id": "g1", "concept": "Ada", "content": "of another agent", "confidence": 0.5}], now(1))
    m.store_procedures([{"node_id": "p1", "name": "deploy", "steps": ["build", "ship"]}])
    m.store_procedures([{"node_id": "p2", "name": "deploy", "steps": ["test", "build", "ship"]}])
    m.store_prospective([{"node_id": "i1", "trigger_condition": "deploy", "priority": 1}, {"node_id": "i2", "trigger_condition": "rest", "priority": 2}], now(1))
    m = open_as("a1")
    assert {r.memory_type: r.n for r in m.get_statistics().collect()} == {"sensory": 2, "working": 20, "episodic": 12, "semantic": 2, "procedural": 1, "prospective": 2, "total": 39}
    assert [r.episode_id for r in m.fact_provenance("f1").collect()] == ["e01"]
    hits = m.recall_facts_ranked("ada notes", now(2)).collect()
    assert [h.node_id for h in hits] == ["f1", "f2"] and any(r.startswith("graph ") for r in hits[0].reasons)
    assert {r.node_id: (r.usage_count, r.entity_name) for r in m.facts().collect()} == {"f1": (1, "ada lovelace"), "f2": (1, "ada lovelace")}
    assert [r.node_id for r in other.get_all_facts().collect()] == ["g1"]
    assert [r.original_count for r in m.consolidate_episodes(now(2)).collect()] == [10] and m.get_episodes().count() == 2
    assert [r.steps for r in m.recall_procedure("deploy").collect()] == [["test", "build", "ship"]] and m.recall_procedure("deploy").first().usage_count == 1
    assert [r.node_id for r in m.check_triggers("time to deploy").collect()] == ["i1"] and m.check_triggers("deploy").count() == 0
    assert m.prune_expired_sensory(now(2)) == 2 and m.catalog.load("sensory").count() == 0 and m.prune_expired_sensory(now(2)) == 0 and m.get_working("t").first().node_id == "w24"


def test_upserts_supersession_and_retention(spark, tmp_path):
    m = AgentMemory(Catalog(spark, str(tmp_path / "m"), agent="a1"))
    row = lambda i, content, key=None: {"node_id": i, "concept": "c", "content": content, "confidence": 0.5, "dedup_key": key}
    assert [r.action for r in m.upsert_facts([row("f1", "x", "k")], now(1), "key").collect()] == ["inserted"]
    assert [r.action for r in m.upsert_facts([row("f2", "x", "k")], now(2), "key").collect()] == ["reused"]
    assert [r.action for r in m.upsert_facts([row("f3", "y", "k")], now(3), "key").collect()] == ["superseded"]
    assert {(r.node_id, r.archived, r.superseded_by) for r in m.facts().collect()} == {("f1", True, "f3"), ("f3", False, None)}
    m.upsert_facts([row("f4", "z")], now(4))
    m.supersede_fact("f4", "f3", "better")
    with pytest.raises(ValueError):
        m.supersede_fact("f4", "f4", "self")
    assert {r.action: r.n for r in m.prune_semantic_memory(now(5), RetentionPolicy(include_superseded=True), dry_run=True).collect()} == {"keep": 1, "delete": 2}
    m.prune_semantic_memory(now(5), RetentionPolicy(include_superseded=True))
    assert [r.node_id for r in m.facts().collect()] == ["f3"]


def test_o107_intents_make_the_same_rows(spark):
    rows = [("i1", "store_fact", "a", '{"concept": "c", "content": "d", "confidence": 0.5, "tags": ["t"]}'), ("i2", "store_episode", "a", '{"content": "e"}'), ("i3", "link_fact_to_episodes", "a", '{"fact_id": "sem_i1", "episode_ids": ["epi_i2", "x"]}'), ("i4", "link_similar_facts", "a", '{"fact_id_a": "p", "fact_id_b": "q", "similarity_score": 0.7}')]
    df = spark.createDataFrame(rows, "intent_id string, kind string, agent_name string, payload string")
    for _ in range(2):
        assert [(r.node_id, r.agent_id, r.content, r.tags) for r in applying.rows_of(df, "store_fact", now()).collect()] == [("sem_i1", "a", "d", ["t"])]
    assert [r.node_id for r in applying.rows_of(df, "store_episode", now()).collect()] == ["epi_i2"]
    assert {(r.source_id, r.target_id, r.edge_type) for r in applying.edges_of(df).collect()} == {("sem_i1", "epi_i2", "DERIVES_FROM"), ("sem_i1", "x", "DERIVES_FROM"), ("p", "q", "SIMILAR_TO")}


def test_o94_embeddings(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "i int, t string")
    load = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    assert {r.i: r.embedding for r in embedding.embed(df, "t", load, dimensions=2).collect()} == {1: [2.0, 1.0], 2: None}
    assert embedding.embed(df, "t", None).where("embedding is null").count() == 2
    assert embedding.embed(df, "t", load, query=True, dimensions=2).first().embedding[0] == 2.0 + len(embedding.QUERY_PREFIX)
    with pytest.raises(Exception, match="dimensions"):
        embedding.embed(df, "t", load, dimensions=3).collect()


def test_what_is_pruned_is_gone_and_others_stay(spark, tmp_path):
    a, b = (AgentMemory(Catalog(spark, str(tmp_path / "m"), agent=x)) for x in ("a1", "a2"))
    for m in (a, b):
        m.record_sensory([{"node_id": "s", "modality": "text", "raw_data": "x"}], now(1))
        m.store_facts([{"node_id": "f", "concept": "c", "content": "d", "confidence": 0.5, "importance": 0.1}], now(1))
    assert a.prune_expired_sensory(now(2)) == 1
    stored = spark.read.parquet(str(tmp_path / "m" / "sensory"))
    assert [r.agent_id for r in stored.collect()] == ["a2"]
    for _ in range(2):  # archived first, deleted next
        a.prune_semantic_memory(now(3), RetentionPolicy(min_importance=0.5))
    assert [r.agent_id for r in spark.read.parquet(str(tmp_path / "m" / "semantic")).collect()] == ["a2"] and b.facts().count() == 1
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_views_keep_other_agents(spark):
    table = "semantic"
    spark.createDataFrame([("f1", "a1"), ("g1", "a2")], "node_id string, agent_id string").createOrReplaceTempView(table)
    try:
        catalog = Catalog(spark, agent="a1", backend="view")
        catalog.replace(table, catalog.load(table).limit(0))
        assert [r.agent_id for r in spark.table(table).collect()] == ["a2"]
    finally:
        spark.catalog.dropTempView(table)


def test_accesses_are_appended_and_folded(spark, tmp_path):
    m = AgentMemory(Catalog(spark, str(tmp_path / "m"), agent="a1"))
    m.store_facts([{"node_id": "f1", "concept": "c", "content": "ada wrote notes", "confidence": 0.5}], now(1))
    before = sorted((tmp_path / "m" / "semantic").rglob("*.parquet"))
    for day in (2, 3):
        m.recall_facts_ranked("ada notes", now(day))
    assert m.record_access("f1", now(4)) and not m.record_access("f9", now(4))
    assert sorted((tmp_path / "m" / "semantic").rglob("*.parquet")) == before  # no fact is written again
    row = m.facts().first()
    assert row.usage_count == 3 and row.last_accessed_at.day == 4
    m.store_prospective([{"node_id": "i1", "trigger_condition": "x", "priority": 1}], now(1))
    m.check_triggers("x")
    m.compact()
    assert m.facts().first() == row and m.catalog.load("accesses").count() == 0 and m.catalog.load("semantic").first().usage_count == 3
    assert m.prospective().first().status == "triggered"
    m.resolve_prospective("i1")
    m.check_triggers("x")
    assert m.prospective().first().status == "resolved"


def test_quota_holds_for_one_agent_and_before_the_write(spark, tmp_path):
    small = lambda agent: AgentMemory(Catalog(spark, str(tmp_path / "m"), agent=agent, max_memory_mb=1))
    big = spark.range(40_000).selectExpr("cast(id as string) node_id", "'c' concept", "sha2(cast(id as string), 512) content", "0.5D confidence")
    with pytest.raises(ValueError, match="exceeds"):
        small("a1").store_facts(big, now(1))
    assert small("a1").facts().count() == 0
    AgentMemory(Catalog(spark, str(tmp_path / "m"), agent="a2")).store_facts(big, now(1))
    small("a1").store_facts([{"node_id": "f", "concept": "c", "content": "d", "confidence": 0.5}], now(1))  # the other's bytes don't count
    assert small("a1").facts().count() == 1


def test_the_other_methods(spark, tmp_path):
    m = AgentMemory(Catalog(spark, str(tmp_path / "m"), agent="a1"))
    m.record_sensory([{"node_id": "s1", "modality": "text", "raw_data": "x"}], now(1))
    assert m.attend_to_sensory("s1", "loud", now(1)) and not m.attend_to_sensory("s9", "loud", now(1))
    assert [r.content for r in m.list_undistilled_episodes().collect()] == ["[text] x -- attended: loud"]
    assert m.mark_episode_distilled("epi_s1") and not m.mark_episode_distilled("epi_s9") and m.list_undistilled_episodes().count() == 0
    m.push_working([{"node_id": "w1", "task_id": "t", "content": "c", "relevance": 1.0}])
    assert m.clear_working("t") == 1 and m.clear_working("t") == 0 and m.catalog.load("working").count() == 0
    facts = [{"node_id": f"f{i}", "concept": "rivers", "content": c, "confidence": 0.5, "embedding": e} for i, (c, e) in enumerate([("long blue rivers", [1.0, 0.0]), ("old towns", [0.0, 1.0]), ("rivers of towns", [0.6, 0.8])])]
    m.store_facts(facts, now(1))
    m.link_similar_facts("f0", "f1", 0.9)
    m.link_fact_to_episodes("f0", ["epi_s1"])
    assert [r.episode_id for r in m.fact_provenance("f0").collect()] == ["epi_s1"]
    assert [r.node_id for r in m.search_facts("x", limit=1, embedding=[1.0, 0.1]).collect()] == ["f0"]
    assert {r.node_id for r in m.search_facts("blue").collect()} == {"f0", "f1"}  # f1 as a neighbour
    m.store_procedures([{"node_id": "p1", "name": "deploy", "steps": ["ship"]}])
    m.link_procedure_to_episodes("p1", ["epi_s1"])
    assert [r.episode_id for r in m.procedure_provenance("p1").collect()] == ["epi_s1"]
    m.store_prospective([{"node_id": "i1", "trigger_condition": "deploy", "priority": 1}, {"node_id": "i2", "trigger_condition": "rest", "priority": 2}], now(1))
    assert [r.node_id for r in m.get_all_prospective().collect()] == ["i2", "i1"]
    assert [r.node_id for r in m.get_prospective_by_trigger("deploy").collect()] == ["i1"]
