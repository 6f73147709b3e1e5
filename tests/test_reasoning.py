"""Similarity, deduplication, retention, knowledge graph, federation against plain restatements."""

import random

import pytest
from mnemora.functions import vocab
from mnemora.operators import dedup, federation, hierarchical, similarity
from pyspark.sql import functions as F

FACTS = "node_id string, agent_id string, concept string, content string, tags array<string>, created_at int, archived boolean, dedup_key string, confidence double"


def facts(n=60, seed=0):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(14)]
    return [(f"f{i:03d}", rng.choice("ab"), rng.choice(["rust lang", "go lang", "python"]), " ".join(rng.choice(words) for _ in range(rng.randint(2, 6))), rng.sample(["x", "y", "z"], rng.randint(0, 3)), rng.randint(0, 50), i % 10 == 0, rng.choice([None, "k1", "k2", "k3"]), rng.random()) for i in range(n)]


def token_set(text):
    return {w.strip(vocab.PUNCTUATION) for w in text.lower().split() if len(w.strip(vocab.PUNCTUATION)) > 2} - set(vocab.STOP_WORDS)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def score(a, b):
    return 0.5 * jaccard(token_set(a[3]), token_set(b[3])) + 0.2 * jaccard(set(a[4]), set(b[4])) + 0.3 * jaccard(token_set(a[2]), token_set(b[2]))


@pytest.mark.parametrize("threshold", [0.55, 0.6, 0.75, 0.9])
def test_o56_pairs_equal_brute_force(spark, threshold):
    rows = facts()
    got = {(r.a, r.b) for r in similarity.similar_pairs(spark.createDataFrame(rows, FACTS), threshold).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and score(a, b) >= threshold - 1e-12}
    plan = similarity.candidates(similarity.prepared(spark.createDataFrame(rows, FACTS)), threshold)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_o56_refuses_thresholds_it_cannot_search(spark):
    with pytest.raises(ValueError):
        similarity.similar_pairs(spark.createDataFrame(facts(), FACTS), 0.4)


def test_o74_greedy_clusters_equal_a_plain_fold(spark):
    rows = facts(80, 3)
    got = {tuple(r.fact_ids) for r in dedup.find_duplicates(spark.createDataFrame(rows, FACTS), by="similarity", threshold=0.7).collect()}
    live = sorted((r for r in rows if not r[6]), key=lambda r: (r[5], r[0]))
    used, want = set(), set()
    for i, a in enumerate(live):
        if a[0] in used:
            continue
        members = [a] + [b for b in live[i + 1 :] if b[0] not in used and a[1] == b[1] and a[2] == b[2] and score(a, b) >= 0.7 - 1e-12]
        used |= {m[0] for m in members}
        if len(members) > 1:
            want.add(tuple(m[0] for m in members))
    assert got == want and want


@pytest.mark.parametrize("mode", ["none", "hash", "key", "similarity"])
def test_o111_upserts_equal_a_plain_fold(spark, mode):
    rows = facts(90, 5)
    rows = [(*r[:8], float("nan") if i % 17 == 3 else r[8]) for i, r in enumerate(rows)]
    there, inputs = rows[:30], rows[30:]
    df = lambda rs: spark.createDataFrame(rs, FACTS)
    decided = dedup.upsert(df(there), df(inputs), mode, 0.7)
    got = {r.node_id: (r.action, r.target_id) for r in decided.collect()}
    live = sorted((r for r in there if not r[6]), key=lambda r: (r[5], r[0]))
    holders, want = {}, {}
    key = lambda r: (r[1], r[2], r[3]) if mode == "hash" else (r[1], r[7])
    for r in live:
        if mode == "hash":
            holders.setdefault(key(r), r)
        elif mode == "key" and r[7] is not None:
            same = holders.get(key(r))
            holders[key(r)] = same if same and same[2:4] == r[2:4] else r
    heads = list(live)
    for r in sorted(inputs, key=lambda r: (r[5], r[0])):
        if r[8] != r[8]:
            want[r[0]] = ("invalid", None)
        elif mode == "none" or (mode == "key" and r[7] is None):
            want[r[0]] = ("inserted", r[0])
        elif mode == "similarity":
            near = [h for h in heads if h[1:3] == r[1:3] and score(h, r) >= 0.7 - 1e-12]
            want[r[0]] = ("reused", near[0][0]) if near else ("inserted", r[0])
            if not near:
                heads.append(r)
        elif (held := holders.get(key(r))) is None:
            holders[key(r)], want[r[0]] = r, ("inserted", r[0])
        elif held[2:4] == r[2:4]:
            want[r[0]] = ("reused", held[0])
        else:
            holders[key(r)], want[r[0]] = r, ("superseded", r[0])
    assert got == want
    if mode == "hash":
        after = dedup.apply_upserts(df(there).withColumn("usage_count", F.lit(0).cast("long")), df(inputs), decided)
        assert after.count() == 30 + sum(a == "inserted" for a, _ in want.values()) and after.agg(F.sum("usage_count")).first()[0] == sum(a == "reused" for a, _ in want.values())


def test_o33_supersede(spark):
    df = spark.createDataFrame([("a", False, None), ("b", False, None)], "node_id string, archived boolean, superseded_by string")
    edges = spark.createDataFrame([], "source_id string, target_id string, edge_type string")
    changes = spark.createDataFrame([("a", "b", "newer"), ("a", "a", "self"), ("zz", "b", "missing")], "old_id string, new_id string, reason string")
    after, new_edges, rejected = dedup.supersede(df, edges, changes)
    assert {(r.node_id, r.archived, r.superseded_by) for r in after.collect()} == {("a", True, "b"), ("b", False, None)}
    assert [(r.source_id, r.target_id) for r in new_edges.collect()] == [("b", "a")] and [r.old_id for r in rejected.collect()] == ["zz"]


def test_o100_f17_subgraph_and_context(spark):
    rows = [("n1", "a", "Rust", "Rust is fast", 0.9, "e1", "rust lang", '{"temporal_index": 2}', []), ("n2", "a", "Memory", "safe memory", 0.5, None, None, '{"temporal_index": 1, "source_date": "2024"}', []), ("n3", "a", "Far", "unrelated", 0.8, None, None, None, [])]
    df = spark.createDataFrame(rows, "node_id string, agent_id string, concept string, content string, confidence double, source_id string, entity_name string, metadata string, tags array<string>")
    edges = spark.createDataFrame([("n1", "n2", "SIMILAR_TO", 0.7), ("n2", "n3", "SIMILAR_TO", 0.6), ("n3", "n2", "SUPERSEDES", 1.0)], "source_id string, target_id string, edge_type string, weight double")
    episodes = spark.createDataFrame([("e1", "wiki")], "node_id string, source_label string")
    nodes, inside = hierarchical.retrieve_subgraph(df, edges, episodes, "rust", 2, 20)
    assert {(r.node_id, r.source_label, r.superseded_by, r.confidence) for r in nodes.collect()} == {("n1", "wiki", None, 0.9), ("n2", None, "n3", 0.25), ("n3", None, None, 0.8)}
    assert {(r.source_id, r.target_id) for r in inside.collect()} == {("n1", "n2"), ("n2", "n3")}
    text = hierarchical.to_llm_context(nodes, inside.withColumn("edge_type", F.lit("SIMILAR_TO")), "rust").first().context
    assert text.startswith("Knowledge graph context for: rust\n\nFacts:\n  1. [Rust] [Source: wiki] Rust is fast (confidence: 0.9)\n  2. [Far] unrelated (confidence: 0.8)") and "  - n1.. SIMILAR_TO n2.. (weight: 0.70)" in text
    assert " [Date: 2024]" in hierarchical.to_llm_context(nodes, inside.limit(0).withColumn("edge_type", F.lit("x")), "rust", chronological=True).first().context
    assert hierarchical.to_llm_context(nodes.limit(0), inside.limit(0).withColumn("edge_type", F.lit("x")), "q").first().context == "No relevant knowledge found."
    small, _ = hierarchical.retrieve_subgraph(df, edges, episodes, "rust", 2, 2)
    assert {r.node_id for r in small.collect()} == {"n1", "n2"}


def test_o57_and_store_knowledge(spark):
    kind = "node_id string, agent_id string, concept string, content string, tags array<string>, metadata string, source_id string, confidence string"
    old = [("o1", "a", "river length", "The river is 10 km", [], '{"temporal_index": 1}', None, "0.5"), ("o2", "a", "other", "The river is 11 km", [], '{"temporal_index": 2}', None, "0.5")]
    new = [("n1", "a", "River length", "The river is 12 km", ["t"], '{"temporal_index": 3}', "e1", "bad"), ("n2", "a", None, "how to swim", None, None, "gone", "0.4")]
    rows, edges = hierarchical.store_knowledge(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), spark.createDataFrame([("e1",)], "node_id string"), threshold=0.6)
    assert {(r.node_id, r.confidence, r.category) for r in rows.collect()} == {("n1", 0.8, "semantic"), ("n2", 0.4, "procedural")}
    found = {(r.source_id, r.target_id, r.edge_type): r.reason for r in edges.collect()}
    assert found["n1", "o1", "SUPERSEDES"] == "Updated values: 12 vs 10" and ("n1", "e1", "DERIVES_FROM") in found and ("n1", "o2", "SUPERSEDES") not in found and ("n1", "o1", "SIMILAR_TO") in found


def test_o98_o105_federation(spark):
    kind = "node_id string, node_type string, properties map<string,string>, graph_origin string"
    local = spark.createDataFrame([("1", "t", {"k": "v"}, "l"), ("2", "t", {"k": "w"}, "l")], kind)
    hive = spark.createDataFrame([("1", "t", {"k": "other"}, "h"), ("3", "t", {"k": "w"}, "h"), ("4", "t", {"k": "new"}, "h")], kind)
    assert {(r.node_id, r.source) for r in federation.merge([("local", local), ("hive", hive)]).collect()} == {("1", "local"), ("2", "local"), ("4", "hive")}
    agents = spark.createDataFrame([("a", "db", 0.3, 1)], "agent_id string, domain string, trust double, fact_count long")
    more = federation.register_agents(agents, spark.createDataFrame([("b", "db admin", None, 0), ("a", "x", 0.9, 0)], agents.schema))
    assert {(r.agent_id, r.trust) for r in more.collect()} == {("a", 0.3), ("b", 0.0)}
    assert [r.agent_id for r in federation.expert_agents(more, "DB").collect()] == ["a", "b"]
    assert federation.increment_fact_counts(more, spark.createDataFrame([("b",), ("b",)], "agent_id string")).where("agent_id = 'b'").first().fact_count == 2
    with pytest.raises(Exception, match="out of range"):
        federation.register_agents(agents, spark.createDataFrame([("c", "x", 1.5, 0)], agents.schema)).collect()


def test_o56_new_facts_meet_old_ones_only_through_their_own_tokens(spark):
    rows = facts()
    old, new = rows[: len(rows) // 2], rows[len(rows) // 2 :]
    df = lambda rs: spark.createDataFrame(rs, FACTS)
    got = {(r.a, r.b) for r in similarity.similar_pairs(df(old), 0.6, df(new)).collect()}
    ids = {r[0] for r in new}
    pairs = {(r.a, r.b) for r in similarity.similar_pairs(df(rows), 0.6).collect()}
    assert got == {p for p in pairs if set(p) & ids} and got != pairs
    assert similarity.similar_pairs(df(old), 0.6, df(new).limit(0)).count() == 0
    plan = similarity.candidates(similarity.prepared(df(old), False).unionByName(similarity.prepared(df(new))), 0.6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter fresh" in plan or "fresh#" in plan  # one side of every join holds new facts alone


def test_o74_o111_agents_are_apart(spark):
    shape = "node_id string, agent_id string, concept string, content string, confidence double, tags array<string>, created_at int, archived boolean, dedup_key string, key string, n int"
    rows = [("a1", "x", "rivers", "long blue water", 0.5, ["t"], 1, False, "k", "mine", 1), ("a2", "x", "rivers", "long blue water", 0.5, ["t"], 2, False, "k", "mine", 1), ("b1", "y", "rivers", "long blue water", 0.5, ["t"], 3, False, "k", "mine", 1), ("c1", None, "rivers", "long blue water", 0.5, ["t"], 4, False, "k", None, 1)]
    df = spark.createDataFrame(rows, shape)
    for by in ("hash", "key", "similarity"):
        assert [(r.agent_id, r.fact_ids) for r in dedup.find_duplicates(df, by).collect()] == [("x", ["a1", "a2"])], by
    new = spark.createDataFrame([("z", "y", "rivers", "long blue water", 0.5, ["t"], 9, False, "k", "mine", 1), ("w", "q", "rivers", "long blue water", 0.5, ["t"], 9, False, "k", "mine", 1)], shape)
    for mode in ("hash", "key", "similarity"):
        got = {r.node_id: (r.action, r.target_id) for r in dedup.upsert(df, new, mode).collect()}
        assert got == {"z": ("reused", "b1"), "w": ("inserted", "w")}, mode
