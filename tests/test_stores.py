"""Catalog, exchange, graph store, memory types, experiences."""

import pytest
from mnemora.operators import experiences, federation, graphstore, hierarchical, memory
from mnemora.sources import exchange
from mnemora.sources.catalog import Catalog, MemoryCatalogError, agent_name, identifier
from pyspark.sql import functions as F

NODES = "node_id string, node_type string, properties map<string,string>, graph_origin string"
EDGES = "edge_id string, source_id string, target_id string, edge_type string, properties map<string,string>, graph_origin string"


def graph(spark):
    nodes = [("a", "t", {"name": "Alpha", "p": "9"}, "local"), ("b", "t", {"name": "beta", "p": "10"}, "local"), ("c", "t", {"name": "Gamma", "p": "100"}, "remote"), ("d", "t", {"p": "x"}, "local"), ("e", "u", {"_deleted": "true"}, "local")]
    edges = [("1", "a", "b", "KNOWS", {}, "local"), ("2", "b", "c", "KNOWS", {}, "local"), ("3", "c", "a", "KNOWS", {}, "local"), ("4", "a", "a", "LIKES", {}, "local"), ("5", "a", "b", "LIKES", {}, "local"), ("6", "d", "e", "KNOWS", {}, "local")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def ids(df, column="node_id"):
    return [r[column] for r in df.collect()]


def test_o1_o6_scans(spark):
    nodes, edges = graph(spark)
    assert ids(graphstore.query_nodes(nodes, "t", limit=2)) == ["a", "b"] and ids(graphstore.query_nodes(nodes, "t", {"p": "10"})) == ["b"]
    assert ids(graphstore.query_nodes_ordered(nodes, "t", None, "p", numeric=True, descending=True)) == ["c", "b", "a", "d"]
    assert ids(graphstore.query_nodes_ordered(nodes, "t", None, "p", limit=2)) == ["b", "c"]
    with pytest.raises(MemoryCatalogError):
        graphstore.query_nodes_ordered(nodes, "t", None, "p; drop", limit=2)
    assert graphstore.count_nodes(nodes, "t").first().n == 4
    assert sorted(ids(graphstore.bulk_edges(nodes, edges, "KNOWS"), "source_id")) == ["a", "b", "c"] and graphstore.bulk_edges(nodes, edges, "NONE").count() == 0
    assert ids(graphstore.search_nodes(nodes, "t", ["name"], "ALPH")) == ["a"] and ids(graphstore.search_all_properties(nodes, "GAM")) == ["c"]


def test_o16_o20_changes(spark):
    nodes, edges = graph(spark)
    revived = graphstore.upsert_nodes(nodes, spark.createDataFrame([("e", "u", {"k": "v"}, "local")], NODES))
    assert "e" in ids(graphstore.live(revived)) and "e" not in ids(graphstore.live(nodes))
    changed = graphstore.update_nodes(nodes, spark.createDataFrame([("a", {"name": "New", "z": "1"})], "node_id string, set_properties map<string,string>"))
    assert graphstore.get_node(changed, "a").first().properties == {"name": "New", "p": "9", "z": "1"}
    left, kept = graphstore.delete_nodes(nodes, edges, nodes.where("node_id = 'a'"))
    assert left.count() == 4 and sorted(ids(kept, "edge_id")) == ["2", "6"]
    new = spark.createDataFrame([(None, "a", "c", "KNOWS", {}, "local"), (None, "a", "zz", "KNOWS", {}, "local")], EDGES)
    added, rejected = graphstore.add_edges(nodes, edges, new)
    assert added.count() == 7 and ids(rejected, "target_id") == ["zz"] and added.where("edge_id is null").count() == 0
    assert graphstore.delete_edges(edges, edges.where("edge_type = 'LIKES'")).count() == 4


def test_o55_o99_walks(spark):
    nodes, edges = graph(spark)
    start = nodes.where("node_id = 'a'")
    both = graphstore.query_neighbors(nodes, edges, start, direction="both").collect()
    assert sorted((r.node_id, r.edge_type, r.side) for r in both) == [("a", "LIKES", 0), ("a", "LIKES", 1), ("b", "KNOWS", 0), ("b", "LIKES", 0), ("c", "KNOWS", 1)]
    assert [r.side for r in sorted(graphstore.query_neighbors(nodes, edges, start, direction="both", limit=3).collect(), key=lambda r: r.side)] == [0, 0, 0]
    paths = graphstore.traverse(nodes, edges, start, ["KNOWS"], 3)
    assert sorted((r.from_id, r.to_id, r.hops, r.crossed) for r in paths.collect()) == [("a", "b", 1, False), ("b", "c", 2, True), ("c", "a", 3, True)]
    assert sorted((r.node_id, r.hops) for r in graphstore.distances(paths).collect()) == [("a", 3), ("b", 1), ("c", 2)]
    assert federation.crosses_boundary(paths).first().crossed_boundaries is True
    blocked = graphstore.traverse(nodes, edges, start, ["KNOWS"], 3, expand=F.col("node_id") != "c")
    assert [(r.from_id, r.to_id) for r in blocked.collect()] == [("a", "b")]


def test_o101_chains(spark):
    links = [(f"v{i}", f"v{i - 1}") for i in range(1, 21)] + [("w1", "w0")]
    edges = spark.createDataFrame([(None, a, b, "SUPERSEDES", {"reason": f"{a}>{b}"}, None) for a, b in links], EDGES)
    got = sorted((r.head_id, r.position, r.node_id) for r in graphstore.chains(edges).collect())
    assert got == sorted([("v20", i, f"v{20 - i}") for i in range(21)] + [("w1", 0, "w1"), ("w1", 1, "w0")])


def test_o14_o35_catalog(spark, tmp_path):
    for bad in ("", "1a", "a b", "a;", None):
        with pytest.raises(MemoryCatalogError):
            identifier(bad)
    with pytest.raises(MemoryCatalogError):
        agent_name("-x")
    with pytest.raises(MemoryCatalogError):
        Catalog(spark, str(tmp_path), max_memory_mb=0)
    everyone, one = Catalog(spark, str(tmp_path / "m")), Catalog(spark, str(tmp_path / "m"), agent="a1")
    assert one.load("sensory").count() == 0
    rows = spark.createDataFrame([("s1", "a1", "text"), ("s2", "a2", "text")], "node_id string, agent_id string, modality string")
    everyone.save("sensory", rows)
    assert ids(one.load("sensory")) == ["s1"] and everyone.load("sensory").count() == 2 and "expires_at" in one.load("sensory").columns
    assert "PartitionFilters: [isnotnull(agent_id" in one.load("sensory")._jdf.queryExecution().executedPlan().toString()
    copy = Catalog(spark, str(tmp_path / "copy"))
    everyone.copy_to(copy, ["sensory"])
    assert copy.load("sensory").count() == 2 and everyone.size_bytes() > 0
    full = Catalog(spark, str(tmp_path / "m"), max_memory_mb=1)
    full.size_bytes = lambda: 2 << 20
    with pytest.raises(MemoryCatalogError):
        full.save("sensory", rows)
    views = Catalog(spark, backend="view")
    views.save("sensory", rows)
    assert views.load("sensory").count() == 2


def test_o11_o12_exchange(spark, tmp_path):
    n = lambda *xs: spark.createDataFrame([(x, "c") for x in xs], "node_id string, content string")
    e = lambda *xs: spark.createDataFrame(list(xs), "source_id string, target_id string")
    sections = {"semantic_nodes": n("f1", "f2"), "episodic_nodes": n("e1"), "similar_to_edges": e(("f1", "f2")), "derives_from_edges": e(("f1", "e1"), ("f1", "gone")), "supersedes_edges": spark.createDataFrame([], "source_id string, target_id string")}
    manifest = exchange.export_json(sections, str(tmp_path / "x"))
    assert {(r.section, r.n_rows) for r in manifest.collect()} == {("semantic_nodes", 2), ("episodic_nodes", 1), ("similar_to_edges", 1), ("derives_from_edges", 2)}
    current = {k: d.limit(0) for k, d in sections.items()} | {"semantic_nodes": n("f1", "old")}
    after, stats = exchange.import_json(spark, str(tmp_path / "x"), current, merge=True)
    assert sorted(ids(after["semantic_nodes"])) == ["f1", "f2", "old"] and after["derives_from_edges"].count() == 1
    assert {(r.section, r.imported, r.skipped, r.errors) for r in stats.collect()} == {("semantic_nodes", 1, 1, 0), ("episodic_nodes", 1, 0, 0), ("similar_to_edges", 1, 0, 0), ("derives_from_edges", 1, 0, 1), ("supersedes_edges", 0, 0, 0)}
    replaced, _ = exchange.import_json(spark, str(tmp_path / "x"), current)
    assert sorted(ids(replaced["semantic_nodes"])) == ["f1", "f2"]


def test_o63_replay_equals_plain_eviction(spark):
    import random

    rng = random.Random(0)
    pushes = [(f"n{i:03d}", "a", rng.choice("xy"), float(rng.randint(0, 9)), i) for i in range(120)]
    got = memory.replay_working(spark.createDataFrame(pushes, "node_id string, agent_id string, task_id string, relevance double, created_at int").repartition(3), capacity=5)
    want = {"x": [], "y": []}
    for p in pushes:
        slots = want[p[2]]
        if len(slots) >= 5:
            slots.remove(min(slots, key=lambda s: (s[3], s[4], s[0])))
        slots.append(p)
    assert sorted(ids(got)) == sorted(p[0] for slots in want.values() for p in slots)


def test_episodes_and_facts(spark):
    new = spark.createDataFrame([("e1", "a", "x", "s", None), ("e2", "a", "y", "s", 50), ("e3", "a", "z", "s", None), ("e4", "b", "w", "s", None)], "node_id string, agent_id string, content string, source_label string, temporal_index long")
    before = spark.createDataFrame([("a", 7)], "agent_id string, temporal_index long")
    assert {r.node_id: r.temporal_index for r in memory.store_episodes(before, new).collect()} == {"e1": 8, "e2": 50, "e3": 51, "e4": 1}
    facts = spark.createDataFrame([("f1", "a", "c", "x", 0.5), ("f2", "a", "c", "x", float("nan")), ("f3", "a", " ", "x", 0.5), ("f4", "a", "c", "x", 1.0)], "node_id string, agent_id string, concept string, content string, confidence double")
    sources = spark.createDataFrame([("f1", "e1"), ("f4", "e1"), ("f4", "nowhere")], "node_id string, episode_id string")
    good, edges, rejected = memory.store_facts(facts, new, sources)
    assert sorted(ids(good)) == ["f1", "f4"] and edges.count() == 2 and {r.node_id for r in rejected.collect()} == {"f2", "f3"}
    strict, edges, rejected = memory.store_facts(facts, new, sources, strict=True)
    assert ids(strict) == ["f1"] and edges.count() == 1 and {(r.node_id, r.error) for r in rejected.collect()} >= {("f4", "unknown episode")}
    with pytest.raises(Exception, match="another agent"):
        memory.record_access(good.withColumns({"usage_count": F.lit(0), "last_accessed_at": F.lit(None).cast("timestamp")}), spark.createDataFrame([("f1",)], "node_id string").withColumn("accessed_at", F.lit("2026-01-01").cast("timestamp")), agent="b").collect()


def test_consolidation_and_triggers(spark):
    rows = [(f"e{i}", "a", f"t{i}", i, False) for i in range(12)] + [("z", "b", "t", 1, False)]
    episodes = spark.createDataFrame(rows, "node_id string, agent_id string, content string, temporal_index long, compressed boolean")
    made = memory.consolidate_episodes(episodes, 10)
    assert [(r.agent_id, r.summary, r.original_count) for r in made.collect()] == [("a", " | ".join(f"t{i}" for i in range(10)), 10)]
    assert memory.compress_consolidated(episodes, made).where("compressed").count() == 10
    shouted = memory.consolidate_episodes(episodes, 10, lambda contents: F.upper(F.element_at(contents, 1)))
    assert shouted.first().summary == "T0"
    wishes = spark.createDataFrame([("p1", 1, "pending", "deploy now"), ("p2", 5, "pending", "ploy"), ("p3", 9, "resolved", "deploy")], "node_id string, priority int, status string, trigger_condition string")
    said = spark.createDataFrame([("c", "We DEPLOY at noon")], "content_id string, content string")
    assert ids(memory.check_triggers(wishes, said)) == ["p1"] and sorted(ids(memory.check_triggers(wishes, said, "substring"))) == ["p1", "p2"]


def test_o38_stemmed_search_and_o62_trim(spark):
    rows = [("e1", "success", "The deployments failed quickly", "x", 0.9, 1), ("e2", "pattern", "deploying is a failure", "x", 0.9, 2), ("e3", "success", "nothing", "x", 0.1, 3)]
    df = spark.createDataFrame(rows, "experience_id string, experience_type string, context string, outcome string, confidence double, timestamp int")
    assert ids(experiences.search_stemmed(df, "deploy failing"), "experience_id") == [] and ids(experiences.search_stemmed(df, "Deployment, fails"), "experience_id") == ["e1"]
    assert len(ids(experiences.search_stemmed(df, " "), "experience_id")) == 3
    assert sorted(ids(experiences.trim(df, 1), "experience_id")) == ["e2", "e3"] and experiences.trim(df, 3).count() == 3


def test_o101_chains_have_no_limit_and_circles_end(spark):
    pairs = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(200)] + [("h", "x"), ("x", "y"), ("y", "z"), ("z", "x")]
    edges = spark.createDataFrame([(a, b, "SUPERSEDES", {}) for a, b in pairs], "source_id string, target_id string, edge_type string, properties map<string,string>")
    got = {(r.head_id, r.position, r.node_id) for r in graphstore.chains(edges).collect()}
    assert got == {("n000", i, f"n{i:03d}") for i in range(201)} | {("h", 0, "h"), ("h", 1, "x"), ("h", 2, "y"), ("h", 3, "z")}


def test_columns_of_the_caller_stay_whatever_their_names(spark):
    own = ("tier", "best", "n", "place", "uses", "at", "used", "error", "lost", "named", "done", "noted", "all_steps", "added", "key", "rank", "source_x")
    extra = lambda df: df.withColumns({c: F.lit(f"my {c}") for c in own if c not in df.columns})
    kept = lambda df: all(getattr(r, c) == f"my {c}" for r in df.collect() for c in own) and df.count() > 0
    facts = extra(spark.createDataFrame([("f1", "a", "rivers", "blue water", 0.5, 0, None, "ada")], "node_id string, agent_id string, concept string, content string, confidence double, usage_count long, last_accessed_at timestamp, entity_name string"))
    episodes = extra(spark.createDataFrame([("e1", "a", "x", False, False, 1)], "node_id string, agent_id string, content string, compressed boolean, distilled boolean, temporal_index long"))
    ids = spark.createDataFrame([("f1",), ("e1",)], "node_id string")
    assert kept(hierarchical.retrieve_by_entity(facts, "ada"))
    assert kept(memory.record_access(facts, ids.withColumn("accessed_at", F.current_timestamp()), "a"))
    good, _, rejected = memory.store_facts(facts, episodes, ids.limit(0).withColumn("episode_id", F.lit("e1")), strict=True)
    assert kept(good) and rejected.count() == 0
    assert kept(memory.mark_distilled(episodes, ids, "a"))
    assert kept(memory.compress_consolidated(episodes, spark.createDataFrame([("a", ["e1"])], "agent_id string, episode_ids array<string>")))
    slots = extra(spark.createDataFrame([("w1", "a", "t", 1.0, None)], "node_id string, agent_id string, task_id string, relevance double, created_at timestamp"))
    assert kept(memory.working_slots(slots))
    steps = extra(spark.createDataFrame([("p1", "deploy", ["ship"], 0)], "node_id string, name string, steps array<string>, usage_count long"))
    assert kept(memory.recall_procedures(steps, "ship")[0]) and kept(memory.fold_uses(steps, ids))
    wishes = extra(spark.createDataFrame([("i1", "pending")], "node_id string, status string"))
    assert kept(memory.resolve_prospective(wishes, ids)) and kept(memory.fold_statuses(wishes, wishes.select("node_id", F.lit("resolved").alias("status"))))
    rows = extra(spark.createDataFrame([("x1", "c", "o", 0.5, "success")], "experience_id string, context string, outcome string, confidence double, experience_type string"))
    assert kept(experiences.store(rows.limit(0), rows)[0])
    nodes = extra(spark.createDataFrame([("a", "t", {"k": "v"})], "node_id string, node_type string, properties map<string,string>"))
    assert kept(federation.merge([("here", nodes)]))
