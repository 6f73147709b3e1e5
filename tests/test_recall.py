"""Ranking: the golden recall corpus, graph proximity against a plain walk, rerank, vectors."""

import math
import random

import pytest
from mnemora.operators import experiences, measure, recall
from mnemora.operators.recall import RecallOptions
from pyspark.sql import Window
from pyspark.sql import functions as F

CORPUS = [
    ("e01", "success", "The SQL injection vulnerability was found in the login form."), ("e02", "pattern", "Parameterized queries prevent SQL injection in user input."), ("e03", "success", "Cross-site scripting was detected in the comment field."),
    ("e04", "success", "The Python documentation was missing runnable examples."), ("e05", "pattern", "Good docstrings raise Python documentation quality."), ("e06", "success", "The JavaScript code review completed with no issues."),
    ("e07", "success", "Database read latency dropped after we added an index."), ("e08", "pattern", "Missing indexes cause slow database scans under load."), ("e09", "insight", "Refactoring into small functions improves maintainability."),
    ("e10", "success", "Unit test coverage was raised from 60 percent to 90 percent."), ("e11", "pattern", "Flaky tests are usually caused by shared mutable state."), ("e12", "success", "The memory leak was traced to an unclosed file handle."),
    ("e13", "success", "Response caching cut the API latency roughly in half."), ("e14", "failure", "The deployment failed due to a missing environment variable."), ("e15", "insight", "Clear error messages reduce debugging time for engineers."),
    ("e16", "success", "The CSV parser crashed on rows with embedded commas."), ("e17", "success", "How do we stop the staging server before the nightly job?"), ("e18", "success", "Notes on how to run the release and how to prevent downtime."),
    ("e19", "success", "A quick guide on how to improve the onboarding docs for users."), ("e20", "success", "We need to reduce the noise in the daily standup meeting."),
]
LABELS = {
    "How do we prevent SQL injection?": "e01 e02", "How to improve Python documentation?": "e04 e05", "Why are the database queries so slow?": "e07 e08", "How do we reduce flaky tests?": "e10 e11",
    "Why did the deployment fail?": "e14", "How can we reduce API latency?": "e13", "How to trace a memory leak?": "e12", "How do we run a code review?": "e06",
}


def test_golden_recall_quality(spark):
    rows = spark.createDataFrame([(*r, 0.8) for r in CORPUS], "experience_id string, experience_type string, context string, confidence double").withColumn("timestamp", F.lit("2026-01-01 12:00:00").cast("timestamp"))
    now, ranked = F.lit("2026-01-02 12:00:00").cast("timestamp"), None
    for query in LABELS:
        one = experiences.retrieve_relevant(rows, query, now, top_k=20).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("relevance"), "experience_id"))).select(F.lit(query).alias("query"), F.col("experience_id").alias("item_id"), "pos")
        ranked = one if ranked is None else ranked.unionAll(one)
    labels = spark.createDataFrame([(q, i) for q, ids in LABELS.items() for i in ids.split()], "query string, item_id string")
    got = measure.labelled_precision(ranked, labels, 3).agg(F.avg("precision_at_k"), F.avg("reciprocal_rank")).first()
    assert got[0] == pytest.approx(11 / 24) and got[1] == 1.0


def test_precision_at_k(spark):
    df = spark.createDataFrame([(1, "rust", "memory"), (2, "go", "channels"), (3, "rust", "async")], "pos int, concept string, content string")
    at = lambda q, k: measure.precision_at_k(df, q, k).first()[0]
    assert at("rust", 2) == 0.5 and at("rust", 10) == pytest.approx(2 / 3) and at("*", 2) is None and at(" ", 2) is None and at("rust", 0) is None
    assert measure.precision_at_k(df.limit(0), "rust", 3).first()[0] is None


def plain(text):
    return set(text.lower().split())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_ranked_recall_equals_a_plain_walk(spark, hops):
    rng = random.Random(hops)
    words = "rust async memory graph cache index river stone".split()
    facts = [(f"n{i:02d}", f"a{i % 2}", rng.choice(words), " ".join(rng.choice(words) for _ in range(4)), rng.random(), rng.random(), rng.randint(0, 4), i % 7 == 0, "x" if i % 9 == 0 else None) for i in range(40)]
    edges = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}", "SIMILAR_TO") for _ in range(70)]
    df = spark.createDataFrame(facts, "node_id string, agent_id string, concept string, content string, confidence double, importance double, usage_count int, archived boolean, superseded_by string").withColumns({"created_at": F.lit("2026-01-01").cast("timestamp"), "last_accessed_at": F.lit(None).cast("timestamp")})
    now, query = F.lit("2026-01-08").cast("timestamp"), "rust memory graph"
    got = recall.recall_facts(df, query, now, RecallOptions(limit=12, max_graph_hops=hops), spark.createDataFrame(edges, "source_id string, target_id string, edge_type string")).collect()
    by = {f[0]: f for f in facts}
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def best(start):
        seen, frontier, top = {start}, [start], 0.0
        for hop in range(1, hops + 1):
            following = []
            for at in frontier:
                for b in near.get(at, ()):
                    if b not in seen and by[b][1] == by[start][1]:
                        following.append(b)
                        top = max(top, jaccard(plain(query), plain(f"{by[b][2]} {by[b][3]}")) / hop)
                        seen.add(b)
            frontier = following
        return top

    scored = sorted((-(jaccard(plain(query), plain(f"{f[2]} {f[3]}")) + 0.7 * f[4] + 0.5 * f[5] + 0.4 * 2**-1 + 0.3 * math.log(1 + f[6]) + 0.6 * best(f[0])), -f[4], f[0]) for f in facts if not f[7] and f[8] is None)
    assert [r.node_id for r in got] == [x[2] for x in scored[:12]]
    assert all(r.score == pytest.approx(-x[0]) for r, x in zip(got, scored, strict=False)) and all(r.reasons for r in got)


def test_baseline_reason_and_decay(spark):
    df = spark.createDataFrame([("a", "x", "c", "t", 0.0, 0.0, 0, False, None)], "node_id string, agent_id string, concept string, content string, confidence double, importance double, usage_count int, archived boolean, superseded_by string").withColumns({"created_at": F.lit("2026-01-01").cast("timestamp"), "last_accessed_at": F.lit(None).cast("timestamp")})
    row = recall.recall_facts(df, "zzz", F.lit("2026-01-01").cast("timestamp"), RecallOptions(half_life_seconds=0.0)).first()
    assert row.score == 0.0 and row.reasons == ["baseline (no positive signals)"]
    assert spark.range(1).select(recall.exp_decay(F.lit(10.0), 10.0)).first()[0] == 0.5


def test_rerank_and_cosine(spark):
    df = spark.createDataFrame([(0, "cats", "sleep long", False), (1, "dogs", "bark loud", True), (2, "dogs", "sleep", False)], "pos int, context string, outcome string, temporal boolean")
    assert [r.pos for r in recall.rerank(df, "dogs sleep").collect()] == [2, 0, 1]
    assert [r.pos for r in recall.rerank(df, "when did dogs bark", 2).collect()] == [1, 2]
    assert [r.pos for r in recall.rerank(df, "", 2).collect()] == [0, 1]
    arrays = lambda *x: F.array(*map(F.lit, x))
    got = spark.range(1).select(recall.cosine(arrays(1.0, 0.0), arrays(2.0, 0.0)), recall.cosine(arrays(1.0, 0.0), arrays(0.0, 0.0)), recall.cosine(arrays(1.0), arrays(1.0, 0.0))).first()
    assert tuple(got) == (1.0, None, None)


def test_top_k_plan(spark):
    df = spark.createDataFrame([], "experience_id string, experience_type string, context string, outcome string, confidence double, timestamp timestamp")
    plan = experiences.retrieve(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
