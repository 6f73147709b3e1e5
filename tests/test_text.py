"""Text functions F1-F20: golden values, and plain-Python restatements on random input."""

import random

import pytest
from mnemora.functions import text as T
from mnemora.functions import vocab
from mnemora.functions.stemming import porter
from mnemora.operators import creative, measure, patterns
from mnemora.operators.security import Capabilities, NotPermitted, SecureExperiences
from pyspark.sql import functions as F


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def random_text(rng):
    parts = ["Alpha", "beta,", "THE", "and", "(gamma)", "it's", "x", "no", "never", "delta!", "42", "3.14", "é", "naïve.", "\n", "\t", " ", "...", "a-b", "how"]
    return " ".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))


def test_f1_f2_tokens(spark):
    rng = random.Random(1)
    texts = [random_text(rng) for _ in range(200)] + ["", "   ", "!!! ?", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.tokens(F.col("t")).alias("a"), T.short_tokens(F.col("t")).alias("b"), T.plain_tokens(F.col("t")).alias("c"), T.tokens(F.col("t"), strict_bytes=True).alias("d")).collect()
    for r in rows:
        words = (texts[r.i] or "").lower().split()
        strip = lambda marks: {w.strip(marks) for w in words}
        assert set(r.a) == {w for w in strip(vocab.PUNCTUATION) if len(w) > 2} - set(vocab.STOP_WORDS) and len(r.a) == len(set(r.a))
        assert set(r.b) == {w for w in strip(vocab.SHORT_PUNCTUATION) if len(w) > 2} - set(vocab.SHORT_STOP_WORDS)
        assert set(r.c) == set(words)
        assert set(r.d) == {w for w in strip(vocab.PUNCTUATION) if len(w.encode()) > 2} - set(vocab.STOP_WORDS)
    for t in texts[:40]:
        if t is not None:
            assert sorted(value(spark, T.query_tokens(t))) == sorted(rows[texts.index(t)].a)
            assert sorted(value(spark, T.query_tokens(t, "short"))) == sorted(rows[texts.index(t)].b)


def test_f3_similarity_properties(spark):
    rng = random.Random(2)
    rows = [(random_text(rng), random_text(rng), ["a", "B "][: rng.randint(0, 2)], random_text(rng), random_text(rng), ["b", "c"][: rng.randint(0, 2)]) for _ in range(120)]
    df = spark.createDataFrame(rows, "ca string, na string, ta array<string>, cb string, nb string, tb array<string>")
    a, b = [F.col(c) for c in ("ca", "na", "ta")], [F.col(c) for c in ("cb", "nb", "tb")]
    for r in df.select(T.similarity(*a, *b).alias("x"), T.similarity(*b, *a).alias("y"), T.jaccard(T.tokens(F.col("ca")), T.tokens(F.col("ca"))).alias("s"), F.size(T.tokens(F.col("ca"))).alias("n")).collect():
        assert r.x == r.y and 0 <= r.x <= 1 and r.s == (1.0 if r.n else 0.0)


def test_f3_golden(spark):
    tags = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    full = (F.lit("Rust programming language is fast"), F.lit("rust"), tags("language", "systems"))
    assert value(spark, T.similarity(*full, *full)) == 1.0
    assert value(spark, T.jaccard(T.tag_set(tags("rust", "python")), T.tag_set(tags("python", "go")))) == pytest.approx(1 / 3)
    assert value(spark, T.jaccard(T.tokens(F.lit("alpha beta gamma")), T.tokens(F.lit("delta epsilon zeta")))) == 0.0
    assert value(spark, T.similarity(F.lit("alpha"), F.lit("one"), tags("x"), F.lit("omega"), F.lit("two"), tags("X "))) == pytest.approx(0.2)


def test_f4_f5_contradictions(spark):
    conflict = lambda a, b, c="temperature", d="temperature": value(spark, T.numeric_contradiction(F.lit(a), F.lit(b), F.lit(c), F.lit(d)))
    assert conflict("The temperature is 72 degrees", "The temperature is 45 degrees") == "72 vs 45"
    assert conflict("5 members", "5 members", "team size", "team size") is None
    assert conflict("Has 5 members", "Has 8 items", "team", "inventory") is None
    assert conflict("large", "small", "team size", "team size") is None
    assert conflict("10, 9 and 3.5", "3.5 or 7") == "10, 9 vs 7"
    negated = lambda a, b: value(spark, T.negation_contradiction(F.lit(a), F.lit(b)))
    assert negated("the cache is warm", "the cache is not warm") and not negated("the cache is warm", "the cache is hot") and not negated("not here", "somewhere else")


def test_f6_f7_entities_and_categories(spark):
    entity = lambda content, concept="": value(spark, T.entity_name(F.lit(content), F.lit(concept)))
    assert entity("some content", "Sarah Chen") == "sarah chen" and entity("John Smith works at Microsoft", "") == "john smith"
    assert entity("") is None and entity("all lowercase words here") is None and entity("we met Ada, twice") == "ada"
    assert entity("Al-Hassan met O'Brien Smith") == "o'brien smith"
    category = lambda t: value(spark, T.memory_category(F.lit(t), F.lit("")))
    assert [category(t) for t in ("how to bake", "we PLAN it", "it happened", "water is wet")] == ["procedural", "prospective", "episodic", "semantic"]


EPISODES = [
    "Sarah Chen joined the platform team. She leads the caching project.", "The deploy failed because the migration timed out; the rollback succeeded.", "We adopted Rust for the memory library, and we dropped the Python backend.",
    "Kuzu stores facts as nodes. Kuzu stores relationships as edges.", "The incident was caused by a config typo.", "Sarah Chen joined the platform team. She leads the caching project.",
    "Retrieval uses Graph RAG. No ML embeddings are required.", "The team agreed to weekly reviews, and the team agreed to pair on migrations.",
]


def test_f11_o82_golden_yield(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(EPISODES)], "node_id string, content string")
    assert tuple(measure.fact_yield(df).first()) == (13, 7)
    assert measure.distil_corpus(df).count() == 13
    facts = lambda t: value(spark, T.distilled_facts(F.lit(t)))
    assert facts("Pi is 3.14 exactly. Really, it is?! Yes.") == ["Pi is 3.14 exactly", "Really, it is"]
    assert facts("one two, and three four five six, and a b c") == ["one two, and three four five six", "a b c"]
    assert facts(None) == [] and facts("  ") == []


def test_f12_f13_f14_f15(spark):
    key = lambda *a: value(spark, T.pattern_key(*(F.lit(x).cast("string") for x in a)))
    assert [key("doc", "broken", None), key("doc", None, "tutorial_1.md"), key("doc", None, "readme.md"), key("doc", None, "x.py"), key(None, None, None)] == ["doc_broken", "tutorial_doc", "readme_doc", "doc", "unknown"]
    text = "key AKIA" + "ABCDEFGHIJKLMNOP and ghp_" + "a1" * 20 + " password=hunter2 here"
    assert value(spark, T.scrub(F.lit(text))) == "key [REDACTED] and [REDACTED] [REDACTED] here" and value(spark, T.has_credentials(F.lit(text)))
    assert value(spark, T.scrub(F.lit("nothing here"))) == "nothing here" and not value(spark, T.has_credentials(F.lit("nothing here")))
    cost = lambda q: value(spark, T.query_cost(F.lit(q)))
    assert cost("SELECT * FROM experiences") == 31 and cost("SELECT * FROM experiences JOIN x LIMIT 5") == 16
    safe = lambda q: value(spark, T.safe_query(F.lit(q)))
    assert safe("SELECT updated_at FROM t") and not safe("SELECT 1; DROP TABLE t") and not safe("UPDATE t SET x = 1") and not safe("SELECT 1 UNION SELECT 2")
    assert value(spark, T.safe_cypher(F.lit("MATCH (n) RETURN n"))) and not value(spark, T.safe_cypher(F.lit("MATCH (n) DETACH DELETE n")))


def test_f16_capabilities(spark):
    c = Capabilities(scope="global_read", allowed_types=("success", "pattern"))
    assert c.can_store("pattern") and not c.can_retrieve("pattern") and not c.can_retrieve("failure") and c.can_access("cross_session_read") and not c.can_access("global_write")
    for bad in ({"scope": "x"}, {"allowed_types": ("y",)}, {"max_query_cost": 0}):
        with pytest.raises(ValueError):
            Capabilities(**bad)
    secure = SecureExperiences(spark.createDataFrame([], "experience_id string, experience_type string, context string, outcome string, confidence double, timestamp timestamp, tags array<string>"), Capabilities(allowed_types=("success",)))
    rows = [("e1", "success", "token=abc123 leaked", "ok", 0.5, None, None), ("e2", "failure", "x", "y", 0.5, None, []), ("e3", "success", "", "y", 0.5, None, [])]
    good, rejected = secure.add(spark.createDataFrame(rows, secure.df.schema))
    assert [(r.experience_id, r.context, r.tags) for r in good.collect()] == [("e1", "[REDACTED] leaked", ["credential_scrubbed"])]
    assert {(r.experience_id, r.error) for r in rejected.collect()} == {("e2", "type not permitted"), ("e3", "blank context")}
    assert secure.validated("SELECT x FROM t LIMIT 1") and pytest.raises(NotPermitted, secure.validated, "DROP TABLE t") and pytest.raises(NotPermitted, secure.search, "q", "failure")


def test_f19_creative_ideas(spark):
    assert creative.transitions(spark).count() == 19 and [s for s in vocab.TRANSITIONS if creative.is_terminal(s)] == ["Rejected", "ImplementationCompleted"]
    with pytest.raises(ValueError):
        creative.parse_status("Done")


def test_o38_porter():
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "vietnamization": "vietnam", "triplicate": "triplic", "formalize": "formal", "hopeful": "hope", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil"}
    assert {w: porter(w) for w in known} == known


def test_o75_o76_patterns(spark):
    rows = [(f"d{i}", "doc", "broken", None, i) for i in range(5)] + [(f"x{i}", "other", None, None, i) for i in range(2)] + [(f"y{i}", "third", None, None, i) for i in range(3)]
    df = spark.createDataFrame(rows, "discovery_id string, type string, link_type string, file string, seen_at int")
    found = {r.pattern_key: r for r in patterns.detect(df).collect()}
    assert {k: (r.n, r.confidence) for k, r in found.items()} == {"doc_broken": (5, 0.95), "third": (3, 0.8)} and found["doc_broken"].examples == ["d0", "d1", "d2", "d3", "d4"]
    outcomes = spark.createDataFrame([("third", False)] * 10, "pattern_key string, success boolean")
    revised = {r.pattern_key: r.confidence for r in patterns.validate(patterns.detect(df), outcomes).collect()}
    assert revised["third"] == pytest.approx(0.8 * (0.7 - 0.1)) and revised["doc_broken"] == 0.95
    known = spark.createDataFrame([("Pattern 'third' again",)], "context string")
    assert [r.pattern_key for r in patterns.recognise(df, known).collect()] == ["doc_broken"]
