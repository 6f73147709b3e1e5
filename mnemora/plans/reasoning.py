"""Queries over joins, ranking, graphs, text functions and lifecycle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..operators import creative, dedup, experiences, federation, graphstore, hierarchical, measure, patterns, recall, security, similarity
from ..streaming import intent_log
from . import sql as S
from .lineage import shared_folder
from .registry import query
from .stores import at, edges_of, nodes_of
from .tables import Views

ASKED = "the of is worthless river"


@query("o54_search_join", """WITH i AS (SELECT DISTINCT experience_id, unnest(string_split_regex(lower(context || ' ' || outcome), '\\s+')) AS word
    FROM experiences)
    SELECT e.experience_id, e.confidence FROM experiences e JOIN i USING (experience_id) WHERE i.word = 'purchase' AND e.experience_type = 'pattern'
    AND e.confidence >= 0.5""")
def _(v: Views) -> DataFrame:
    index = v.experiences.select("experience_id", F.explode(T.plain_tokens(F.concat_ws(" ", "context", "outcome"))).alias("word"))
    wanted = v.experiences.where("experience_type = 'pattern' and confidence >= 0.5").select("experience_id", "confidence")
    return wanted.join(index.where("word = 'purchase'").select("experience_id"), "experience_id")


@query("o55_query_neighbors", """WITH w AS (SELECT source_id AS here, target_id AS there, edge_type, 0 AS side FROM edges UNION ALL SELECT target_id,
    source_id, edge_type, 1 FROM edges),
    r AS (SELECT *, row_number() OVER (PARTITION BY here ORDER BY side, edge_type, there) AS n FROM w WHERE here[1] = 'N') SELECT here AS start_id,
    there AS node_id, edge_type, side FROM r WHERE n <= 50""")
def _(v: Views) -> DataFrame:
    nodes = nodes_of(v)
    return graphstore.query_neighbors(
        nodes, edges_of(v), nodes.where("node_type = 'nation'"), direction="both"
    ).select("start_id", "node_id", "edge_type", "side")


_PAIRS = f"""p AS MATERIALIZED (SELECT node_id, agent_id, {S.tokens('content')} AS w, list_distinct(list_transform(tags, lambda t: trim(lower(t)))) AS t,
    {S.tokens('concept')} AS c FROM facts),
    s AS (SELECT a.node_id AS a, b.node_id AS b,
    ({S.jaccard('a.w', 'b.w')}) * 0.5 + ({S.jaccard('a.t', 'b.t')}) * 0.2 + ({S.jaccard('a.c', 'b.c')}) * 0.3 AS score FROM p a
    JOIN p b ON a.agent_id = b.agent_id AND a.node_id < b.node_id)"""


@query("o56_similar_pairs", f"WITH {_PAIRS} SELECT a, b, round(score, 6) AS score FROM s WHERE score >= 0.6")
def _(v: Views) -> DataFrame:
    return similarity.similar_pairs(v.facts).select("a", "b", F.round("score", 6).alias("score"))


@query(
    "o60_unlinked_pairs",
    f"""WITH {_PAIRS} SELECT a, b FROM s WHERE score >= 0.6 AND NOT EXISTS (SELECT 1 FROM links l WHERE edge_type = 'SIMILAR_TO' AND least(source_id,
    target_id) = a AND greatest(source_id, target_id) = b)"""
)
def _(v: Views) -> DataFrame:
    return similarity.unlinked(similarity.similar_pairs(v.facts), v.links).select("a", "b")


@query(
    "o103_link_similar",
    f"""WITH {_PAIRS} SELECT a AS source_id, b AS target_id, round(score, 4) AS similarity_score FROM s WHERE score >= 0.6 UNION ALL SELECT b, a,
    round(score, 4) FROM s WHERE score >= 0.6"""
)
def _(v: Views) -> DataFrame:
    return similarity.link_similar(v.facts).select("source_id", "target_id", "similarity_score")


def _orders(v: Views) -> DataFrame:
    """Orders as facts about their customer, numbered in time."""
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return v.orders.select(
        F.concat(F.lit("o"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("node_id"), F.lit("agent").alias("agent_id"), F.concat(
            F.lit("customer"), F.col("o_custkey").cast("string"), F.lit(" total")
        ).alias("concept"),
        F.concat(F.lit("the total is "), F.floor("o_totalprice").cast("string")).alias("content"), F.concat(
            F.lit('{"temporal_index": '), number.cast("string"), F.lit("}")
        ).alias("metadata"), F.array().cast("array<string>").alias("tags"),
    )


@query("o57_detect_supersedes", """WITH o AS (SELECT 'o' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS node_id,
    'customer' || CAST(o_custkey AS VARCHAR) AS k, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS n, row_number()
    OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
    c AS (SELECT a.node_id AS new_id, b.node_id AS old_id, a.n AS na, b.n AS nb, a.k AS ka, b.k AS kb, b.i AS ib, a.i AS ia, row_number()
    OVER (PARTITION BY a.node_id ORDER BY b.i DESC, b.node_id DESC) AS r FROM o a JOIN o b ON contains(b.k, a.k) AND b.i < a.i)
    SELECT new_id, old_id, 'Updated values: ' || na || ' vs ' || nb AS reason, 'index ' || ib || ' -> ' || ia AS temporal_delta FROM c WHERE r <= 20
    AND na <> nb""")
def _(v: Views) -> DataFrame:
    return hierarchical.detect_supersedes(_orders(v))


@query("o58_provenance_labels", "SELECT f.node_id, e.source_label FROM facts f LEFT JOIN episodes e ON f.source_id = e.node_id")
def _(v: Views) -> DataFrame:
    return hierarchical.attach_provenance(v.facts, v.episodes).select("node_id", "source_label")


@query(
    "o59_mark_superseded",
    """SELECT f.node_id, s.newer AS superseded_by, CASE WHEN s.newer IS NOT NULL THEN greatest(0.1, confidence * 0.5) ELSE confidence END AS confidence
    FROM facts f LEFT JOIN (SELECT target_id, min(source_id) AS newer FROM links WHERE edge_type = 'SUPERSEDES'
    GROUP BY target_id) s ON s.target_id = f.node_id"""
)
def _(v: Views) -> DataFrame:
    return hierarchical.mark_superseded(v.facts, v.links).select("node_id", "superseded_by", "confidence")


@query("o74_duplicates_by_hash", """SELECT agent_id, sha256(concept || chr(31) || content) AS key, list(node_id ORDER BY created_at,
    node_id)[1] AS representative_id,
    array_to_string(list(node_id ORDER BY created_at, node_id), ',') AS members, count(*) AS n FROM facts WHERE NOT archived GROUP BY 1, 2
    HAVING count(*) > 1""")
def _(v: Views) -> DataFrame:
    return dedup.find_duplicates(v.facts).select("agent_id", "key", "representative_id", F.array_join("fact_ids", ",").alias("members"), "n")


@query("o74_duplicates_by_key", """SELECT agent_id, dedup_key AS key, array_to_string(list(node_id ORDER BY created_at, node_id), ',') AS members,
    count(*) AS n
    FROM facts WHERE NOT archived AND dedup_key IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def _(v: Views) -> DataFrame:
    return dedup.find_duplicates(v.facts, by="key").select("agent_id", "key", F.array_join("fact_ids", ",").alias("members"), "n")


@query("o74_duplicates_by_similarity")
def _(v: Views) -> DataFrame:
    return dedup.find_duplicates(v.facts, by="similarity").select("agent_id", "key", F.array_join("fact_ids", ",").alias("members"), "n")


_KEY = "CASE WHEN link_type IS NOT NULL THEN type || '_' || link_type WHEN file LIKE '%.md' THEN CASE WHEN contains(file, '_') THEN split_part(file, '_', 1) ELSE regexp_replace(file, '\\.md$', '') END || '_' || type ELSE type END"


@query(
    "o75_detect_patterns",
    f"""WITH k AS (SELECT *, {_KEY} AS pattern_key FROM discoveries) SELECT pattern_key, count(*) AS n, CAST(round(least(0.5 + 0.1 * count(*), 0.95),
    6) AS DOUBLE) AS confidence, array_to_string(list(discovery_id ORDER BY seen_at, discovery_id)[1:5], ',') AS examples FROM k GROUP BY 1
    HAVING count(*) >= 3"""
)
def _(v: Views) -> DataFrame:
    return patterns.detect(v.discoveries).select(
        "pattern_key", "n", F.round("confidence", 6).alias("confidence"), F.array_join("examples", ",").alias("examples")
    )


@query("o76_validate_patterns", f"""WITH k AS (SELECT *, {_KEY} AS pattern_key FROM discoveries), d AS (SELECT pattern_key, least(0.5 + 0.1 * count(*),
    0.95) AS confidence, count(*) FILTER (discovery_id LIKE '%3') AS good, count(*) FILTER (discovery_id LIKE '%7') AS failed FROM k GROUP BY 1
    HAVING count(*) >= 3)
    SELECT pattern_key, round(CASE WHEN good + failed > 0 THEN least(greatest(confidence * (0.7 + 0.4 * good / (good + failed) - CASE
    WHEN failed > 5 THEN least((failed - 5) * 0.02, 0.2) ELSE 0 END), 0.1), 0.95) ELSE confidence END, 6) AS confidence FROM d""")
def _(v: Views) -> DataFrame:
    keyed = v.discoveries.select("discovery_id", T.pattern_key(F.col("type"), F.col("link_type"), F.col("file")).alias("pattern_key"))
    outcomes = keyed.where("discovery_id like '%3' or discovery_id like '%7'").select(
        "pattern_key", F.col("discovery_id").endswith("3").alias("success")
    )
    return patterns.validate(patterns.detect(v.discoveries), outcomes).select("pattern_key", F.round("confidence", 6).alias("confidence"))


@query(
    "o77_recognise_patterns",
    f"""WITH k AS (SELECT {_KEY} AS pattern_key FROM discoveries) SELECT pattern_key, count(*) AS n FROM k WHERE pattern_key NOT IN ('click',
    'tutorial_view') GROUP BY 1 HAVING count(*) >= 5"""
)
def _(v: Views) -> DataFrame:
    known = v.spark.sql("SELECT explode(array(\"Pattern 'click' seen\", \"Pattern 'tutorial_view' seen\", 'other')) AS context")
    return patterns.recognise(v.discoveries, known, 5).select("pattern_key", "n")


@query(
    "o79_confirmation_counts",
    "SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS node_id, count(*) AS confirmation_count FROM customer GROUP BY c_nationkey"
)
def _(v: Views) -> DataFrame:
    return federation.confirmation_counts(federation.assertions(v.edges.where("edge_type = 'LIVES_IN'"), "CONFIRMED_BY"))


@query("o80_precision_at_k", f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, node_id) AS pos FROM facts)
    SELECT avg(CASE WHEN list_has_any({S.plain("concept || ' ' || content")}, {S.plain(S.text(ASKED))}) THEN 1.0 ELSE 0.0 END) AS precision FROM r
    WHERE pos <= 50""")
def _(v: Views) -> DataFrame:
    ranked = v.facts.orderBy(F.desc("confidence"), "node_id").limit(50)
    return measure.precision_at_k(ranked.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("confidence"), "node_id"))), ASKED, 50)


@query("o81_labelled_precision", """WITH r AS (SELECT concept AS query, node_id AS item_id, row_number() OVER (PARTITION BY concept
    ORDER BY confidence DESC, node_id) AS pos FROM facts), l AS (SELECT source AS query, 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS item_id
    FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
    SELECT q.query, (SELECT count(*) FROM r WHERE r.query = q.query AND pos <= 10 AND item_id IN (SELECT item_id FROM l)) / 10 AS precision_at_k,
    coalesce(1 / (SELECT min(pos) FROM r WHERE r.query = q.query AND item_id IN (SELECT item_id FROM l)), 0) AS reciprocal_rank
    FROM (SELECT DISTINCT query FROM l) q""")
def _(v: Views) -> DataFrame:
    ranked = measure.with_positions(
        v.facts.select(F.col("concept").alias("query"), F.col("node_id").alias("item_id"), "confidence"), "query", F.desc("confidence"), "item_id"
    )
    labels = v.documents.join(v.labels.where("quality = 1"), "doc_id", "left_semi").select(
        F.col("source").alias("query"), F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("item_id")
    )
    return measure.labelled_precision(ranked, labels, 10)


@query(
    "o82_fact_yield_baseline",
    r"""WITH n AS (SELECT trim(regexp_replace(content, '\s+', ' ', 'g'), ' .,;:!?') AS t FROM episodes) SELECT count(DISTINCT lower(t)) FILTER (len(string_split(t, ' ')) >= 3) AS baseline FROM n"""
)
def _(v: Views) -> DataFrame:
    return measure.fact_yield(v.episodes).select("baseline")


@query("o82_fact_yield")
def _(v: Views) -> DataFrame:
    return measure.fact_yield(v.episodes)


def _age(at: str) -> str:
    return f"greatest(epoch(TIMESTAMP '2026-01-01') - floor(epoch({at})), 0)"


_NEAR = f"""t AS (SELECT node_id, agent_id, {S.jaccard(S.plain("concept || ' ' || content"), S.plain(S.text(ASKED)))} AS s FROM facts UNION ALL
    SELECT node_id, agent_id, {S.jaccard(S.plain('content'), S.plain(S.text(ASKED)))} FROM episodes),
    w AS (SELECT source_id AS here, target_id AS there FROM links WHERE edge_type IN ('SIMILAR_TO', 'DERIVES_FROM') UNION ALL SELECT target_id,
    source_id FROM links WHERE edge_type = 'SIMILAR_TO'),
    g AS (SELECT here AS node_id, max(b.s) AS best FROM w JOIN t a ON a.node_id = here JOIN t b ON b.node_id = there AND a.agent_id = b.agent_id
    GROUP BY here)"""


@query("o84_recall_facts_ranked", f"""WITH {_NEAR} SELECT f.node_id,
    round({S.jaccard(S.plain("concept || ' ' || content"), S.plain(S.text(ASKED)))} + 0.7 * confidence + 0.5 * importance + 0.4 * pow(2,
    -{_age('coalesce(last_accessed_at, created_at)')} / 604800.0) + 0.3 * ln(1 + usage_count) + 0.6 * coalesce(g.best, 0), 6) AS score
    FROM facts f LEFT JOIN g USING (node_id) WHERE NOT archived AND superseded_by IS NULL AND confidence >= 0.1 ORDER BY score DESC, confidence DESC,
    f.node_id LIMIT 40""")
def _(v: Views) -> DataFrame:
    found = recall.recall_facts(v.facts, ASKED, at(), recall.RecallOptions(limit=40, min_confidence=0.1), v.links, v.episodes)
    return found.select("node_id", F.round("score", 6).alias("score"))


@query("o110_read_plane", f"""WITH {_NEAR} SELECT f.node_id,
    round({S.jaccard(S.plain("concept || ' ' || content"), S.plain(S.text(ASKED)))} + 0.7 * confidence + 0.5 * importance + 0.4 * pow(2,
    -{_age('coalesce(last_accessed_at, created_at)')} / 604800.0) + 0.3 * ln(1 + usage_count) + 0.6 * coalesce(g.best, 0), 6) AS score
    FROM facts f LEFT JOIN g USING (node_id) WHERE NOT archived AND superseded_by IS NULL AND confidence >= 0.1 ORDER BY score DESC, confidence DESC,
    f.node_id LIMIT 10000""")
def _(v: Views) -> DataFrame:
    options = recall.read_only(recall.RecallOptions(limit=1_000_000, min_confidence=0.1))
    found = recall.recall_facts(v.facts, ASKED, at(), options, v.links, v.episodes)
    return found.select("node_id", F.round("score", 6).alias("score"))


@query("o85_recall_episodes_ranked", f"""WITH t AS (SELECT node_id, agent_id,
    {S.jaccard(S.plain("concept || ' ' || content"), S.plain(S.text(ASKED)))} AS s FROM facts), g AS (SELECT e.node_id, max(s) AS best FROM links l
    JOIN t ON t.node_id = source_id JOIN episodes e ON e.node_id = target_id AND e.agent_id = t.agent_id WHERE edge_type = 'DERIVES_FROM'
    GROUP BY e.node_id)
    SELECT e.node_id, round({S.jaccard(S.plain('content'), S.plain(S.text(ASKED)))} + 0.4 * pow(2,
    -{_age('created_at')} / 604800.0) + 0.6 * coalesce(best, 0), 6) AS score FROM episodes e LEFT JOIN g USING (node_id) WHERE NOT compressed
    ORDER BY score DESC, temporal_index DESC, e.node_id LIMIT 30""")
def _(v: Views) -> DataFrame:
    found = recall.recall_episodes(v.episodes, ASKED, at(), recall.RecallOptions(limit=30), v.links, v.facts)
    return found.select("node_id", F.round("score", 6).alias("score"))


@query(
    "o86_recall_primitives",
    f"""SELECT node_id, round({S.jaccard(S.plain('content'), S.plain(S.text(ASKED)))}, 6) AS jaccard, round(pow(2, -{_age('created_at')} / 86400.0),
    6) AS decay, round(ln(1 + usage_count), 6) AS boost FROM facts"""
)
def _(v: Views) -> DataFrame:
    age = F.greatest(F.unix_timestamp(at()) - F.unix_timestamp("created_at"), F.lit(0)).cast("double")
    return v.facts.select(
        "node_id", F.round(recall.keyword_jaccard(F.col("content"), ASKED), 6).alias("jaccard"),
        F.round(recall.exp_decay(age, 86400.0), 6).alias("decay"), F.round(recall.usage_boost(F.col("usage_count")), 6).alias("boost")
    )


@query("o87_reasons", """SELECT node_id, array_to_string(list_filter([CASE WHEN confidence > 0 THEN printf('confidence %.4f', 0.7 * confidence) END, CASE
    WHEN importance > 0 THEN printf('importance %.4f', 0.5 * importance) END, CASE WHEN usage_count > 0 THEN printf('usage %.4f',
    0.3 * ln(1 + usage_count)) || ' (n=' || usage_count || ')' END], lambda x: x IS NOT NULL), '; ') AS reasons
    FROM facts WHERE NOT archived AND superseded_by IS NULL ORDER BY round(0.7 * confidence + 0.5 * importance + 0.3 * ln(1 + usage_count), 12) DESC,
    confidence DESC, node_id LIMIT 25""")
def _(v: Views) -> DataFrame:
    options = recall.RecallOptions(limit=25, half_life_seconds=0.0, max_graph_hops=0)
    return recall.recall_facts(v.facts, "zzz", at(), options).select("node_id", F.array_join("reasons", "; ").alias("reasons"))


@query("o88_graph_proximity", f"WITH {_NEAR} SELECT node_id, round(best, 6) AS best FROM g WHERE best > 0")
def _(v: Views) -> DataFrame:
    scored = v.facts.select(
        "node_id", "agent_id", recall.keyword_jaccard(F.concat_ws(" ", "concept", "content"), ASKED).alias("s")
    ).unionAll(v.episodes.select("node_id", "agent_id", recall.keyword_jaccard(F.col("content"), ASKED)))
    walked = v.links.where("edge_type in ('SIMILAR_TO', 'DERIVES_FROM')").select(
        F.col("source_id").alias("here"), F.col("target_id").alias("there"), "edge_type"
    )
    walked = walked.unionAll(v.links.where("edge_type = 'SIMILAR_TO'").select("target_id", "source_id", "edge_type"))
    return recall.graph_scores(scored, walked, 1).select("node_id", F.round("best", 6).alias("best"))


@query("o89_retrieve_relevant", f"""SELECT experience_id, round(least({S.jaccard(S.tokens('context'), S.tokens(S.text('error of user number 12')))} *
    CASE experience_type WHEN 'pattern' THEN 1.5 WHEN 'insight' THEN 1.3 ELSE 1 END * (0.5 + confidence * 0.5) * greatest(0.7,
    1 - greatest(floor((epoch(TIMESTAMP '2026-01-01') - epoch(timestamp)) / 86400), 0) / 90 * 0.3), 1), 6) AS relevance
    FROM experiences ORDER BY relevance DESC, experience_id LIMIT 50""")
def _(v: Views) -> DataFrame:
    return experiences.retrieve_relevant(v.experiences, "error of user number 12", at(), 50).select(
        "experience_id", F.round("relevance", 6).alias("relevance")
    )


@query(
    "o90_rerank",
    f"""SELECT node_id, round(len(list_intersect({S.tokens("concept || ' ' || content")}, {
        S.tokens(S.text('when was the worthless river changed'))
    })) / len({S.tokens(S.text('when was the worthless river changed'))}) + CASE WHEN usage_count > 3 AND len({S.tokens("concept || ' ' || content")}) > 0 THEN 0.15 ELSE 0 END, 6) AS score FROM facts ORDER BY score DESC, node_id LIMIT 100"""
)
def _(v: Views) -> DataFrame:
    rows = v.facts.select(
        "node_id", F.col("node_id").alias("pos"), F.col("concept").alias("context"), F.col("content").alias("outcome"),
        (F.col("usage_count") > 3).alias("temporal")
    )
    return recall.rerank(rows, "when was the worthless river changed", 100).select("node_id", F.round("score", 6).alias("score"))


@query("o91_expand", f"""WITH s AS (SELECT node_id, row_number() OVER (ORDER BY confidence DESC, node_id) - 1 AS rank FROM facts ORDER BY confidence DESC,
    node_id LIMIT 20), k AS (SELECT *, {S.jaccard(S.short_tokens("concept || ' ' || content"), S.short_tokens(S.text(ASKED)))} AS kw FROM facts),
    n AS (SELECT target_id AS node_id, arg_min(weight, rank) AS sim FROM links JOIN s ON source_id = s.node_id WHERE edge_type = 'SIMILAR_TO'
    AND target_id NOT IN (SELECT node_id FROM s) GROUP BY target_id)
    SELECT node_id, round(((20 - rank) / 20 * 0.6 + kw * 0.4) * confidence, 6) AS score FROM s JOIN k USING (node_id) UNION ALL SELECT node_id,
    round((sim * 0.5 + kw * 0.5) * confidence, 6) FROM n JOIN k USING (node_id) ORDER BY score DESC, node_id LIMIT 30""")
def _(v: Views) -> DataFrame:
    top = v.facts.orderBy(F.desc("confidence"), "node_id").limit(20)
    seeds = top.select("node_id", (F.row_number().over(Window.orderBy(F.desc("confidence"), "node_id")) - 1).alias("rank"))
    return recall.expand(
        v.facts, seeds, v.links.withColumnRenamed("weight", "similarity_score"), ASKED, 30
    ).select("node_id", F.round("score", 6).alias("score"))


@query(
    "o92_subgraph_rank",
    """SELECT node_id, round(confidence * (0.5 + 0.5 * (CAST(contains(t, 'worthless') AS INT) + CAST(contains(t, 'river') AS INT) + CAST(contains(t,
    'the') AS INT)) / 3), 6) AS rank FROM (SELECT *, lower(concept || ' ' || content) AS t FROM facts)"""
)
def _(v: Views) -> DataFrame:
    return v.facts.select("node_id", F.round(hierarchical.subgraph_rank("the worthless river of"), 6).alias("rank"))


@query(
    "o93_vector_search",
    """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings
    ORDER BY vec_id LIMIT 1) AS DOUBLE[])), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 20"""
)
def _(v: Views) -> DataFrame:
    asked = v.embeddings.orderBy("vec_id").limit(1).first()
    facts = v.embeddings.select(F.col("vec_id").alias("node_id"), "embedding", F.lit(1.0).alias("confidence"))
    return recall.vector_search(facts, asked.embedding if asked else [1.0], 20).select(
        F.col("node_id").alias("vec_id"), F.round("similarity", 6).alias("similarity")
    )


@query(
    "o95_expert_agents", "SELECT agent_id, trust FROM hive_agents WHERE contains(lower(domain), 'nation_1') ORDER BY trust DESC, agent_id LIMIT 10"
)
def _(v: Views) -> DataFrame:
    return federation.expert_agents(v.hive_agents, "Nation_1", 10).select("agent_id", "trust")


@query(
    "o96_union_of_kept",
    "SELECT experience_id FROM experiences WHERE confidence > 0.95 UNION SELECT experience_id FROM experiences WHERE experience_type = 'insight'"
)
def _(v: Views) -> DataFrame:
    return v.experiences.where("confidence > 0.95").select("experience_id").union(
        v.experiences.where("experience_type = 'insight'").select("experience_id")
    ).distinct()


@query(
    "o97_one_and_two_hops",
    """SELECT source_id, target_id FROM links WHERE edge_type = 'SIMILAR_TO' UNION ALL SELECT a.source_id, b.target_id FROM links a
    JOIN links b ON a.target_id = b.source_id WHERE a.edge_type = 'SIMILAR_TO' AND b.edge_type = 'SIMILAR_TO'"""
)
def _(v: Views) -> DataFrame:
    similar = v.links.where("edge_type = 'SIMILAR_TO'").select("source_id", "target_id")
    second = similar.withColumnRenamed("target_id", "via").join(similar.withColumnRenamed("source_id", "via"), "via").select("source_id", "target_id")
    return similar.unionAll(second)


def _two_stores(v: Views) -> list[tuple[str, DataFrame]]:
    nodes = nodes_of(v).withColumn("properties", F.map_filter("properties", lambda k, _: k != "balance"))
    return [
        ("local", nodes.where("graph_origin = 'local'")),
        (
            "hive",
            nodes.where("node_type <> 'region'").withColumn(
                "node_id", F.when(F.col("node_type") == "nation", F.concat(F.lit("h"), "node_id")).otherwise(F.col("node_id"))
            )
        )
    ]


_MERGED = """WITH e AS (SELECT node_id, node_type, name, segment, 'local' AS source, 0 AS place FROM nodes WHERE graph_origin = 'local' UNION ALL SELECT
    CASE WHEN node_type = 'nation' THEN 'h' ELSE '' END || node_id, node_type, name, segment, 'hive', 1 FROM nodes WHERE node_type <> 'region'),
    a AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY place) = 1), b AS (SELECT * FROM a QUALIFY row_number()
    OVER (PARTITION BY node_type, name, segment ORDER BY place, node_id) = 1)"""


@query("o98_federated_merge", f"{_MERGED} SELECT node_id, source FROM b")
def _(v: Views) -> DataFrame:
    return federation.merge(_two_stores(v)).select("node_id", "source")


@query(
    "o104_federated_query",
    f"""{_MERGED} SELECT node_id, source, CAST(CASE source WHEN 'local' THEN 1.0 ELSE 0.9 END AS DOUBLE) AS confidence, (SELECT count(*) FROM customer
    WHERE 'N' || CAST(c_nationkey AS VARCHAR) = b.node_id) AS confirmation_count FROM b WHERE node_type = 'nation' AND contains(lower(name), 'nation')
    ORDER BY confidence DESC, confirmation_count DESC, node_id LIMIT 15"""
)
def _(v: Views) -> DataFrame:
    confirmed = federation.confirmation_counts(federation.assertions(v.edges.where("edge_type = 'LIVES_IN'"), "CONFIRMED_BY"))
    return federation.federated_query(_two_stores(v), "nation", ["name"], "nation", confirmed, 15)


@query(
    "o104_boundary_crossing",
    """SELECT c.source_id AS start_id, bool_or(a.graph_origin <> b.graph_origin OR coalesce(b.graph_origin <> r.graph_origin,
    false)) AS crossed_boundaries FROM edges c JOIN nodes a ON a.node_id = c.source_id JOIN nodes b ON b.node_id = c.target_id LEFT
    JOIN edges p ON p.source_id = c.target_id LEFT JOIN nodes r ON r.node_id = p.target_id WHERE c.edge_type = 'LIVES_IN' GROUP BY 1"""
)
def _(v: Views) -> DataFrame:
    nodes = nodes_of(v)
    return federation.crosses_boundary(graphstore.traverse(nodes, edges_of(v), nodes.where("node_type = 'customer'"), max_hops=2))


@query("o99_traverse", """WITH RECURSIVE r AS (SELECT node_id AS start_id, node_id, 0 AS hops FROM nodes WHERE node_type = 'supplier' UNION
    SELECT start_id, w.there, hops + 1 FROM r JOIN (SELECT source_id AS here, target_id AS there FROM edges WHERE edge_type <> 'LIVES_IN' UNION ALL
    SELECT target_id, source_id FROM edges WHERE edge_type <> 'LIVES_IN') w ON w.here = r.node_id WHERE hops < 3)
    SELECT start_id, node_id, min(hops) AS hops FROM r WHERE hops > 0 GROUP BY ALL""")
def _(v: Views) -> DataFrame:
    nodes = nodes_of(v)
    return graphstore.distances_from(nodes, edges_of(v), nodes.where("node_type = 'supplier'"), ["BASED_IN", "PART_OF"], 3, "both")


@query("o100_retrieve_subgraph")
def _(v: Views) -> DataFrame:
    nodes, _ = hierarchical.retrieve_subgraph(v.facts, v.links, v.episodes, "worthless river the")
    return nodes.select("node_id", F.round("rank_score", 6).alias("rank_score"), "source_label", "superseded_by")


@query(
    "o101_temporal_chains",
    """WITH RECURSIVE s AS (SELECT source_id, target_id FROM links WHERE edge_type = 'SUPERSEDES'), r AS (SELECT source_id AS head_id, 0 AS position,
    source_id AS node_id FROM s WHERE source_id NOT IN (SELECT target_id FROM s) UNION ALL SELECT head_id, position + 1, target_id FROM r
    JOIN s ON s.source_id = r.node_id) SELECT * FROM r"""
)
def _(v: Views) -> DataFrame:
    edges = v.links.withColumn("properties", F.create_map(F.lit("reason"), F.lit("newer")))
    return graphstore.chains(edges).select("head_id", "position", "node_id")


@query("o102_provenance", "SELECT source_id AS node_id, target_id AS episode_id FROM links WHERE edge_type = 'DERIVES_FROM'")
def _(v: Views) -> DataFrame:
    return graphstore.provenance(v.links)


@query(
    "o105_agent_trust",
    """SELECT w.agent_id, CASE WHEN h.trust IS NULL THEN 0.0 WHEN h.trust >= 0 THEN 0.5 ELSE h.trust END AS trust
    FROM (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS agent_id FROM supplier UNION ALL SELECT 'stranger') w LEFT JOIN hive_agents h USING (agent_id)"""
)
def _(v: Views) -> DataFrame:
    changes = v.hive_agents.where("trust >= 0").select("agent_id", F.lit(0.5).alias("trust"), F.lit(1).alias("at"))
    wanted = v.hive_agents.select("agent_id").unionAll(v.spark.range(1).select(F.lit("stranger")))
    return federation.agent_trust(federation.update_trust(v.hive_agents, changes), wanted)


# -- text functions --------------------------------------------------------------------------------


def _joined(c: object) -> object:
    return F.array_join(F.array_sort(c), " ")


@query("f1_tokens", f"SELECT node_id, md5(array_to_string(list_sort({S.tokens('content')}), ' ')) AS tokens FROM facts")
def _(v: Views) -> DataFrame:
    return v.facts.select("node_id", F.md5(_joined(T.tokens(F.col("content")))).alias("tokens"))


@query("f2_short_tokens", f"SELECT node_id, md5(array_to_string(list_sort({S.short_tokens('content')}), ' ')) AS tokens FROM facts")
def _(v: Views) -> DataFrame:
    return v.facts.select("node_id", F.md5(_joined(T.short_tokens(F.col("content")))).alias("tokens"))


def _next_to(facts: DataFrame, columns: list[str]) -> DataFrame:
    """Facts beside their agent's next one (``<column>_b``): the order is found over ids alone, so no task reads an agent's texts."""
    ids = facts.select("node_id", F.lead("node_id").over(Window.partitionBy("agent_id").orderBy("node_id")).alias("next_id"))
    after = facts.select(F.col("node_id").alias("next_id"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return facts.select("node_id", *columns).join(ids, "node_id").join(after, "next_id", "left")


@query(
    "f3_similarity",
    f"""WITH b AS (SELECT *, lead(content) OVER w AS content_b, lead(concept) OVER w AS concept_b, lead(tags) OVER w AS tags_b
    FROM facts WINDOW w AS (PARTITION BY agent_id ORDER BY node_id)) SELECT node_id,
    round({S.jaccard(S.tokens('content'), S.tokens('content_b'))} * 0.5 + {S.jaccard('list_distinct(tags)', 'list_distinct(tags_b)')} * 0.2 + {S.jaccard(S.tokens('concept'), S.tokens('concept_b'))} * 0.3, 6) AS score FROM b WHERE content_b IS NOT NULL"""
)
def _(v: Views) -> DataFrame:
    b = _next_to(v.facts, ["content", "concept", "tags"]).where("content_b is not null")
    return b.select(
        "node_id",
        F.round(
            T.similarity(F.col("content"), F.col("concept"), F.col("tags"), F.col("content_b"), F.col("concept_b"), F.col("tags_b")), 6
        ).alias("score")
    )


@query("f4_numeric_contradiction", r"""WITH b AS (SELECT node_id, list_sort(list_distinct(regexp_extract_all(content, '\b\d+(?:\.\d+)?\b'))) AS x, list_sort(list_distinct(regexp_extract_all(lead(content) OVER w, '\b\d+(?:\.\d+)?\b'))) AS y FROM facts WINDOW w AS (PARTITION BY concept ORDER BY node_id)),
    u AS (SELECT node_id, list_filter(x, lambda i: NOT list_contains(y, i)) AS p, list_filter(y, lambda i: NOT list_contains(x, i)) AS q FROM b)
    SELECT node_id, array_to_string(p, ', ') || ' vs ' || array_to_string(q, ', ') AS conflict FROM u WHERE len(p) > 0 AND len(q) > 0""")
def _(v: Views) -> DataFrame:
    after = F.lead("content").over(Window.partitionBy("concept").orderBy("node_id"))
    b = v.facts.select("node_id", "content", "concept", after.alias("content_b"))
    return b.select(
        "node_id", T.numeric_contradiction(F.col("content"), F.col("content_b"), F.col("concept"), F.col("concept")).alias("conflict")
    ).where("conflict is not null")


@query("f5_negation_contradiction", f"""WITH b AS (SELECT node_id, {S.plain('content')} AS x, {S.plain('lead(content) OVER w')} AS y
    FROM facts WINDOW w AS (PARTITION BY agent_id ORDER BY node_id)), n AS (SELECT {S.strings(vocab.NEGATION_WORDS)} AS no)
    SELECT node_id, len(list_filter(list_intersect(x, y), lambda i: NOT list_contains(no, i))) >= 2 AND list_has_any(x, no) <> list_has_any(y,
    no) AS contradicts FROM b, n""")
def _(v: Views) -> DataFrame:
    return _next_to(v.facts, ["content"]).select("node_id", T.negation_contradiction(F.col("content"), F.col("content_b")).alias("contradicts"))


@query("f6_entity_name")
def _(v: Views) -> DataFrame:
    return v.facts.select("node_id", T.entity_name(F.col("content"), F.col("concept")).alias("entity"))


_CLASS = "CASE " + " ".join(
    f"WHEN {' OR '.join(f'contains(t, {S.text(w)})' for w in ws)} THEN '{name}'" for name, ws in (
        ("procedural", vocab.PROCEDURAL_WORDS), ("prospective", vocab.PROSPECTIVE_WORDS), ("episodic", vocab.EPISODIC_WORDS)
    )
) + " ELSE 'semantic' END"


@query("f7_memory_category", f"SELECT node_id, {_CLASS} AS category FROM (SELECT node_id, lower(content || ' ' || concept) AS t FROM facts)")
def _(v: Views) -> DataFrame:
    return v.facts.select("node_id", T.memory_category(F.col("content"), F.col("concept")).alias("category"))


@query("f8_content_hash", "SELECT node_id, sha256(concept || chr(31) || content) AS hash FROM facts")
def _(v: Views) -> DataFrame:
    return v.facts.select("node_id", T.content_hash(F.col("concept"), F.col("content")).alias("hash"))


@query(
    "f9_node_hash",
    """SELECT node_id, substr(sha256(node_type || '|' || array_to_string(list_filter(['balance=' || balance, 'name=' || name, 'segment=' || segment],
    lambda x: x IS NOT NULL), '|')), 1, 16) AS hash FROM nodes"""
)
def _(v: Views) -> DataFrame:
    return nodes_of(v).select("node_id", T.node_hash(F.col("node_type"), F.col("properties")).alias("hash"))


@query("f11_distil")
def _(v: Views) -> DataFrame:
    return measure.distil(v.episodes)


@query("f11_distil_corpus")
def _(v: Views) -> DataFrame:
    return measure.distil_corpus(v.episodes)


@query("f12_pattern_key", f"SELECT discovery_id, {_KEY} AS pattern_key FROM discoveries")
def _(v: Views) -> DataFrame:
    return v.discoveries.select("discovery_id", T.pattern_key(F.col("type"), F.col("link_type"), F.col("file")).alias("pattern_key"))


def _duck_scrub(x: str) -> str:
    for p in vocab.CREDENTIALS:
        x = f"regexp_replace({x}, {S.text(p)}, {S.text(vocab.REDACTED)}, 'g')"
    return x


@query(
    "f13_scrub",
    f"""SELECT node_id, md5({_duck_scrub('content')}) AS scrubbed,
    {' OR '.join(f'regexp_matches(content, {S.text(p)})' for p in vocab.CREDENTIALS)} AS found FROM facts"""
)
def _(v: Views) -> DataFrame:
    return v.facts.select("node_id", F.md5(T.scrub(F.col("content"))).alias("scrubbed"), T.has_credentials(F.col("content")).alias("found"))


_SQLS = (
    "SELECT * FROM experiences", "SELECT * FROM a JOIN b ON a.x = b.x LIMIT 5", "SELECT x FROM (SELECT y FROM t) ORDER BY x", "select x from t; drop table t", "DELETE FROM t", """SELECT updated_at FROM t LIMIT 1""", """SELECT a FROM b JOIN c JOIN d UNION SELECT 1""", """SELECT x FROM sqlite_master LIMIT 2""", "/* hi */ select x -- delete\n from t limit 1", "",
)


@query(
    "f14_f15_query_checks",
    """SELECT * FROM (VALUES (0, 31, true), (1, 16, true), (2, 26, true), (3, 21, false), (4, 1, false), (5, 1, true), (6, 31, false), (7, 1, false), (8,
    1, true), (9, 1, false)) t(i, cost, safe)"""
)
def _(v: Views) -> DataFrame:
    rows = v.spark.range(1).select(F.posexplode(F.array(*map(F.lit, _SQLS))).alias("i", "sql"))
    return rows.select("i", T.query_cost(F.col("sql")).alias("cost"), T.safe_query(F.col("sql")).alias("safe"))


@query("f16_visible_types", "SELECT experience_type, count(*) AS n FROM experiences WHERE experience_type IN ('success', 'insight') GROUP BY 1")
def _(v: Views) -> DataFrame:
    secure = security.SecureExperiences(v.experiences, security.Capabilities(allowed_types=("success", "insight", "pattern")))
    return secure.visible().groupBy("experience_type").agg(F.count("*").alias("n"))


@query(
    "o115_secure_search",
    """SELECT experience_id FROM experiences WHERE experience_type IN ('success', 'insight') AND (contains(lower(context),
    'number 3') OR contains(lower(outcome), 'number 3')) ORDER BY timestamp DESC, experience_id LIMIT 40"""
)
def _(v: Views) -> DataFrame:
    secure = security.SecureExperiences(v.experiences, security.Capabilities(allowed_types=("success", "insight", "pattern")))
    return secure.search("number 3", limit=40).select("experience_id")


@query("f17_llm_context")
def _(v: Views) -> DataFrame:
    nodes, edges = hierarchical.retrieve_subgraph(v.facts, v.links, v.episodes, "worthless river the")
    return hierarchical.to_llm_context(nodes, edges.withColumn("edge_type", F.lit("SIMILAR_TO")), "worthless river the")


@query("f18_f20_json_round_trip", "SELECT experience_id, confidence FROM experiences WHERE experience_type = 'pattern'")
def _(v: Views) -> DataFrame:
    chosen = v.experiences.where("experience_type = 'pattern'")
    return experiences.from_map(experiences.as_map(chosen), "experience_id string, confidence double")


@query(
    "f19_transitions",
    f"""WITH s AS (SELECT unnest({S.strings(vocab.TRANSITIONS)}) AS x) SELECT a.x AS from_status, b.x AS to_status,
    list_contains({S.strings(f'{a}>{b}' for a, bs in vocab.TRANSITIONS.items() for b in bs)}, a.x || '>' || b.x) AS allowed, b.x IN ('Rejected',
    'ImplementationCompleted') AS terminal FROM s a, s b"""
)
def _(v: Views) -> DataFrame:
    names = F.array(*map(F.lit, vocab.TRANSITIONS))
    return creative.judged(v.spark.range(1).select(F.explode(names).alias("from_status")).select("from_status", F.explode(names).alias("to_status")))


# -- lifecycle and log -----------------------------------------------------------------------------


@query("o33_supersede", "SELECT node_id FROM facts WHERE archived OR node_id IN (SELECT target_id FROM links WHERE edge_type = 'SUPERSEDES')")
def _(v: Views) -> DataFrame:
    changes = v.links.where("edge_type = 'SUPERSEDES'").select(
        F.col("target_id").alias("old_id"), F.col("source_id").alias("new_id"), F.lit("newer").alias("reason")
    )
    return dedup.supersede(v.facts, v.links, changes)[0].where("archived").select("node_id")


def _halves(v: Views) -> tuple[DataFrame, DataFrame]:
    return v.facts.where("usage_count < 3"), v.facts.where("usage_count >= 3")


@query("o111_upsert_by_hash", """WITH e AS (SELECT node_id, agent_id, sha256(concept || chr(31) || content) AS h, usage_count < 3 AS old, created_at
    FROM facts WHERE usage_count >= 3 OR NOT archived), d AS (SELECT *, first(node_id) OVER (PARTITION BY agent_id, h ORDER BY old DESC, created_at,
    node_id) AS target_id FROM e)
    SELECT node_id, CASE WHEN node_id = target_id THEN 'inserted' ELSE 'reused' END AS action, target_id FROM d WHERE NOT old""")
def _(v: Views) -> DataFrame:
    return dedup.upsert(*_halves(v))


@query("o111_upsert_by_key", """WITH e AS (SELECT *, sha256(concept || chr(31) || content) AS h, usage_count < 3 AS old FROM facts
    WHERE usage_count >= 3 OR NOT archived), l AS (SELECT *, lag(h) OVER (PARTITION BY agent_id, dedup_key ORDER BY old DESC, created_at,
    node_id) AS b FROM e WHERE dedup_key IS NOT NULL)
    SELECT node_id, CASE WHEN b IS NULL THEN 'inserted' WHEN b <> h THEN 'superseded' ELSE 'reused' END AS action FROM l WHERE NOT old UNION ALL
    SELECT node_id, 'inserted' FROM e WHERE NOT old AND dedup_key IS NULL""")
def _(v: Views) -> DataFrame:
    return dedup.upsert(*_halves(v), mode="key").select("node_id", "action")


@query("o111_upsert_by_similarity")
def _(v: Views) -> DataFrame:
    return dedup.upsert(*_halves(v), mode="similarity")


@query("o112_retention", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY agent_id, concept ORDER BY archived, importance DESC,
    coalesce(last_accessed_at, created_at) DESC, node_id) AS n FROM facts),
    c AS (SELECT *, importance < 0.3 OR coalesce(expires_at <= TIMESTAMP '2026-01-01', false) OR (concept = 'src3'
    AND epoch(TIMESTAMP '2026-01-01') - epoch(coalesce(last_accessed_at, created_at)) >= 1000000) OR n > 10 OR superseded_by IS NOT NULL AS cand
    FROM r)
    SELECT node_id, CASE WHEN NOT cand THEN 'keep' WHEN NOT archived THEN 'archive' WHEN importance >= 0.3 AND node_id IN (SELECT source_id FROM links
    WHERE edge_type = 'DERIVES_FROM') THEN 'keep' ELSE 'delete' END AS action FROM c""")
def _(v: Views) -> DataFrame:
    policy = dedup.RetentionPolicy(0.3, 10, {"src3": 1_000_000}, True)
    return dedup.retention(v.facts, graphstore.provenance(v.links), at(), policy)


def _intents(v: Views) -> DataFrame:
    kinds = F.array(*map(F.lit, vocab.INTENT_KINDS))
    place = F.concat(
        F.lpad(F.floor(F.col("event_id") / 1000).cast("string"), 20, "0"), F.lit(":"), F.lpad((F.col("event_id") % 1000).cast("string"), 20, "0")
    )
    return v.events.select(
        place.alias("offset"), F.concat(F.lit("i"), F.floor(F.col("event_id") / 2).cast("string")).alias("intent_id"),
        F.element_at(kinds, (F.col("event_id") % 8 + 1).cast("int")).alias("kind"), F.lit("agent").alias("agent_name"),
        F.floor(F.col("event_id") / 700 - F.col("event_id") % 2).alias("epoch"), F.lit("{}").alias("payload")
    )


@query("o107_o109_fenced_intents", """WITH i AS (SELECT event_id, 'i' || CAST(event_id // 2 AS VARCHAR) AS intent_id,
    CAST(floor(event_id / 700 - event_id % 2) AS BIGINT) AS epoch FROM events), f AS (SELECT *, greatest(0, max(epoch)
    OVER (ORDER BY event_id)) AS top FROM i)
    SELECT intent_id, min(event_id) AS first_event FROM f WHERE epoch >= top GROUP BY 1""")
def _(v: Views) -> DataFrame:
    found = intent_log.unapplied(intent_log.fenced(intent_log.validated(_intents(v))), v.spark.createDataFrame([], intent_log.LEDGER))
    first = F.split_part("offset", F.lit(":"), F.lit(1)).cast("long") * 1000 + F.split_part("offset", F.lit(":"), F.lit(2)).cast("long")
    return found.select("intent_id", first.alias("first_event"))


@query("o108_prune_ledger", "SELECT count(*) AS n FROM events WHERE event_id >= 2500")
def _(v: Views) -> DataFrame:
    return intent_log.prune(_intents(v), intent_log.offset(2, 500)).agg(F.count("*").alias("n"))


@query(
    "o106_read_next",
    """SELECT 'i' || CAST(event_id // 2 AS VARCHAR) AS intent_id, event_id FROM events WHERE event_id > 300 ORDER BY event_id LIMIT 200"""
)
def _(v: Views) -> DataFrame:
    log = intent_log.IntentLog(v.spark, f"{shared_folder(v.spark)}/log-{uuid.uuid4().hex}")
    log.append(_intents(v))
    place = F.split_part("offset", F.lit(":"), F.lit(1)).cast("long") * 1000 + F.split_part("offset", F.lit(":"), F.lit(2)).cast("long")
    return log.read_next(intent_log.offset(0, 300), 200).select("intent_id", place.alias("event_id"))
