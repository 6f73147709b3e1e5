"""Ranked recall: weighted signals, graph proximity, expansion, reranking, vector search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..plans.lineage import materialise


@dataclass(frozen=True)
class RecallOptions:
    limit: int = 10
    min_confidence: float = 0.0
    include_archived: bool = False
    include_superseded: bool = False
    max_graph_hops: int = 1
    half_life_seconds: float = vocab.HALF_LIFE_SECONDS
    weights: Mapping[str, float] = field(default_factory=lambda: dict(vocab.RECALL_WEIGHTS))


def keyword_jaccard(text: Column, query: str) -> Column:
    return T.jaccard(T.plain_tokens(text), T.query_tokens(query, "plain"))


def exp_decay(age_seconds: Column, half_life_seconds: float) -> Column:
    return F.lit(0.0) if half_life_seconds <= 0 else F.pow(F.lit(2.0), -age_seconds / half_life_seconds)


def usage_boost(usage: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(usage, F.lit(0)), F.lit(0)).cast("double"))


def _age(at: Column, now: Column) -> Column:
    return F.greatest(F.unix_timestamp(now) - F.unix_timestamp(at), F.lit(0)).cast("double")


def graph_scores(scored: DataFrame, links: DataFrame, max_hops: int) -> DataFrame:
    """``(node_id, best, via, hop)``: the best neighbour's keyword similarity over its distance.

    ``scored``: node_id, agent_id and keyword similarity ``s`` of everything that may be a neighbour;
    ``links``: here, there, edge_type as they may be walked. Neighbours of other agents neither score nor
    are walked through. Only neighbours that share a word with the query score; scores walk from them back to the
    facts, the best two per node and hop, so the work grows with the edges whatever the degree of a hub.
    """
    hops = min(max_hops, vocab.MAX_GRAPH_HOPS)
    own = scored.select("node_id", "agent_id", "s")
    walk = links.join(own.select(F.col("node_id").alias("here"), F.col("agent_id").alias("here_agent")), "here").join(
        own.select(F.col("node_id").alias("there"), F.col("agent_id").alias("there_agent"), "s"), "there"
    )
    walk = walk.where("here_agent = there_agent and here <> there").select("here", "there", "edge_type", "s")
    if hops == 1:
        reached = walk.where("s > 0").select(F.col("here").alias("start"), "there", "edge_type", "s", F.lit(1).alias("hop"))
    else:
        # per node the two best ends within so many steps, as one of them may be the node asked about: a hub passes on no more
        steps, reached = walk.select("here", "there").distinct(), None
        ends = walk.where("s > 0").select("here", F.col("there").alias("end"), "edge_type", "s")
        for hop in range(1, hops + 1):
            once = ends.groupBy("here", "end").agg(F.min("edge_type").alias("edge_type"), F.max("s").alias("s"))
            order = Window.partitionBy("here").orderBy(F.desc("s"), F.desc("edge_type"), "end")
            best = materialise(once.withColumn("n", F.row_number().over(order)).where("n <= 2").drop("n"))
            level = best.select(F.col("here").alias("start"), F.col("end").alias("there"), "edge_type", "s", F.lit(hop).alias("hop"))
            reached = level if reached is None else reached.unionAll(level)
            if hop < hops:
                passed = best.withColumnRenamed("here", "there")
                ends = steps.join(passed, "there").where("end <> here").select("here", "end", "edge_type", "s")
    value = F.col("s") / F.col("hop")
    best = reached.where("s > 0").groupBy(F.col("start").alias("node_id")).agg(
        F.max_by(
            F.struct(value.alias("best"), F.col("edge_type").alias("via"), F.col("hop")),
            F.struct(value.alias("v"), (-F.col("hop")).alias("h"), F.col("edge_type"))
        ).alias("g")
    )
    return best.select("node_id", "g.best", "g.via", "g.hop")


def _ranked(rows: DataFrame, now: Column, options: RecallOptions, proximity: DataFrame | None, ties: Sequence[Column]) -> DataFrame:
    """Ranks rows with columns node_id, s, conf, imp, at, uses; adds ``score`` and ``reasons``."""
    w = options.weights
    if proximity is not None:
        rows = rows.join(proximity, "node_id", "left")
    else:
        rows = rows.withColumns({"best": F.lit(0.0), "via": F.lit(None).cast("string"), "hop": F.lit(None).cast("int")})
    rows = rows.withColumn("age", _age(F.col("at"), now))
    terms = {
        "text": w["text"] * F.col("s"), "confidence": w["confidence"] * F.col("conf"), "importance": w["importance"] * F.col("imp"),
        "recency": w["recency"] * exp_decay(
            F.col("age"), options.half_life_seconds
        ), "usage": w["usage"] * usage_boost(F.col("uses")), "graph": w["graph"] * F.coalesce("best", F.lit(0.0)),
    }
    rows = rows.withColumns({f"t_{k}": F.coalesce(v, F.lit(0.0)) for k, v in terms.items()})
    four = lambda c: F.format_string("%.4f", c)
    details = {
        "text": F.concat(F.lit(" (jaccard="), four(F.col("s")), F.lit(")")), "confidence": F.lit(""), "importance": F.lit(""), "recency": F.concat(
            F.lit(" (age="), F.col("age").cast("long").cast("string"), F.lit("s)")
        ),
        "usage": F.concat(F.lit(" (n="), F.col("uses").cast("string"), F.lit(")")), "graph": F.concat(
            F.lit(" ("), "via", F.lit(" hop"), F.col("hop").cast("string"), F.lit(")")
        ),
    }
    score = F.lit(0.0)
    for k in terms:
        score = score + F.col(f"t_{k}")
    top = rows.withColumn("score", score).orderBy(F.desc("score"), *ties).limit(options.limit)
    reasons = F.filter(
        F.array(*(F.when(F.col(f"t_{k}") > 0, F.concat(F.lit(f"{k} "), four(F.col(f"t_{k}")), details[k])) for k in terms)), lambda r: r.isNotNull()
    )
    return top.withColumn("reasons", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("baseline (no positive signals)"))))


def _with_texts(top: DataFrame, table: DataFrame, columns: Sequence[str], ties: Sequence[Column]) -> DataFrame:
    """The few ranked rows with columns of their table, which is scanned again for these ids alone."""
    few = F.broadcast(top.select("node_id", "score", "reasons"))  # at most the limit asked for
    return table.select("node_id", *columns).join(few, "node_id").orderBy(F.desc("score"), *ties)


def _fact_text() -> Column:
    return F.concat_ws(" ", "concept", "content")


def recall_facts(
    facts: DataFrame, query: str, now: Column, options: RecallOptions = RecallOptions(), edges: DataFrame | None = None,
    episodes: DataFrame | None = None
) -> DataFrame:
    """Facts by score, then confidence, then id: ``node_id, concept, content, confidence, score, reasons``.

    Neighbours are similar facts (both ways) and the episodes that a fact derives from. With a graph term
    texts are compared once, into a narrow table of scores that all joins use.
    """
    narrow = facts.select(
        "node_id", "agent_id", keyword_jaccard(_fact_text(), query).alias("s"), "confidence", F.col("confidence").alias("conf"), F.coalesce(
            "importance", "confidence"
        ).alias("imp"),
        F.coalesce(
            "last_accessed_at", "created_at"
        ).alias("at"), F.coalesce("usage_count", F.lit(0)).alias("uses"), F.coalesce(
            "archived", F.lit(False)
        ).alias("archived"), F.col("superseded_by").isNotNull().alias("superseded"),
    )
    proximity = None
    if edges is not None and options.max_graph_hops > 0:
        narrow = materialise(narrow)
        scored = narrow.select("node_id", "agent_id", "s")
        if episodes is not None:
            scored = scored.unionAll(episodes.select("node_id", "agent_id", keyword_jaccard(F.col("content"), query)))
        similar = edges.where("edge_type = 'SIMILAR_TO'")
        links = similar.select(F.col("source_id").alias("here"), F.col("target_id").alias("there"), "edge_type").unionAll(
            similar.select(F.col("target_id").alias("here"), F.col("source_id").alias("there"), "edge_type")
        )
        links = links.unionAll(
            edges.where("edge_type = 'DERIVES_FROM'").select(F.col("source_id").alias("here"), F.col("target_id").alias("there"), "edge_type")
        )
        proximity = graph_scores(scored, links, options.max_graph_hops)
    kept = narrow.where(F.col("confidence") >= options.min_confidence)
    kept = kept if options.include_archived else kept.where(~F.col("archived"))
    kept = kept if options.include_superseded else kept.where(~F.col("superseded"))
    ties = [F.desc("confidence"), F.col("node_id")]
    return _with_texts(
        _ranked(kept, now, options, proximity, ties), facts, ["concept", "content", "confidence"], ties
    ).select("node_id", "concept", "content", "confidence", "score", "reasons")


def recall_episodes(
    episodes: DataFrame, query: str, now: Column, options: RecallOptions = RecallOptions(), edges: DataFrame | None = None,
    facts: DataFrame | None = None
) -> DataFrame:
    """Uncompressed episodes by score, then newest, then id; neighbours are the facts derived from them."""
    narrow = episodes.select(
        "node_id", "agent_id", "temporal_index", "compressed", keyword_jaccard(F.col("content"), query).alias("s"), F.lit(0.0).alias("conf"),
        F.lit(0.0).alias("imp"), F.col("created_at").alias("at"), F.lit(0).alias("uses")
    )
    proximity = None
    if edges is not None and facts is not None and options.max_graph_hops > 0:
        narrow = materialise(narrow)
        scored = narrow.select("node_id", "agent_id", "s").unionAll(facts.select("node_id", "agent_id", keyword_jaccard(_fact_text(), query)))
        links = edges.where("edge_type = 'DERIVES_FROM'").select(F.col("target_id").alias("here"), F.col("source_id").alias("there"), "edge_type")
        proximity = graph_scores(scored, links, options.max_graph_hops)
    ties = [F.desc("temporal_index"), F.col("node_id")]
    top = _ranked(narrow.where(~F.col("compressed")), now, options, proximity, ties)
    return _with_texts(top, episodes, ["content", "temporal_index"], ties).select("node_id", "content", "temporal_index", "score", "reasons")


def rerank(facts: DataFrame, query: str, top_k: int = 0) -> DataFrame:
    """Facts (pos, context, outcome, temporal) by the share of query words they hold; ties and misses keep their order.

    ``temporal`` marks facts with a place in time: they gain 0.15 where the query asks about time.
    """
    asked = T.query_tokens(query)
    about_time = any(cue in query.lower() for cue in vocab.TEMPORAL_CUES)
    said = T.tokens(F.concat_ws(" ", "context", "outcome"))
    bonus = F.when(F.col("temporal") & (F.size(said) > 0), 0.15).otherwise(0.0) if about_time else F.lit(0.0)
    share = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, said)) / F.size(asked) + bonus).otherwise(0.0)
    ordered = facts.withColumn("score", share).orderBy(F.desc("score"), "pos")
    return ordered.limit(top_k) if top_k > 0 else ordered


def expand(facts: DataFrame, seeds: DataFrame, edges: DataFrame, query: str, limit: int = 10, min_confidence: float = 0.0) -> DataFrame:
    """``(node_id, score)``: seeds (node_id, rank from 0) and their neighbours over SIMILAR_TO, best first.

    A seed scores by rank and keywords, a neighbour by edge and keywords, both times confidence.
    Of several edges to a neighbour that of the first seed counts.
    """
    asked = T.query_tokens(query, "short")
    kw = lambda empty: F.when(F.size(asked) > 0, T.jaccard(asked, T.short_tokens(F.concat_ws(" ", "concept", "content")))).otherwise(empty)
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    own = seeds.withColumn("n", n).join(facts, "node_id")
    scored = own.select("node_id", (((F.col("n") - F.col("rank")) / F.col("n") * 0.6 + kw(0.5) * 0.4) * F.col("confidence")).alias("score"))
    near = edges.where("edge_type = 'SIMILAR_TO'").join(seeds.select(F.col("node_id").alias("source_id"), "rank"), "source_id")
    near = near.groupBy(F.col("target_id").alias("node_id")).agg(
        F.min_by("similarity_score", "rank").alias("sim")
    ).join(seeds.select("node_id"), "node_id", "left_anti")
    found = near.join(facts.where(F.col("confidence") >= min_confidence), "node_id")
    others = found.select("node_id", ((F.coalesce("sim", F.lit(0.5)) * 0.5 + kw(0.3) * 0.5) * F.col("confidence")).alias("score"))
    return scored.unionAll(others).orderBy(F.desc("score"), "node_id").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where one is null, empty or zero, or lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def vector_search(facts: DataFrame, query: Sequence[float], limit: int = 10, min_confidence: float = 0.0) -> DataFrame:
    """``(node_id, similarity)``: facts with the most similar embeddings, exactly: filtered before the cut."""
    vector = F.array(*(F.lit(float(x)) for x in query))
    scored = facts.where(F.col("confidence") >= min_confidence).select("node_id", cosine(F.col("embedding"), vector).alias("similarity"))
    return scored.where("similarity is not null").orderBy(F.desc("similarity"), "node_id").limit(limit)


def read_only(options: RecallOptions) -> RecallOptions:
    """What a reader who may not write can ask for: at most :data:`vocab.MAX_READ_LIMIT` facts."""
    return replace(options, limit=min(options.limit, vocab.MAX_READ_LIMIT))


def access_updates(hits: DataFrame, now: Column) -> DataFrame:
    """``(node_id, accessed_at)``: the accesses that a recall counts, for ``memory.record_access``."""
    return hits.select("node_id", now.alias("accessed_at"))
