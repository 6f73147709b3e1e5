"""The knowledge graph over facts: storing, searching, aggregating, subgraph retrieval and its text form.

Knowledge: node_id, agent_id, concept, content, confidence, source_id, tags, metadata (JSON), created_at,
entity_name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..plans.lineage import materialise, written
from . import similarity
from .memory import keywords

DEFAULT_CONFIDENCE = 0.8


def _json(column: str, key: str) -> Column:
    return F.get_json_object(column, f"$.{key}")


def _lower_contains(column: str, needle: Column) -> Column:
    return F.coalesce(F.contains(F.lower(F.col(column)), needle), F.lit(False))


def knowledge(new: DataFrame) -> DataFrame:
    """Adds what storing derives: category, entity name, default confidence."""
    return new.withColumns({
        "category": T.memory_category(F.col("content"), F.col("concept")), "entity_name": T.entity_name(F.col("content"), F.col("concept")),
        "confidence": F.coalesce(F.col("confidence").try_cast("double"), F.lit(DEFAULT_CONFIDENCE)),
    })


def store_knowledge(existing: DataFrame, new: DataFrame, episodes: DataFrame, threshold: float = vocab.LINK_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``(rows to append, edges to append (source_id, target_id, edge_type, weight, reason))``.

    New facts derive from the episodes they name, supersede older contradicted facts and are linked with
    similar ones, new or old.
    """
    rows = knowledge(new)
    derives = rows.join(episodes.select(F.col("node_id").alias("source_id")), "source_id", "left_semi")
    edge = lambda source, target, kind, weight, reason: (
        F.col(source).alias(
            "source_id"
        ), F.col(target).alias("target_id"), F.lit(kind).alias("edge_type"), weight.alias("weight"), reason.alias("reason"),
    )
    derives = derives.select(*edge("node_id", "source_id", "DERIVES_FROM", F.col("confidence"), F.lit("episode")))
    superseded = detect_supersedes(existing, new=rows).select(*edge("new_id", "old_id", "SUPERSEDES", F.lit(1.0), F.col("reason")))
    near = similarity.similar_pairs(existing, threshold, new=rows)
    similar = near.select(*edge("a", "b", "SIMILAR_TO", F.round("score", 4), F.lit("similarity")))
    return rows, derives.unionAll(superseded).unionAll(similar)


#: Positions on a long time line are counted in blocks of so many temporal indices.
_BLOCK = 4096
#: A key's time line of at most so many facts is one sorted array; a longer one goes through blocks.
_LINE = 4096


def _superseding(pairs: DataFrame) -> DataFrame:
    """Of pairs (``new``, ``old``) those on a shared word of three letters and more whose numbers conflict."""
    said = F.arrays_overlap(F.split("new.subject", " "), F.split("old.subject", " "))
    shared = F.when(F.col("new.subject") == F.col("old.subject"), F.col("new.subject") != "").otherwise((F.col("new.subject") != "") & said)
    numbers = F.col("new.numbers"), F.col("old.numbers")
    return pairs.where(shared & T.numbers_conflict(*numbers)).select(
        F.col("new.node_id").alias("new_id"), F.col("old.node_id").alias("old_id"),
        F.concat(F.lit("Updated values: "), T.conflict_text(*numbers)).alias("reason"),
        F.concat(F.lit("index "), F.col("old.idx").cast("string"), F.lit(" -> "), F.col("new.idx").cast("string")).alias("temporal_delta"),
    )


def detect_supersedes(facts: DataFrame, candidates: int = vocab.SUPERSEDE_CANDIDATES, new: DataFrame | None = None) -> DataFrame:
    """``(new_id, old_id, reason, temporal_delta)``: facts that contradict an older one on the same subject.

    Old and new share an agent; the first word of the new concept stands in the old concept; the old temporal
    index is positive and lower; numbers conflict. A new fact looks at its ``candidates`` closest
    predecessors in time. The join is on agent and first word, through the old concept's word pieces, so no
    fact meets all others. With ``new`` (rows that aren't in ``facts``) only those look back, at facts old and new: the
    others are met through the keys of new ones alone. Facts go to their keys as arrays, one per concept; of a
    long time line only the last ``candidates`` facts of a temporal index go on, as no fact can look at more of them.
    """
    index = F.coalesce(_json("metadata", "temporal_index").try_cast("bigint"), F.lit(0))
    # of a text only its numbers matter: they are taken once, and no text is shuffled
    slim = lambda df, asks: df.select(
        "node_id", "agent_id", T.spaced(F.col("concept")).alias("concept"), T.numbers(F.col("content")).alias("numbers"), index.alias("idx"),
        F.lit(asks).alias("asks")
    )
    every = slim(facts, True) if new is None else slim(facts, False).unionAll(slim(new, True))
    # a concept is its words by now; an item is what is left of a fact, its key the word by which it asks
    item = F.struct(
        "idx", "node_id", "numbers", F.array_join(F.filter(F.split("concept", " "), lambda w: F.length(w) > 2), " ").alias("subject"),
        F.when(F.col("asks") & (F.col("concept") != ""), F.substring_index("concept", " ", 1)).alias("key")
    ).alias("item")
    ready = written(every.where("idx > 0").select("agent_id", "concept", item), "facts")
    keys = ready.where("item.key is not null").groupBy("agent_id", F.col("item.key").alias("key")).agg(F.max("item.idx").alias("last"))
    # which old concepts contain which keys: every piece of a word that is as long as a key is, joined on equality
    sizes = F.array(*(F.lit(r.n) for r in keys.select(F.length("key").alias("n")).distinct().orderBy("n").collect())).cast("array<int>")
    cut = lambda w, n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))
    cuts = F.transform(F.split("concept", " "), lambda w: F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length(w)), lambda n: cut(w, n))))
    concepts = ready.groupBy("agent_id", "concept").agg(F.count("*").alias("n"))
    pieces = concepts.select("agent_id", "concept", "n", F.explode(F.array_distinct(F.flatten(cuts))).alias("key"))
    sized = pieces.join(keys.hint("shuffle_hash"), ["agent_id", "key"]).withColumn("size", F.sum("n").over(Window.partitionBy("agent_id", "key")))
    is_long = F.col("size") > _LINE
    inside = written(
        sized.groupBy("agent_id", "concept").agg(
            F.collect_list(F.when(~is_long, F.col("key"))).alias("short"), F.collect_list(F.when(is_long, F.struct("key", "last"))).alias("long")
        ), "keys"
    )
    old = ready.join(inside, ["agent_id", "concept"])
    # a concept of too many facts has long keys only, so that no array is longer than a short time line
    by_concept = old.where(F.size("short") > 0).groupBy("agent_id", "concept").agg(F.first("short").alias("short"), F.collect_set("item").alias("items"))
    lines = by_concept.select("agent_id", F.explode("short").alias("key"), "items").groupBy("agent_id", "key").agg(
        F.sort_array(F.flatten(F.collect_list("items"))).alias("line")
    )
    asking = lines.select("line", F.col("line.idx").alias("at"), F.filter("line", lambda x: x["key"] == F.col("key")).alias("asking"))
    placed = asking.select("line", "at", F.explode("asking").alias("new"))
    # every fact stands on its own key's line: what is before the first of its index is older
    older = (F.array_position("at", F.col("new.idx")) - 1).cast("int")
    near = placed.select("new", "line", older.alias("older")).where("older > 0")
    recent = F.slice("line", F.greatest(F.col("older") - candidates + 1, F.lit(1)), F.least(F.col("older"), F.lit(candidates)))
    found = _superseding(near.select("new", F.explode(recent).alias("old")))
    far = _long_lines(ready, old, candidates)
    return found.unionAll(_superseding(far).distinct())


def _long_lines(ready: DataFrame, old: DataFrame, candidates: int) -> DataFrame:
    """``(new, old)`` of the keys with long time lines: every fact with its closest predecessors."""
    levels = old.select("agent_id", F.explode("long").alias("long"), "item").select("agent_id", "long.*", "item").where("item.idx <= last")
    latest = Window.partitionBy("agent_id", "key", "item.idx").orderBy(F.desc("item.node_id"))
    line = written(levels.withColumn("nth", F.row_number().over(latest)).where(F.col("nth") <= candidates).select("agent_id", "key", "item"), "lines")
    asks = ready.where("item.key is not null").select("agent_id", F.col("item.key").alias("key"), F.col("item").alias("new"))
    asks = asks.join(line.select("agent_id", "key").distinct(), ["agent_id", "key"], "left_semi")
    # where a new fact stands among the old ones of its key: counted by block of time, and within the block
    none = F.lit(None).cast(line.schema["item"].dataType)
    at = lambda who: [F.col(f"{who}.idx").alias("at"), F.col(f"{who}.node_id").alias("tie")]
    both = line.select("agent_id", "key", *at("item"), F.lit(1).alias("kind"), "item", none.alias("new")).unionByName(
        asks.select("agent_id", "key", *at("new"), F.lit(0).alias("kind"), none.alias("item"), "new")
    ).withColumn("block", F.floor(F.col("at") / _BLOCK))
    block = ["agent_id", "key", "block"]
    sums = both.groupBy(*block).agg(F.count("item").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("agent_id", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = Window.partitionBy(*block).orderBy("at", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.join(sums.select(*block, before.alias("before")), block).withColumn("pos", F.col("before") + F.count("item").over(order))
    wanted = F.sequence(F.greatest(F.col("pos") - candidates + 1, F.lit(1)), "pos")
    looking = counted.where("new is not null and pos > 0").select("agent_id", "key", "new", F.explode(wanted).alias("pos"))
    return looking.join(
        counted.where("item is not null").select("agent_id", "key", "pos", F.col("item").alias("old")), ["agent_id", "key", "pos"]
    ).select("new", "old")


def all_knowledge(facts: DataFrame, limit: int = 50, category: str | None = None) -> DataFrame:
    kept = facts if category is None else facts.where(F.coalesce(_json("metadata", "category"), F.lit("semantic")) == category)
    return kept.orderBy(F.desc("created_at"), "node_id").limit(limit)


def search_by_concept(facts: DataFrame, words: list[str], limit: int = 10) -> DataFrame:
    """``(node_id, keyword_pos)``: for every keyword of three letters and more, its first facts; a fact counts once, at its first keyword."""
    kept = [(i, w.lower()) for i, w in enumerate(words) if len(w) > 2]
    if not kept:
        return facts.limit(0).select("node_id", F.lit(0).alias("keyword_pos"))
    hits = F.filter(
        F.array(*(F.when(_lower_contains("concept", F.lit(w)) | _lower_contains("content", F.lit(w)), F.lit(i)) for i, w in kept)),
        lambda i: i.isNotNull()
    )
    per = facts.select("node_id", "confidence", F.explode(hits).alias("keyword_pos"))
    order = Window.partitionBy("keyword_pos").orderBy(F.desc("confidence"), "node_id")
    top = per.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    return top.groupBy("node_id").agg(F.min("keyword_pos").alias("keyword_pos"))


def retrieve_by_entity(facts: DataFrame, entity: str, limit: int = 20) -> DataFrame:
    """Facts whose entity name contains the entity; only where there is none, facts that mention it. One pass: the best tier present wins."""
    needle = F.lit(entity.lower())
    tier = F.when(_lower_contains("entity_name", needle), 1).when(_lower_contains("content", needle) | _lower_contains("concept", needle), 2)
    found = facts.withColumn("__tier", tier).where("__tier is not null").orderBy("__tier", F.desc("confidence"), "node_id").limit(limit)
    return found.withColumn("__best", F.min("__tier").over(Window.partitionBy(F.lit(1)))).where("__tier = __best").drop("__tier", "__best")


def aggregation(facts: DataFrame, kind: str, contains: str | None = None, limit: int = 10) -> DataFrame:
    """The aggregate ``kind``: count_total, count_entities, list_entities, count_concepts, list_concepts, count_by_concept, avg_confidence, top_concepts, by_category."""
    kept = facts if contains is None else facts.where(_lower_contains("concept", F.lit(contains.lower())))
    named = kept.where("concept is not null and concept not in ('', 'SUMMARY')")
    entities = facts.where("entity_name is not null and entity_name <> ''")
    if kind == "count_total":
        return kept.agg(F.count("*").alias("n"))
    if kind == "count_entities":
        return entities.agg(F.count_distinct("entity_name").alias("n"))
    if kind == "list_entities":
        return entities.select("entity_name").distinct().orderBy("entity_name")
    if kind == "count_concepts":
        return named.agg(F.count_distinct("concept").alias("n"))
    if kind == "list_concepts":
        return named.select("concept").distinct().orderBy("concept")
    if kind == "count_by_concept":
        return named.groupBy("concept").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concept")
    if kind == "avg_confidence":
        return kept.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))
    if kind == "top_concepts":
        return named.groupBy("concept").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concept").limit(limit)
    if kind == "by_category":
        return kept.groupBy(F.coalesce(_json("metadata", "category"), F.lit("semantic")).alias("category")).agg(F.count("*").alias("n"))
    raise ValueError(f"unknown aggregation: {kind!r}")


def statistics(semantic: DataFrame, episodic: DataFrame, edges: DataFrame) -> DataFrame:
    """``(what, n)``: rows of both tables and edges of each type."""
    rows = semantic.agg(F.count("*").alias("n")).select(F.lit("semantic_nodes").alias("what"), "n").unionAll(
        episodic.agg(F.count("*").alias("n")).select(F.lit("episodic_nodes").alias("what"), "n")
    )
    return rows.unionAll(edges.groupBy(F.concat(F.lower("edge_type"), F.lit("_edges")).alias("what")).agg(F.count("*").alias("n")))


def attach_provenance(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Adds ``source_label`` of the episode that a fact names as its source."""
    return facts.join(episodes.select(F.col("node_id").alias("source_id"), "source_label").dropDuplicates(["source_id"]), "source_id", "left")


def mark_superseded(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``superseded_by`` (the smallest successor); confidence of superseded facts halves, to 0.1 at least."""
    newer = edges.where("edge_type = 'SUPERSEDES'").groupBy(F.col("target_id").alias("node_id")).agg(F.min("source_id").alias("superseded_by"))
    marked = facts.drop("superseded_by").join(newer, "node_id", "left")
    return marked.withColumn(
        "confidence", F.when(F.col("superseded_by").isNotNull(), F.greatest(F.lit(0.1), F.col("confidence") * 0.5)).otherwise(F.col("confidence"))
    )


def subgraph_rank(query: str) -> Column:
    """Confidence times half and half the share of the query's words in concept and content."""
    words = list(dict.fromkeys(w for w in keywords(query) if len(w) > 2))
    if not words:
        return F.col("confidence") * 0.5
    text = F.lower(F.concat_ws(" ", "concept", "content"))
    hits = sum((F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    return F.col("confidence") * (0.5 + 0.5 * hits / len(words))


def retrieve_subgraph(
    facts: DataFrame, edges: DataFrame, episodes: DataFrame, query: str, max_depth: int = 2, max_nodes: int = 20
) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` around a query: seeds by entity and keyword, expanded over SIMILAR_TO, ranked.

    Seeds come in order of their first keyword; up to ``max_nodes`` nodes are seen, neighbours in order of
    seed, hop, weight and id; the ``max_nodes`` best remain, with provenance and supersession attached. Edges
    keep their true ends. Of a seed's neighbours in a hop only the first ``max_nodes`` beyond the number of seeds
    are followed, as later ones can't be among those seen: all that is held is bounded by ``max(3 * max_nodes, 60)`` seeds
    and so many neighbours of each, however many a hub has.
    """
    bound = max(3 * max_nodes, 60)
    entity = query.lower().strip()
    by_entity = facts.where(
        _lower_contains("entity_name", F.lit(entity))
    ).orderBy(F.desc("confidence"), "node_id").limit(bound).select("node_id", F.lit(-1).alias("keyword_pos"))
    by_word = search_by_concept(facts, keywords(query), bound)
    seeds = by_entity.unionAll(by_word).groupBy("node_id").agg(F.min("keyword_pos").alias("p")).orderBy("p", "node_id").limit(bound)
    seeds = seeds.withColumn("seed_pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("p", "node_id"))).select("node_id", "seed_pos")
    similar = edges.where("edge_type = 'SIMILAR_TO'").select("source_id", "target_id", "weight")
    seen = seeds.select("node_id", "seed_pos", F.lit(0).alias("hop"), F.lit(0.0).alias("w"))
    frontier = seeds.select(F.col("node_id").alias("source_id"), "seed_pos")
    nearest = Window.partitionBy("seed_pos").orderBy("v", "node_id")
    for hop in range(1, max_depth + 1):
        step = similar.join(F.broadcast(frontier), "source_id")
        reached = step.groupBy("seed_pos", F.col("target_id").alias("node_id")).agg(F.min(-F.col("weight")).alias("v"))
        reached = reached.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= bound + max_nodes)
        reached = reached.groupBy("node_id").agg(F.min(F.struct("seed_pos", "v")).alias("s"))
        seen = seen.unionAll(reached.select("node_id", "s.seed_pos", F.lit(hop).alias("hop"), (-F.col("s.v")).alias("w")))
        frontier = materialise(reached.select(F.col("node_id").alias("source_id"), "s.seed_pos"))
    first = seen.groupBy("node_id").agg(F.min(F.struct("hop", "seed_pos", (-F.col("w")).alias("v"))).alias("s"))
    budget = F.greatest(F.lit(max_nodes), F.sum(F.when(F.col("s.hop") == 0, 1).otherwise(0)).over(Window.partitionBy(F.lit(1))))
    place = F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy(
            F.when(F.col("s.hop") == 0, 0).otherwise(1), F.col("s.seed_pos"), F.col("s.hop"), F.col("s.v"), F.col("node_id")
        )
    )
    picked = first.orderBy(F.when(F.col("s.hop") == 0, 0).otherwise(1), "s.seed_pos", "s.hop", "s.v", "node_id").limit(bound + max_nodes)
    kept = picked.withColumns({"place": place, "budget": budget}).where("place <= budget").select("node_id")
    ranked = facts.join(
        F.broadcast(kept), "node_id", "left_semi"
    ).withColumn("rank_score", subgraph_rank(query)).orderBy(F.desc("rank_score"), "node_id").limit(max_nodes)
    nodes = mark_superseded(attach_provenance(ranked, episodes), edges)
    ids = nodes.select("node_id")
    walked = ids.join(seen.where(F.col("hop") < max_depth).select("node_id").distinct(), "node_id", "left_semi")
    inside = similar.join(F.broadcast(walked.withColumnRenamed("node_id", "source_id")), "source_id", "left_semi")
    inside = inside.join(F.broadcast(ids.withColumnRenamed("node_id", "target_id")), "target_id", "left_semi")
    return nodes, inside.select("source_id", "target_id", "weight").distinct()


def to_llm_context(nodes: DataFrame, edges: DataFrame, query: str, chronological: bool = False) -> DataFrame:
    """One row ``context``: facts, contradictions and relationships of a retrieved subgraph as text.

    ``nodes``: node_id, concept, content, confidence, source_label, metadata; ``edges``: source_id,
    target_id, edge_type, weight[, conflicting_values]. The text of a subgraph is one value, so its few rows meet.
    """
    time = F.when(_json("metadata", "source_date").isNotNull(), F.concat(F.lit(" [Date: "), _json("metadata", "source_date"), F.lit("]"))).when(
        _json("metadata", "temporal_order").isNotNull(), F.concat(F.lit(" [Time: "), _json("metadata", "temporal_order"), F.lit("]"))
    ).otherwise("")
    source = F.when(F.coalesce("source_label", F.lit("")) != "", F.concat(F.lit(" [Source: "), "source_label", F.lit("]"))).otherwise("")
    key = F.struct(
        F.coalesce(_json("metadata", "temporal_index").try_cast("bigint"), F.lit(999999)).alias("t"), "node_id"
    ) if chronological else F.struct((-F.col("confidence")).alias("t"), "node_id")
    line = F.concat(
        F.lit(". ["), F.coalesce("concept", F.lit("")), F.lit("]"), time if chronological else F.lit(""), source, F.lit(" "),
        F.coalesce("content", F.lit("")), F.lit(" (confidence: "), F.format_string("%.1f", F.col("confidence")), F.lit(")")
    )
    facts = nodes.agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), line.alias("l")))).alias("f"))
    conflicts = F.col("conflicting_values") if "conflicting_values" in edges.columns else F.lit(None).cast("string")
    relation = F.concat(
        F.lit("  - "), F.substring("source_id", 1, 8), F.lit(".. "), "edge_type", F.lit(" "), F.substring("target_id", 1, 8), F.lit(".. (weight: "),
        F.format_string("%.2f", F.col("weight")), F.lit(")")
    )
    links = edges.agg(
        F.sort_array(F.collect_list(relation)).alias("r"),
        F.sort_array(F.collect_list(F.concat(F.lit("  - WARNING: Conflicting information found: "), conflicts))).alias("c")
    )
    numbered = F.transform("f", lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), x["l"]))
    heading = F.array(F.lit(f"Knowledge graph context for: {query}\n"), F.lit("Facts (in chronological order):" if chronological else "Facts:"))
    section = lambda title, c: F.when(F.size(c) > 0, F.concat(F.array(F.lit(title)), c)).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(heading, numbered, section("\nContradictions detected:", F.col("c")), section("\nRelationships:", F.col("r"))), "\n")
    return facts.crossJoin(links).select(F.when(F.size("f") > 0, text).otherwise("No relevant knowledge found.").alias("context"))
