"""The six memory types: stores, reads, lifecycle. ``now`` is always a parameter.

Operators that change something return the rows to append or the table afterwards; operators that read
and count an access return ``(result, updates)``, and the caller commits the updates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def _contains(column: str, needle: str) -> Column:
    return F.contains(F.lower(F.col(column)), F.lit(needle.lower()))


def keywords(query: str, max_keywords: int | None = None) -> list[str]:
    return query.lower().split()[:max_keywords]


def _any_word(columns: Sequence[str], query: str, max_keywords: int | None = None) -> Column:
    found = F.lit(False)
    for column in columns:
        for word in dict.fromkeys(keywords(query, max_keywords)):
            found = found | F.coalesce(F.contains(F.lower(F.col(column)), F.lit(word)), F.lit(False))
    return found


# -- sensory ---------------------------------------------------------------------------------------


def record_sensory(existing: DataFrame, observed: DataFrame, now: Column, ttl_seconds: int = vocab.SENSORY_TTL_SECONDS) -> DataFrame:
    """Rows to append: observation orders go on from the agent's largest, in order of node_id.

    ``observed``: node_id, agent_id, modality, raw_data.
    """
    last = existing.groupBy("agent_id").agg(F.max("observation_order").alias("last"))
    rank = F.row_number().over(Window.partitionBy("agent_id").orderBy("node_id"))
    new = observed.withColumn("rank", rank).join(last, "agent_id", "left")
    return new.select(
        "node_id", "agent_id", "modality", "raw_data", (F.coalesce("last", F.lit(0)) + F.col("rank")).cast("long").alias("observation_order"),
        (now + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"), now.alias("created_at")
    )


def recent_sensory(sensory: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    return sensory.where(F.col("expires_at") > now).orderBy(F.desc("observation_order"), "node_id").limit(limit)


def prune_sensory(sensory: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """``(rows that stay, one row n_pruned)``."""
    expired = F.coalesce(F.col("expires_at") <= now, F.lit(False))
    return sensory.where(~expired), sensory.agg(F.count_if(expired).alias("n_pruned"))


def attend_to_sensory(sensory: DataFrame, attended: DataFrame, now: Column, next_index: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(episodes, ATTENDED_TO edges)`` of unexpired items; ``attended``: node_id, reason."""
    found = sensory.where(F.col("expires_at") > now).join(attended.select("node_id", "reason"), "node_id")
    content = F.concat(
        F.lit("["), "modality", F.lit("] "), "raw_data",
        F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" -- attended: "), "reason")).otherwise("")
    )
    episodes = found.select(
        F.concat(F.lit("epi_"), "node_id").alias("node_id"), "agent_id", content.alias("content"), F.lit("sensory").alias("source_label"),
        (
            F.lit(next_index) + F.row_number().over(Window.partitionBy("agent_id").orderBy("observation_order", "node_id")) - 1
        ).cast("long").alias("temporal_index")
    )
    edges = found.select(
        F.col("node_id").alias("source_id"), F.concat(F.lit("epi_"), "node_id").alias("target_id"), F.lit("ATTENDED_TO").alias("edge_type"),
        now.alias("attended_at")
    )
    return episodes, edges


# -- working ---------------------------------------------------------------------------------------


def working_slots(working: DataFrame, capacity: int = vocab.WORKING_CAPACITY) -> DataFrame:
    """Slots that a task holds in steady state: the ``capacity`` most relevant ones."""
    order = Window.partitionBy("agent_id", "task_id").orderBy(F.desc("relevance"), F.desc("created_at"), "node_id")
    return working.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= capacity).drop("__n")


def replay_working(pushes: DataFrame, capacity: int = vocab.WORKING_CAPACITY) -> DataFrame:
    """Slots left after pushing in order of (created_at, node_id): a full task first loses its least relevant slot.

    The newcomer always survives its own push, so this isn't a plain top list. A task's pushes are
    folded as a stream in order with ``capacity`` slots of state, whatever their number.
    """
    import pandas as pd

    def fold(frames):
        held: dict[tuple, list] = {}
        task = None
        for frame in frames:
            for row in frame.itertuples(index=False):
                key = (row.agent_id, row.task_id)
                if key != task:
                    if task is not None:
                        yield pd.DataFrame(held.pop(task), columns=frame.columns)
                    task, held[key] = key, []
                slots = held[key]
                if len(slots) >= capacity:
                    slots.remove(
                        min(slots, key=lambda s: (s[columns.index("relevance")], s[columns.index("created_at")], s[columns.index("node_id")]))
                    )
                slots.append(tuple(row))
        if task is not None:
            yield pd.DataFrame(held.pop(task), columns=columns)

    columns = pushes.columns
    ordered = pushes.repartition("agent_id", "task_id").sortWithinPartitions("agent_id", "task_id", "created_at", "node_id")
    return ordered.mapInPandas(fold, pushes.schema)


def get_working(working: DataFrame, task_id: str) -> DataFrame:
    return working.where(F.col("task_id") == task_id).orderBy(F.desc("relevance"), "node_id")


def clear_working(working: DataFrame, task_id: str) -> tuple[DataFrame, DataFrame]:
    own = F.coalesce(F.col("task_id") == task_id, F.lit(False))
    return working.where(~own), working.agg(F.count_if(own).alias("n_cleared"))


# -- episodic --------------------------------------------------------------------------------------


def store_episodes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append, with temporal indexes going on from the agent's largest.

    ``new``: node_id, agent_id, content, source_label, temporal_index (null: the next one), in order of
    node_id. An explicit index that is larger moves the counter on.
    """
    last = existing.groupBy("agent_id").agg(F.max("temporal_index").alias("last"))
    rows = new.join(last, "agent_id", "left").withColumn("pos", F.row_number().over(Window.partitionBy("agent_id").orderBy("node_id")))
    base = F.coalesce(F.col("last"), F.lit(0))
    # a counter that steps by one and jumps to explicit indexes is pos + max(index - pos) so far
    lead = F.max(F.greatest(F.coalesce(F.col("temporal_index") - F.col("pos"), base), base)).over(
        Window.partitionBy("agent_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    )
    return rows.select(
        "node_id", "agent_id", "content", "source_label",
        F.coalesce(F.col("temporal_index"), F.col("pos") + lead).cast("long").alias("temporal_index")
    )


def recover_counters(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy("agent_id").agg(F.max(column).alias("last"))


def get_episodes(episodes: DataFrame, limit: int = 50, include_compressed: bool = False) -> DataFrame:
    kept = episodes if include_compressed else episodes.where(~F.col("compressed"))
    return kept.orderBy(F.desc("temporal_index"), "node_id").limit(limit)


def search_episodes(episodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    return episodes.where(~F.col("compressed") & _contains("content", query)).orderBy(F.desc("temporal_index"), "node_id").limit(limit)


def undistilled_episodes(episodes: DataFrame, limit: int = 50) -> DataFrame:
    return episodes.where(~F.coalesce("distilled", F.lit(False))).orderBy(F.desc("temporal_index"), "node_id").limit(limit)


def mark_distilled(episodes: DataFrame, ids: DataFrame, agent: str) -> DataFrame:
    """Sets a one-way latch on the agent's own episodes among ``ids`` (node_id)."""
    named = episodes.join(ids.select("node_id", F.lit(True).alias("__named")).distinct(), "node_id", "left")
    return named.withColumn(
        "distilled", F.coalesce("distilled", F.lit(False)) | (F.coalesce("__named", F.lit(False)) & (F.col("agent_id") == agent))
    ).drop("__named")


def consolidate_episodes(
    episodes: DataFrame, batch: int = 10, summarise: Callable[[Column], Column] | None = None, separator: str = " | "
) -> DataFrame:
    """One summary per agent over its oldest ``batch`` uncompressed episodes: ``agent_id, summary, original_count, episode_ids``.

    Agents with fewer have none. ``summarise`` maps the array of contents to a text; by default they are joined.
    """
    order = Window.partitionBy("agent_id").orderBy("temporal_index", "node_id")
    oldest = episodes.where(~F.col("compressed")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= batch)
    grouped = oldest.groupBy("agent_id").agg(F.sort_array(F.collect_list(F.struct("n", "node_id", "content"))).alias("e")).where(F.size("e") == batch)
    contents = F.transform("e", lambda e: F.coalesce(e["content"], F.lit("")))
    summary = F.array_join(contents, separator) if summarise is None else summarise(contents)
    return grouped.select(
        "agent_id", summary.alias("summary"), F.size("e").cast("long").alias("original_count"),
        F.transform("e", lambda e: e["node_id"]).alias("episode_ids")
    )


def compress_consolidated(episodes: DataFrame, consolidated: DataFrame) -> DataFrame:
    """Episodes with those that went into a summary marked as compressed."""
    used = consolidated.select("agent_id", F.explode("episode_ids").alias("node_id")).withColumn("__used", F.lit(True))
    return episodes.join(used, ["agent_id", "node_id"], "left").withColumn(
        "compressed", F.col("compressed") | F.coalesce("__used", F.lit(False))
    ).drop("__used")


# -- semantic --------------------------------------------------------------------------------------


def store_facts(new: DataFrame, episodes: DataFrame, sources: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(facts to append, DERIVES_FROM edges, rejected)``.

    ``new``: node_id, agent_id, concept, content, confidence, ...; ``sources``: node_id, episode_id. A
    confidence outside [0, 1] (NaN included) or a blank concept or content rejects a fact. Edges are made to
    episodes that exist; ``strict`` rejects facts that name any other.
    """
    error = F.when(
        F.isnan("confidence") | F.col("confidence").isNull() | ~F.col("confidence").between(0.0, 1.0), "confidence out of range"
    ).when(F.trim(F.coalesce("concept", F.lit(""))) == "", "blank concept").when(F.trim(F.coalesce("content", F.lit(""))) == "", "blank content")
    checked = new.withColumn("__error", error)
    known = sources.join(episodes.select(F.col("node_id").alias("episode_id")).distinct(), "episode_id", "left_semi")
    if strict:
        lost = sources.join(
            episodes.select(F.col("node_id").alias("episode_id")), "episode_id", "left_anti"
        ).select("node_id").distinct().withColumn("__lost", F.lit(True))
        checked = checked.join(lost, "node_id", "left").withColumn(
            "__error", F.coalesce("__error", F.when(F.col("__lost"), "unknown episode"))
        ).drop("__lost")
    good = checked.where("__error is null").drop("__error")
    if "importance" in new.columns:
        good = good.withColumn("importance", F.coalesce("importance", "confidence"))
    edges = known.join(good.select("node_id"), "node_id", "left_semi").select(
        F.col("node_id").alias("source_id"), F.col("episode_id").alias("target_id"), F.lit("DERIVES_FROM").alias("edge_type")
    ).distinct()
    return good.withColumn(
        "content_hash", T.content_hash(F.col("concept"), F.col("content"))
    ), edges, checked.where("__error is not null").select("node_id", F.col("__error").alias("error"))


def all_facts(facts: DataFrame, limit: int = 50) -> DataFrame:
    """Most confident first, archived ones included."""
    return facts.orderBy(F.desc("confidence"), "node_id").limit(limit)


def search_facts(facts: DataFrame, query: str, limit: int = 10, min_confidence: float = 0.0, max_keywords: int | None = None) -> DataFrame:
    """Facts with any word of the query in concept or content; a blank query takes all."""
    if not keywords(query):
        return all_facts(facts.where(F.col("confidence") >= min_confidence), limit)
    hit = _any_word(("concept", "content"), query, max_keywords)
    return facts.where((F.col("confidence") >= min_confidence) & hit).orderBy(F.desc("confidence"), "node_id").limit(limit)


def record_access(facts: DataFrame, accesses: DataFrame, agent: str | None = None) -> DataFrame:
    """Facts with uses counted: ``accesses`` (node_id, accessed_at), any number per fact.

    A fact of another agent stops the job. Counts are summed before the join.
    """
    used = accesses.groupBy("node_id").agg(F.count("*").alias("__uses"), F.max("accessed_at").alias("__at"))
    joined = facts.join(used, "node_id", "left")
    if agent is not None:
        foreign = F.col("__uses").isNotNull() & (F.col("agent_id") != agent)
        joined = joined.withColumn(
            "__uses", F.when(foreign, F.raise_error(F.concat(F.lit("fact of another agent: "), "node_id"))).otherwise(F.col("__uses"))
        )
    return joined.withColumns(
        {"usage_count": F.coalesce("usage_count", F.lit(0)) + F.coalesce("__uses", F.lit(0)), "last_accessed_at": F.greatest("last_accessed_at", "__at")}
    ).drop("__uses", "__at")


def fold_statuses(prospective: DataFrame, statuses: DataFrame) -> DataFrame:
    """Intentions with the furthest status that was noted (node_id, status): pending, triggered, resolved."""
    rank = F.when(F.col("status") == "resolved", 2).when(F.col("status") == "triggered", 1).otherwise(0)
    furthest = statuses.groupBy("node_id").agg(F.max(F.struct(rank.alias("rank"), "status")).alias("__noted"))
    joined = prospective.join(furthest, "node_id", "left")
    later = F.col("__noted").isNotNull() & (F.col("__noted.rank") > rank)
    return joined.withColumn("status", F.when(later, F.col("__noted.status")).otherwise(F.col("status"))).drop("__noted").select(*prospective.columns)


def fold_uses(procedures: DataFrame, accesses: DataFrame) -> DataFrame:
    """Procedures with the uses that were noted (node_id) added to their count."""
    used = accesses.groupBy("node_id").agg(F.count("*").alias("__uses"))
    joined = procedures.join(used, "node_id", "left")
    return joined.withColumn("usage_count", F.coalesce("usage_count", F.lit(0)) + F.coalesce("__uses", F.lit(0))).select(*procedures.columns)


def link_once(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Of ``new`` edges (source_id, target_id, edge_type) those that aren't there yet, once each."""
    key = ["source_id", "target_id", "edge_type"]
    return new.dropDuplicates(key).join(edges.select(*key), key, "left_anti")


# -- procedural ------------------------------------------------------------------------------------


def store_procedures(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The table afterwards: a procedure replaces the steps of one with its agent and name, and keeps its id and uses."""
    key = ["agent_id", "name"]
    latest = new.groupBy(*key).agg(F.max_by(F.struct("node_id", "steps", "prerequisites"), "node_id").alias("n"))
    both = existing.join(latest, key, "full_outer")
    return both.select(
        F.coalesce("node_id", "n.node_id").alias("node_id"), *key, F.coalesce("n.steps", "steps").alias("steps"),
        F.coalesce("n.prerequisites", "prerequisites").alias("prerequisites"), F.coalesce("usage_count", F.lit(0).cast("long")).alias("usage_count")
    )


def recall_procedures(procedures: DataFrame, query: str, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(procedures with their uses so far, updates (node_id, usage_count) to commit)``."""
    steps = "__all_steps"
    hit = _any_word(("name", steps), query) if keywords(query) else F.lit(True)
    found = procedures.withColumn(steps, F.array_join("steps", " ")).where(hit).drop(steps).orderBy(F.desc("usage_count"), "node_id").limit(limit)
    return found, found.select("node_id", (F.col("usage_count") + 1).alias("usage_count"))


# -- prospective -----------------------------------------------------------------------------------


def store_prospective(new: DataFrame) -> DataFrame:
    """Rows to append; a missing or empty status is pending."""
    status = F.col("status") if "status" in new.columns else F.lit(None)
    return new.withColumn("status", F.when(F.coalesce(status, F.lit("")) == "", "pending").otherwise(status))


def resolve_prospective(prospective: DataFrame, ids: DataFrame) -> DataFrame:
    done = prospective.join(ids.select("node_id", F.lit(True).alias("__done")).distinct(), "node_id", "left")
    return done.withColumn("status", F.when(F.col("__done"), "resolved").otherwise(F.col("status"))).drop("__done")


def all_prospective(prospective: DataFrame, limit: int = 50) -> DataFrame:
    return prospective.orderBy(F.desc("priority"), "node_id").limit(limit)


def prospective_by_trigger(prospective: DataFrame, trigger: str, limit: int = 50) -> DataFrame:
    return all_prospective(prospective.where(F.col("trigger_condition") == trigger), limit)


def check_triggers(prospective: DataFrame, contents: DataFrame, mode: str = "word") -> DataFrame:
    """``(node_id, priority, content_id)``: pending intentions that a content (content_id, content) triggers.

    ``word`` joins on whole words; ``substring`` also takes words inside others, by looking up every
    piece of a content word that is as long as a trigger word, once for each distinct word. Both are equi-joins. The caller marks the
    intentions as triggered.
    """
    pending = prospective.where(F.col("status") == "pending").select(
        "node_id", "priority", F.explode(T.plain_tokens(F.col("trigger_condition"))).alias("word")
    )
    said = contents.select("content_id", F.explode(T.plain_tokens(F.col("content"))).alias("said"))
    if mode == "word":
        found = pending.join(said, F.col("word") == F.col("said"))
    elif mode == "substring":
        sizes = pending.agg(F.min(F.length("word")).alias("lo"), F.max(F.length("word")).alias("hi"))  # one row
        pieces = said.select("said").distinct().crossJoin(F.broadcast(sizes)).where(F.length("said") >= F.col("lo"))
        pieces = pieces.select("said", F.explode(F.sequence("lo", F.least("hi", F.length("said")))).alias("size"))
        pieces = pieces.select(
            "said",
            F.explode(
                F.transform(F.sequence(F.lit(1), F.length("said") - F.col("size") + 1), lambda i: F.substring(F.col("said"), i, F.col("size")))
            ).alias("word")
        )
        inside = pieces.join(pending.select("word").distinct(), "word").distinct()
        # a content's words become its trigger words before they meet the intentions
        found = pending.join(said.join(inside, "said").select("content_id", "word").distinct(), "word")
    else:
        raise ValueError(f"unknown mode: {mode!r}")
    return found.select("node_id", "priority", "content_id").distinct()


# -- statistics ------------------------------------------------------------------------------------


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """``(memory_type, n)`` of all six types, zeros included, and their ``total``. An unreadable table raises."""
    counts = None
    for kind in vocab.MEMORY_TYPES:
        one = tables[kind].agg(F.count("*").alias("n")).select(F.lit(kind).alias("memory_type"), "n") if kind in tables else None
        if one is None:
            one = next(iter(tables.values())).limit(0).agg(F.count("*").alias("n")).select(F.lit(kind).alias("memory_type"), "n")
        counts = one if counts is None else counts.unionAll(one)
    return counts.unionAll(counts.agg(F.sum("n").alias("n")).select(F.lit("total").alias("memory_type"), "n"))
