"""Memory as streams: expiring observations, bounded slots, triggers.

Expiry goes by event time and the watermark, not by the clock of the machine; parquet's timestamps without
a zone are cast first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..functions import vocab


def live_sensory(stream: DataFrame, ttl_seconds: int = vocab.SENSORY_TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """``(window, agent_id, modality, n)``: observations (agent_id, modality, created_at) live at each window's end.

    An observation is live for ``ttl_seconds``: sliding windows of that length, emitted once the watermark
    has passed them. Later rows have expired and are dropped with the state.
    """
    timed = stream.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
    return timed.groupBy(
        F.window("created_at", f"{ttl_seconds} seconds", f"{max(1, ttl_seconds // 2)} seconds"), "agent_id", "modality"
    ).agg(F.count("*").alias("n"))


def unique_observations(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each observation (node_id) once, within the watermark."""
    return stream.withColumn(
        "created_at", F.col("created_at").cast("timestamp")
    ).withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["node_id"])


_SLOTS = "agent_id string, task_id string, node_id string, relevance double, n_slots int"


def bounded_slots(stream: DataFrame, capacity: int = vocab.WORKING_CAPACITY) -> DataFrame:
    """Working memory as keyed state: for every push (agent_id, task_id, node_id, relevance), the slot it took.

    A full task loses its least relevant slot first, so the newcomer stays. State per task is at most
    ``capacity`` slots, whatever arrives. Pushes of one micro-batch are taken in order of node_id.
    """

    def push(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        pushes = sorted((r.node_id, r.relevance) for frame in frames for r in frame.itertuples(index=False))
        out = []
        for node_id, relevance in pushes:
            if len(held) >= capacity:
                held.remove(min(held, key=lambda s: (s[1], s[0])))
            held.append((node_id, relevance))
            out.append((*key, node_id, relevance, len(held)))
        state.update(([h[0] for h in held], [float(h[1]) for h in held]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _SLOTS.split(", ")])

    keyed = stream.select("agent_id", "task_id", "node_id", F.col("relevance").cast("double").alias("relevance"))
    return keyed.groupBy("agent_id", "task_id").applyInPandasWithState(
        push, _SLOTS, "ids array<string>, relevances array<double>", "append", GroupStateTimeout.NoTimeout
    )


def triggered(contents: DataFrame, prospective: DataFrame) -> DataFrame:
    """Stream of contents (content_id, content) against the pending intentions: whole words, a stream-static join."""
    pending = prospective.where("status = 'pending'").select(
        "node_id", "priority", F.explode(T.plain_tokens(F.col("trigger_condition"))).alias("word")
    )
    said = contents.select("content_id", F.explode(T.plain_tokens(F.col("content"))).alias("word"))
    return said.join(pending, "word").select("content_id", "node_id", "priority", "word")
