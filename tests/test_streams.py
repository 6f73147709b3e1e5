"""Streams run to the end over files, and equal their batch results."""

import random

from mnemora.streaming import memory_streams
from mnemora.streaming.intent_log import INTENTS, IntentLog, fenced, offset
from pyspark.sql import functions as F


def stream_of(spark, df, path):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drained(stream, name, tmp_path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_o44_live_sensory(spark, tmp_path):
    rows = [(f"s{i}", "a", "text", 1_700_000_000 + 60 * i) for i in range(100)]
    df = spark.createDataFrame(rows, "node_id string, agent_id string, modality string, at long").withColumn("created_at", F.timestamp_seconds("at").cast("timestamp_ntz")).drop("at")
    got = drained(memory_streams.live_sensory(stream_of(spark, df, tmp_path / "in"), 600, "1 minute"), "live", tmp_path)
    assert got.count() > 5 and got.agg(F.max("n")).first()[0] == 10
    twice = drained(memory_streams.unique_observations(stream_of(spark, df.union(df), tmp_path / "in2"), "1 day"), "once", tmp_path)
    assert twice.count() == 100


def test_o26_bounded_slots(spark, tmp_path):
    rng = random.Random(1)
    rows = [("a", rng.choice("xy"), f"n{i:03d}", float(rng.randint(0, 99))) for i in range(90)]
    df = spark.createDataFrame(rows, "agent_id string, task_id string, node_id string, relevance double").coalesce(1)
    got = drained(memory_streams.bounded_slots(stream_of(spark, df, tmp_path / "in"), 5), "slots", tmp_path)
    assert got.count() == 90 and got.agg(F.max("n_slots")).first()[0] == 5


def test_o113_triggers(spark, tmp_path):
    wishes = spark.createDataFrame([("p1", 1, "pending", "deploy"), ("p2", 2, "resolved", "deploy")], "node_id string, priority int, status string, trigger_condition string")
    said = spark.createDataFrame([("c1", "we deploy"), ("c2", "we rest")], "content_id string, content string")
    got = drained(memory_streams.triggered(stream_of(spark, said, tmp_path / "in"), wishes), "fired", tmp_path)
    assert [(r.content_id, r.node_id) for r in got.collect()] == [("c1", "p1")]


def intents(spark, rows):
    return spark.createDataFrame([(offset(*o), i, "store_fact", "a", e, p) for o, i, e, p in rows], INTENTS)


def test_o106_o108_exactly_once(spark, tmp_path):
    log, applied = IntentLog(spark, str(tmp_path / "log")), []
    apply = lambda df, n: applied.extend(r.intent_id for r in df.collect())
    log.append(intents(spark, [((0, 1), "i1", 1, "x"), ((0, 2), "i2", 1, "x"), ((0, 3), "i1", 1, "again")]))
    log.drain(apply)
    assert sorted(applied) == ["i1", "i2"]
    log.append(intents(spark, [((1, 1), "i2", 1, "replayed"), ((1, 2), "i3", 2, "x"), ((1, 3), "late", 1, "stale writer")]))
    log.drain(apply)
    log.drain(apply)
    assert sorted(applied) == ["i1", "i2", "i3"] and log.ledger().count() == 3


def test_o109_fence(spark):
    rng = random.Random(2)
    rows = [((i // 10, i % 10), f"i{i}", rng.randint(0, i // 8), "") for i in range(60)]
    got = {r.intent_id for r in fenced(intents(spark, rows).repartition(3), 1).collect()}
    top, want = 1, set()
    for _, i, e, _ in rows:
        top = max(top, e)
        if e >= top:
            want.add(i)
    assert got == want


def test_broken_records_stop_the_log(spark, tmp_path):
    import pytest

    with pytest.raises(Exception, match="unknown kind"):
        IntentLog(spark, str(tmp_path / "l")).append(intents(spark, [((0, 1), "i", 1, "x")]).withColumn("kind", F.lit("explode")))
