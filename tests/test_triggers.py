"""Trigger words inside the words of contents."""

from mnemora.operators import memory


def test_o113_pieces_are_made_of_distinct_words(spark):
    pending = spark.createDataFrame([("p1", 1, "port now", "pending"), ("p2", 2, "zz", "pending"), ("p3", 3, "port", "resolved")], "node_id string, priority int, trigger_condition string, status string")
    said = spark.createDataFrame([("c1", "imported reports"), ("c2", "reports reports"), ("c3", "snow")], "content_id string, content string")
    found = memory.check_triggers(pending, said, mode="substring")
    assert sorted(tuple(r) for r in found.collect()) == [("p1", 1, "c1"), ("p1", 1, "c2"), ("p1", 1, "c3")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    pieces = next(line for line in plan.splitlines() if "Generate explode(transform(sequence" in line)
    assert "content_id" not in pieces
