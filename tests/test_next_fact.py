"""Facts beside the next one of their agent."""

from mnemora.plans import reasoning
from pyspark.sql import functions as F


def test_f3_f5_no_window_over_texts(spark):
    facts = spark.range(40).select(
        F.format_string("f%03d", "id").alias("node_id"), F.when(F.col("id") < 30, F.concat(F.lit("a"), F.col("id") % 3)).alias("agent_id"),
        F.concat(F.lit("text "), "id").alias("content"),
    )
    beside = reasoning._next_to(facts, ["content"])
    got = {r.node_id: r.content_b for r in beside.collect()}
    agents = [[i for i in range(30) if i % 3 == k] for k in range(3)] + [list(range(30, 40))]
    assert got == {f"f{i:03d}": f"text {j}" if j is not None else None for ids in agents for i, j in zip(ids, [*ids[1:], None], strict=True)}
    plan = beside._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    windows = [i for i, line in enumerate(lines) if "Window" in line]
    assert windows and not any("content" in line for i in windows for line in lines[i : i + 2])
