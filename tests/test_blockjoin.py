"""Pairs of blocks against all pairs, and the plan of similar pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from mnemora.functions import vocab
from mnemora.operators import blockjoin, similarity
from pyspark.sql import functions as F


def rows(n=60):
    rng = random.Random(4)
    out = []
    for i in range(n):
        w = out[rng.randrange(i)][7] if i % 5 == 4 else np.sort(np.array(rng.sample(range(40), rng.randint(1, 9)), np.int64) * 7919).tolist()
        out.append(["a", 5 if i % 4 else i, 3 if i % 4 else None, f"f{i:03d}", i % 3 > 0, [rng.choice([1, 2])], [5] if i % 4 else [i], w])
    return sorted(out, key=lambda r: (r[1], not r[4], r[5], r[6], len(r[7]), r[7]))


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0


@pytest.mark.parametrize("meetings", [3, 1 << 22])
def test_o56_blocks_meet_like_all_pairs(tmp_path, monkeypatch, meetings):
    for name, value in {"BLOCK": 7, "ROWS": 3, "DENSE": 2, "MEETINGS": meetings}.items():
        monkeypatch.setattr(blockjoin, name, value)
    kind = pa.schema([("agent_id", pa.string()), ("g", pa.int64()), ("n", pa.int64()), ("node_id", pa.string()), ("fresh", pa.bool_()), *((k, pa.list_(pa.int64())) for k in "tcw")])
    every = rows()
    batches = [pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*every[i : i + 11], strict=True), kind.types, strict=True)], schema=kind) for i in range(0, len(every), 11)]
    blocks = [b.to_pylist()[0] for b in blockjoin.cut_blocks(str(tmp_path / "blocks"), iter(batches))]
    assert len(blocks) > 4
    met = [(x["path"], y["path"]) for x in blocks for y in blocks if x["run"] == y["run"] and x["path"] <= y["path"]]
    paths = pa.RecordBatch.from_arrays([pa.array([m[i] for m in met]) for i in (0, 1)], names=["l", "r"])
    got = {(r["a"], r["b"]): r["score"] for b in blockjoin.compare(0.6, vocab.SIMILARITY_WEIGHTS, iter([paths])) for r in b.to_pylist()}
    want = {}
    for x in every:
        for y in every:
            score = jaccard(x[7], y[7]) * 0.5 + jaccard(x[5], y[5]) * 0.2 + jaccard(x[6], y[6]) * 0.3
            if x[3] < y[3] and set(x[6]) & set(y[6]) and (x[4] or y[4]) and score >= 0.6 - 1e-12:
                want[x[3], y[3]] = score
    assert want and got == pytest.approx(want)


def test_o56_no_row_per_shared_token_under_a_shared_concept(spark):
    facts = spark.range(200).select(
        F.concat(F.lit("f"), "id").alias("node_id"), F.lit("a").alias("agent_id"), F.lit("rivers").alias("concept"), F.array(F.lit("x")).alias("tags"),
        F.concat(F.lit("same frequent words everywhere plus own"), F.col("id") % 3, F.lit(" last"), F.col("id") % 50).alias("content"),
    )
    plan = similarity.candidates(similarity.prepared(facts), 0.6)._jdf.queryExecution().optimizedPlan().toString()
    assert "token" not in plan and "Join" not in plan
    assert similarity.similar_pairs(facts, 0.6).count() == 200 * 199 // 2
