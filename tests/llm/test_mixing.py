import re
from collections import Counter, defaultdict

from mnemora.llm import mixing

DOCS = "doc_id long, text string, source string, size int, target string, n_copies int"


def docs():
    import random

    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 30, 30, 200])), rng.choice(["a", "a", "a", "a", "b", "é", "Z", None]), 1, "x", 2) for i in range(600)]
    rows += [(1000 + i, "same words here", "hot", 1, "x", 2) for i in range(300)]
    rows += [(2000, "one doc   only x", "tiny", 1, "x", 2), (2001, None, "void", 1, "x", 2), (2002, " \t\n", "void", 1, "x", 2), (None, "null id", "b", None, None, None), (5000, "dup", "b", 1, "x", 2), (5000, "dup", "b", 1, "x", 2), (3000, "long " * 9000, "a", 1, "x", 2)]
    return rows


def words(t):
    return len(re.findall("[^\x20\x09-\x0d]+", t or ""))


def brute_targets(rows):
    size = defaultdict(int)
    for _, t, s, *_ in rows:
        size[s] += words(t)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target = sum(size.values()), dict.fromkeys(order, 0.0)
    open_, left = set(order), float(total)
    while True:
        w = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / w >= 3 * size[s]}
        if not full:
            return size, target | {s: left * weight[s] / w for s in open_}
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= full


def test_targets_and_bounds(spark):
    rows = docs()
    size, target = brute_targets(rows)
    got = mixing.shares(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((i or -1 if i is not None else -1, words(t)) for i, t, *_ in rows)
    at = {i: s for i, _, s, *_ in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        s = at[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in size)


def test_reruns_and_partitionings_agree(spark):
    df = spark.createDataFrame(docs(), DOCS)
    runs = [sorted(map(tuple, mixing.shares(x).collect()), key=str) for x in (df, df.repartition(7), df.repartition(3, "doc_id"))]
    assert runs[0] == runs[1] == runs[2]


def test_mixed_rows(spark):
    df = spark.createDataFrame(docs(), DOCS)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    got = Counter((r.doc_id, words(r.text)) for r in mixed.collect())
    want = Counter()
    for r in mixing.shares(df).collect():
        if r["size"]:
            want[r.doc_id, r["size"]] += r.taken // r["size"]
    assert {k: v for k, v in got.items() if k[1]} == {k: v for k, v in want.items() if v}


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.shares(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_no_python(spark):
    plan = mixing.shares(spark.createDataFrame(docs(), DOCS))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
