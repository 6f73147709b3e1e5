"""Facts that contradict older ones, on short and on long time lines."""

import random
import re

from mnemora.operators import hierarchical

KIND = "node_id string, agent_id string, concept string, content string, metadata string"
CONCEPTS = ["a1 total", "A12 total", "a123 total", "total a1", "xa12 sum total", "a1", "a1 a1 Total", "to", "", " ", None, "a9 gone", "Straße a1 total"]


def _facts(n: int, seed: int, first: str = "f") -> list[tuple]:
    rng = random.Random(seed)
    contents = ["it is 1", "it is 2", "from 2 to 3.5", "3.5 and 2", "12 10 9", "none", None]
    metadata = [None, "{}", '{"temporal_index": -1}', '{"temporal_index": "x"}']
    indices = lambda: rng.choice(metadata) if rng.random() < 0.1 else f'{{"temporal_index": {rng.choice([1, 2, 3, 3, 3, 4, 7, 12, 90])}}}'
    return [(f"{first}{i:04d}", rng.choice("xxxyz"), rng.choice(CONCEPTS), rng.choice(contents), indices()) for i in range(n)]


def _plain(facts: list[tuple], candidates: int, asks: set[str]) -> list[tuple]:
    index = lambda m: int(f[1]) if (f := re.search(r": (-?\d+)}", m or "")) else 0
    rows = [(i, a, (c or "").lower(), set(re.findall(r"\b\d+(?:\.\d+)?\b", t or "")), index(m)) for i, a, c, t, m in facts]
    rows = [r for r in rows if r[4] > 0]
    out = []
    for i, agent, concept, numbers, at in rows:
        if i not in asks or not concept.split():
            continue
        older = [r for r in rows if r[1] == agent and concept.split()[0] in r[2] and r[4] < at]
        for j, _, c, n, k in sorted(older, key=lambda r: (r[4], r[0]))[-candidates:]:
            if numbers - n and n - numbers and any(len(w) > 2 for w in {*concept.split()} & {*c.split()}):
                out.append((i, j, f"Updated values: {', '.join(sorted(numbers - n))} vs {', '.join(sorted(n - numbers))}", f"index {k} -> {at}"))
    return sorted(out)


def test_o57_short_and_long_time_lines_agree_with_a_plain_restatement(spark, monkeypatch):
    facts, more = _facts(300, 1), _facts(60, 2, "g")
    df = lambda rows: spark.createDataFrame(rows, KIND)
    everyone, newer = {f[0] for f in facts}, {f[0] for f in more}
    for short, block in ((4096, 4096), (40, 3), (0, 3)):
        monkeypatch.setattr(hierarchical, "_LINE", short)
        monkeypatch.setattr(hierarchical, "_BLOCK", block)
        for candidates in (20, 3):
            want = _plain(facts, candidates, everyone)
            assert want and sorted(tuple(r) for r in hierarchical.detect_supersedes(df(facts), candidates).collect()) == want
        want = _plain(facts + more, 20, newer)
        assert want and sorted(tuple(r) for r in hierarchical.detect_supersedes(df(facts), new=df(more)).collect()) == want
    assert hierarchical.detect_supersedes(df(facts), new=df(more[:0])).count() == 0


def test_o57_a_long_time_line_keeps_what_can_be_looked_at(spark, monkeypatch):
    tables = {}
    keep = lambda df, what, real=hierarchical.written: tables.setdefault(what, real(df, what))
    monkeypatch.setattr(hierarchical, "written", keep)
    facts = spark.range(6000).selectExpr(
        "printf('f%05d', id) AS node_id", "'a' AS agent_id", "concat('k', id % 3000, ' total') AS concept", "concat('is ', id) AS content",
        "concat('{\"temporal_index\": ', 1 + id DIV 3000, '}') AS metadata"
    ).unionAll(spark.createDataFrame([("z", "a", "k total", "is 7", '{"temporal_index": 3}')], KIND))
    found = hierarchical.detect_supersedes(facts)
    # 'k' stands in all concepts: 20 facts of each index remain, and the fact itself
    assert tables["lines"].count() == 41
    assert {r.old_id for r in found.where("new_id = 'z'").collect()} == {f"f{i:05d}" for i in range(5980, 6000)}
    # pairs of short time lines, nearly all there are, don't meet again to be made distinct
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert plan[0].startswith("Union") and not any("Aggregate [new_id" in line and line.startswith(":") for line in plan)
