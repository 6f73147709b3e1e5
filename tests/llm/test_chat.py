import hashlib
import random
from collections import defaultdict

from mnemora.llm import chat

ROWS = "conv_id long, turn long, role string, text string, formatted string, pieces int"


def hexed(x):
    return hashlib.sha256(x.encode()).hexdigest()


def cases():
    rng = random.Random(5)
    bits = ["### ", "</turn>", "</turn>\n", "\\", "\\\\", "<\\/turn>", "\\### ", ": ", "user", "assistant", "\n", "é", "😀", "#", "<", " ", "$1", "x"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: b", "", "### x", None, "r\\"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for c in range(120) for t in range(rng.randint(1, 5))]
    rows += [(900, 1, "user", None), (900, 1, "user", None), (900, None, "assistant", "first"), (901, 0, "user", "only"), (None, 0, "assistant", "no id"), (902, 0, "assistant", "w \\n " * 20000)]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    return [(*r, "clash", 1) for r in rows]


def test_round_trip_and_digests(spark):
    rows = cases()
    by = defaultdict(list)
    for c, t, r, x, *_ in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, ROWS))).collect()}
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hexed("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), hexed(loss))


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "plain ## text", "", 0), (1, 1, "assistant", "a </turn> b", "", 0)]
    out = chat.format_conversations(spark.createDataFrame(rows, ROWS)).first()
    assert out.formatted == "### user: plain ## text</turn>\n### assistant: a <\\/turn> b</turn>\n"
    assert "".join(p.text for p in out.pieces) == out.formatted
    assert [p.text for p in out.pieces if p.loss] == ["a <\\/turn> b"]


def test_parser_rejects_what_is_no_conversation(spark):
    rows = [("### user: a</turn>\n",), ("### user: a",), ("x### user: a</turn>\n",), ("",), (None,)]
    got = [r.p for r in spark.createDataFrame(rows, "f string").select(chat.parse(__import__("pyspark").sql.functions.col("f")).alias("p")).collect()]
    assert [(t.role, t.text) for t in got[0]] == [("user", "a")]
    assert got[1] == [None] and got[2] == [None] and got[3] == [] and got[4] is None


def test_empty_table(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], ROWS))).count() == 0


def test_plan_is_native_with_one_shuffle(spark):
    df = chat.digests(chat.format_conversations(spark.createDataFrame(cases(), ROWS).where("turn is not null")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and not any(x in plan for x in ("Python", "Arrow", "Pandas"))
