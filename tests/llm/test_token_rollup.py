import base64
from collections import Counter
from functools import lru_cache

import pytest
import tiktoken
from mnemora.llm import token_rollup
from mnemora.llm.token_rollup import PATTERN, TokenRollup

CHANGES = "op string, doc_id long, text string, source string, lang string, version long, tokenizer string, n_tokens int, key string"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache
def encoding(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokens(text, path=VOCABULARY):
    return len(encoding(path).encode_ordinary(text or ""))


def batches():
    x = ("c", 0, "k")
    first = [("insert", i, f"text number {i} " * (i % 5), "ab"[i % 2], "en", 1, *x) for i in range(40)] + [("insert", 100, None, None, None, 1, *x), ("insert", None, "no id", "a", "en", 1, *x), ("insert", 101, "", "a", "de", 1, *x)]
    second = [("delete", 3, None, None, None, 2, *x), ("revise", 4, "entirely new words", "c", "fr", 2, *x), ("delete", 999, None, None, None, 2, *x), ("insert", 5, "twice", "a", "en", 2, *x), ("insert", 5, "twice, later", "b", "en", 3, *x), ("revise", 6, "same", "a", "en", 2, *x), ("revise", 6, "same", "a", "en", 2, *x)]
    third = [("insert", 3, "back again", "a", "en", 3, *x), ("delete", 4, None, None, None, 3, *x), ("delete", None, None, None, None, 3, *x)]
    return [first, second, third]


def brute(upto):
    state = {}
    for batch in batches()[:upto]:
        last = {}
        for c in batch:
            if c[1] not in last or c[5] >= last[c[1]][5]:
                last[c[1]] = c
        for i, c in last.items():
            state.pop(i, None)
            if c[0] != "delete":
                state[i] = (c[3], c[4], tokens(c[2]))
    docs, sums = Counter(), Counter()
    for s, lang, n in state.values():
        docs[s, lang] += 1
        sums[s, lang] += n
    return {(s, lang, "v1", docs[s, lang], sums[s, lang]) for s, lang in docs}


def read(rollup):
    return {(r.source, r.lang, r.tokenizer, r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_batches_equal_a_recount(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "store"), ("v1", VOCABULARY))
    assert read(rollup) == set()
    for k, rows in enumerate(batches()):
        df = spark.createDataFrame(rows, CHANGES)
        assert rollup.apply(f"batch/{k}", df) is True
        assert read(rollup) == brute(k + 1)
        assert rollup.apply(f"batch/{k}", df) is False  # idempotent
        assert read(rollup) == brute(k + 1)
    assert rollup.apply("empty", spark.createDataFrame([], CHANGES)) and read(rollup) == brute(3)


def test_a_broken_batch_leaves_nothing(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "store"), ("v1", VOCABULARY))
    good = spark.createDataFrame(batches()[0], CHANGES)
    rollup.apply("one", good)
    bad = spark.createDataFrame([("rename", 1, "x", "a", "en", 1, "c", 0, "k")], CHANGES)
    with pytest.raises(Exception, match="unknown op"):
        rollup.apply("two", bad)
    assert read(rollup) == brute(1)
    (tmp_path / "store/deltas/000000001-v1-74776f").mkdir(parents=True, exist_ok=True)  # what a killed writer leaves
    assert rollup.apply("two", spark.createDataFrame(batches()[1], CHANGES)) and read(rollup) == brute(2)


def test_versions_are_counted_apart(spark, tmp_path):
    path = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    rows = [("insert", 1, "un été à la mer", "a", "fr", 1, "c", 0, "k")]
    for version in (("v1", VOCABULARY), ("v2", path)):
        TokenRollup(spark, str(tmp_path / "s"), version).apply("b", spark.createDataFrame(rows, CHANGES))
    got = {(r.tokenizer, r.n_docs, r.n_tokens) for r in TokenRollup(spark, str(tmp_path / "s")).totals().collect()}
    assert got == {("v1", 1, tokens(rows[0][2])), ("v2", 1, tokens(rows[0][2], path))}


def test_long_texts_and_documents(spark):
    docs = spark.createDataFrame([(1, "a" * 300_000 + " " + "word " * 100_000, "s", "en"), (1, "repeated id", "s", "en"), (2, "x <|endoftext|> y", None, None)], "doc_id long, text string, source string, lang string")
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in token_rollup.count_documents(docs).collect()}
    assert got[None, None] == (1, tokens("x <|endoftext|> y"))
    assert got["s", "en"] == (2, tokens("a" * 300_000 + " " + "word " * 100_000) + tokens("repeated id"))  # all rows of an id count
    assert token_rollup.count_documents(docs.limit(0)).count() == 0


def test_documents_without_ids_count_each(spark):
    docs = spark.createDataFrame([(None, "one text", "s", "en"), (None, "one text", "s", "en"), (None, "another", "s", "en"), (1, "a", "s", "en")], "doc_id long, text string, source string, lang string")
    got = token_rollup.count_documents(docs.repartition(3)).first()
    assert (got.n_docs, got.n_tokens) == (4, sum(map(tokens, ["one text", "one text", "another", "a"])))


def test_snapshots_change_nothing(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path / "store"), ("v1", VOCABULARY), snapshot_every=2)
    other = TokenRollup(spark, str(tmp_path / "store"), ("v2", VOCABULARY), snapshot_every=2)
    other.apply("x", spark.createDataFrame(batches()[0], CHANGES))
    for k, rows in enumerate(batches()):
        rollup.apply(f"{k}", spark.createDataFrame(rows, CHANGES))
        assert {x for x in read(rollup) if x[2] == "v1"} == brute(k + 1)
    assert len(rollup._done("snapshots")) >= 1
    last, since = rollup._since(rollup._done("commits"), "v1")
    assert last and len(since) < 3
    rollup.snapshot()
    assert {x for x in read(rollup) if x[2] == "v1"} == brute(3)


def test_documents_equal_a_recount(spark):
    """Loads, revisions, deletes and retries end at the table's own totals, repeated and missing ids included."""
    rows = [(i % 50 if i % 7 else None, f"line {i}" + ("\nmore " * (i % 4)), "ab"[i % 2] if i % 5 else None, "en") for i in range(120)] + [(3, None, "a", "en"), (4, "", "a", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    want_docs, want = Counter(), Counter()
    for _, text, source, lang in rows:
        want_docs[source, lang] += 1
        want[source, lang] += tokens(text)
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in token_rollup.count_documents(docs).collect()}
    assert got == {k: (want_docs[k], want[k]) for k in want_docs}
