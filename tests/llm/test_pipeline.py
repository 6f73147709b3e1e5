"""The pipeline against a plain restatement of its stages, built on the brute forces of the operators' tests."""

import random
from collections import Counter

import corpus_pipeline
from mnemora.llm import mixing
from mnemora.llm.packing import PackingPlan

from . import test_mixing, test_quality, test_simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, fp int"


def documents():
    rng = random.Random(9)
    syllables = "on er th in an re ti es or he ou is ea ly nd st".split()
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, prose(rng.choice([20, 60, 150, 400])), "en", rng.choice(["a", "a", "b", "ç", None]), i, "x", 1) for i in range(150)]
    rows += [(200 + i, rows[i % 7][1] if i % 2 else rows[i % 7][1].upper(), "en", "b", 1, "x", 1) for i in range(40)]
    rows += [(300, "spam " * 300, "en", "a", 1, "x", 1), (301, None, None, None, None, None, None), (302, prose(20_000), "en", "a", 1, "x", 1), rows[3], (None, prose(90), "en", "b", 1, "x", 1), (303, "", "en", "b", 1, "x", 1)]
    return rows


def test_stages(spark, tmp_path):
    data = documents()
    docs = spark.createDataFrame(data, DOCS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "simhash near-dedup", "source mixing", "best-fit packing"] and corpus_pipeline.ORACLE_SQL is None
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, "")
        if k < 3:
            assert found.columns == docs.columns
        found.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out[name] = [tuple(r) for r in docs.collect()]
    good = [r for r in data if test_quality.plain_verdict(r[1])]
    assert Counter(map(str, out["quality rules"])) == Counter(map(str, good))
    fps = [test_simhash.brute_fingerprint(r[1]) for r in good]
    at = test_simhash.brute_components(sorted(set(fps)), [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 3])
    keep = {}
    for r, f in zip(good, fps, strict=True):
        keep[at[f]] = min(keep.get(at[f], r), r, key=lambda r: (r[0] is None, r[0] or 0))
    assert Counter(map(str, out["simhash near-dedup"])) == Counter(map(str, keep.values()))
    size, target = test_mixing.brute_targets([(r[0], r[1], r[3]) for r in keep.values()])
    taken, largest, copies = Counter(), Counter(), Counter()
    for r in out["source mixing"]:
        copies[r[0]] += 1
        taken[r[3]] += test_mixing.words(r[1])
    for r in keep.values():
        largest[r[3]] = max(largest[r[3]], test_mixing.words(r[1]))
    assert max(copies.values()) <= mixing.MAX_REPEATS and {r[0] for r in out["source mixing"]} <= {r[0] for r in keep.values()}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in size)
    words = Counter()
    for b, _, _, doc, copy, *_, length, _ in out["best-fit packing"]:
        words[doc, copy] += length
    assert Counter((d, n) for (d, _), n in words.items()) == Counter((r[0], test_mixing.words(r[1])) for r in out["source mixing"])
    assert all(capacity in PackingPlan().capacities and used <= capacity for _, capacity, used, *_ in out["best-fit packing"])


def test_run_and_empty_table(spark, tmp_path):
    spark.createDataFrame(documents(), DOCS).write.parquet(str(tmp_path / "a/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() > 100
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "b/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
