"""What is left to count exactly between blocks, and words cut by one pattern."""

import numpy as np
from mnemora.functions import text as T
from mnemora.functions import vocab
from mnemora.operators import blockjoin
from pyspark.sql import functions as F


def blocks(seed, n, languages=2, words=6000, least=2, most=400):
    rng = np.random.default_rng(seed)
    own = rng.integers(-(2**62), 2**62, (languages, words))
    classes = []
    for k in range(n):
        spoken = own[k % languages]
        some = spoken[np.unique((rng.random(int(rng.integers(least, most))) ** 2 * words).astype(int))]
        if k % 10 == 9 and k >= languages:  # a near copy of an earlier one
            some = np.union1d(rng.permutation(classes[k - languages][0])[: max(len(classes[k - languages][0]) // 2, 1)], some[:5])
        classes.append((np.sort(some), (k % languages, 7), (9,), k % 4 > 0, [f"f{seed}-{k}"]))
    return blockjoin.Block.of([(9, classes)])


def found(x, y):
    left = blockjoin.chunks(x, *x.groups[0][1:])
    right = left if x is y else blockjoin.chunks(y, *y.groups[0][1:])
    return {(i, j): s for i, j, s in blockjoin.similar_classes(x, y, left, right, blockjoin._base(x, y), blockjoin._places(x, y), 0.6, vocab.SIMILARITY_WEIGHTS)}


def wanted(x, y):
    out = {}
    for i in range(len(x.ids)):
        for j in range(i + 1 if x is y else 0, len(y.ids)):
            a, b = set(x.tokens[x.w[i]].tolist()), set(y.tokens[y.w[j]].tolist())
            tags = 1.0 if x.t[x.profile[i]].tolist() == y.t[y.profile[j]].tolist() else 1 / 3
            score = len(a & b) / len(a | b) * 0.5 + tags * 0.2 + 0.3
            if score >= 0.6 - 1e-12 and (x.fresh[i] or y.fresh[j]):
                out[i, j] = score
    return out


def test_o60_bounds_lose_no_pair(monkeypatch):
    x, y = blocks(1, 400), blocks(2, 300)
    y = blockjoin.Block.of([(9, [(y.tokens[y.w[k]], (0, 7), (9,), True, [f"g{k}"]) for k in range(100)] + [(x.tokens[x.w[k]][::2], (k % 2, 7), (9,), False, [f"h{k}"]) for k in range(200)])])
    for rows, columns in ((512, (64, 16384)), (50, (64, 64)), (512, (16384, 16384))):
        monkeypatch.setattr(blockjoin, "ROWS", rows)
        monkeypatch.setattr(blockjoin, "COLUMNS", columns)
        for a, b in ((x, x), (x, y), (y, x)):
            a.__post_init__(), b.__post_init__()
            got, want = found(a, b), wanted(a, b)
            assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_o60_few_pairs_are_counted_exactly(monkeypatch):
    counted, exact = [], blockjoin.exact_overlaps
    monkeypatch.setattr(blockjoin, "exact_overlaps", lambda x, i, y, j, places: counted.append(len(i)) or exact(x, i, y, j, places))
    x = blocks(3, 2000, words=60_000, least=100)
    assert found(x, x)
    assert sum(counted) < 0.02 * 2000 * 1999 / 2


def test_o60_hashes_of_words_cut_by_one_pattern(spark):
    texts = ["The (quick) brown-fox, isn't 'it'?", "...", "", None, "  one　two three \x85 ab of\tTHE x.y. ..end..", "{a} [bcd] \U0001d518\U0001d518 \U0001d518\U0001d518\U0001d518 !?", "and and and"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    old = F.sort_array(F.transform(T.tokens(F.col("x")), lambda w: F.xxhash64(w)))
    rows = df.select(old.alias("old"), F.sort_array(T.token_hashes(F.col("x"))).alias("new")).collect()
    assert [r.new for r in rows] == [r.old for r in rows] and sum(len(r.new) for r in rows) > 8
