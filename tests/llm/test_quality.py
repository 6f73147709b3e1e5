import random
import re

import zstandard
from mnemora.llm import quality

DOCS = "doc_id long, text string, kept string, ratio int"


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def texts():
    rng = random.Random(1)
    syllables = "on er th in an re ti es or he ou is ea".split()
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    noise = lambda n: " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(9)) for _ in range(n))
    near = " ".join(f"same words again and again {i % 10}" for i in range(300))
    return {"prose": prose(80), "long": prose(6000), "noise": noise(700), "repeats": "a b c d " * 400, "near": near, "null": None, "empty": "", "blank": " \n\t\n", "lines": "one two\n\nx\none two\r\nx\n" * 3, "symbols": "#*$%&|<> é|" * 9, "spaces": "a b c d", "long noise tail": prose(900) + " " + noise(900)}


def test_counts_and_verdicts(spark):
    data = texts()
    rows = [(i, t, "x", 1) for i, t in enumerate(data.values())] + [(None, data["prose"], None, None), (0, data["prose"], "x", 1)]
    got = quality.measure(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, (name, t) in enumerate(data.items()):
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), name
    kept = {name for i, name in enumerate(data) if by[i].kept}
    assert kept == {"prose", "long"}
    raw = data["long"].encode()
    assert by[1].ratio == len(zstandard.ZstdCompressor(level=3).compress(raw)) / len(raw)


def test_rows_pass_unchanged(spark):
    data = texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(data.values())], DOCS)
    kept = quality.keep_good(df)
    assert kept.schema == df.schema
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [0, 1]
    assert quality.keep_good(df.limit(0)).count() == 0 and quality.measure(df.limit(0)).count() == 0


def test_bands_tell_labelled_documents_apart(spark):
    """Of documents that pass the base rule, the bands reject most of those labelled bad and few of the good."""
    folder = "/root/testdata/sf0.01"
    got = quality.measure(spark.read.parquet(f"{folder}/documents.parquet")).where("not base_failed")
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").groupBy("quality").agg({"*": "count", "kept": "count_if"}).collect()
    by = {r.quality: (r["count(1)"], r["count_if(kept)"]) for r in rows}
    assert by[0][0] >= 10 and by[0][1] <= 0.4 * by[0][0]
    assert by[1][1] >= 0.98 * by[1][0]


def plain_verdict(text, rules=quality.QualityRules()):
    """The verdict restated: base rule, the whole text's band, and every chunk of every size."""
    raw, ratio = (text or "").encode(), lambda x: len(zstandard.ZstdCompressor(level=3).compress(x)) / len(x)
    if brute(text)[-1]:
        return False
    own = [b for b in rules.bands if len(raw) >= b.min_bytes]
    fine = not own or own[-1].low <= ratio(raw) <= own[-1].high
    for b in rules.chunks:
        n, k = len(raw), b.min_bytes
        at = {min(i, n - k) for i in range(0, n, k)} if n > k else set()
        fine = fine and all(b.low <= ratio(raw[i : i + k]) <= b.high for i in at)
    return fine


def planted():
    """Clean prose of many lengths, and the same with something bad in it."""
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.01"
    good = {r["doc_id"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist() if r["quality"] == 1}
    clean = [r["text"] for r in pq.read_table(f"{folder}/documents.parquet").to_pylist() if r["doc_id"] in good and not brute(r["text"])[-1]]
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    noise = lambda n: " ".join("".join(rng.choice(letters) for _ in range(9)) for _ in range(n))
    long = [t for t in clean if len(t) >= 3000][:12]
    return clean, {
        "noise": [noise(n) for n in (55, 60, 90, 200, 900)],
        "noise tail": [t + " " + noise(190) for t in long],
        "noise within": [t[:1500] + " " + noise(230) + " " + t[1500:] for t in long],
        "repetition": [" ".join(t.split()[:40]) + " " + t[:300] * 12 for t in long],
        "repeated tail": [t + " " + " ".join(f"go to page {i % 7} now" for i in range(400)) for t in long],
        "symbols": [" ".join(w + "%%%" for w in t.split()) for t in long],
    }


def test_planted_texts_and_the_verdict_restated():
    judge = quality.Judge(quality.QualityRules())
    clean, bad = planted()
    assert sum(judge.measure(t)[6] for t in clean) >= 0.98 * len(clean)
    for name, texts_ in bad.items():
        assert not any(judge.measure(t)[6] for t in texts_), name
    for t in [*clean[::7], *(x for xs in bad.values() for x in xs), *texts().values()]:
        assert judge.measure(t)[6] == plain_verdict(t)


def test_limits_are_those_of_the_sample(spark):
    clean, _ = planted()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(clean)], "doc_id long, text string")
    found = quality.fit_bands(docs, least=30)
    assert len(found) >= 4 and [b.min_bytes for b in found] == sorted(b.min_bytes for b in found)
    for b in found:  # the shipped limits, from another sample, agree
        own = [x for x in quality.QualityRules().bands if x.min_bytes <= b.min_bytes + 1][-1]
        assert abs(own.low - b.low) < 0.04 and abs(own.high - b.high) < 0.06, (own, b)
    assert quality.fit_bands(docs.limit(0)) == ()
