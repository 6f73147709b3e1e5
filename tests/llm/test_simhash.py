import re
from collections import defaultdict

import xxhash
from mnemora.llm import components, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp int, key string"


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_components(ids, links):
    at = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            at[a] = at[b] = min(at[a], at[b])
    return at


def rows(spark):
    body = " ".join(f"Wort{i % 37} täglich{i}" for i in range(200))
    texts = [body, body, body.replace("täglich7 ", "anders "), body.upper(), None, "", " \t\n", "one", "one two", "one two three", "x " * 3000, " nbsp\u0085 stays", body + " end"]
    return [(i, t, "en", "s", 0, 1, "k") for i, t in enumerate(texts)] + [(0, body, "en", "s", 0, 1, "k"), (None, body, None, None, None, None, None), (None, "only without id", None, None, None, None, None)]


def test_against_brute_force(spark):
    data = rows(spark)
    found = simhash.near_duplicates(spark.createDataFrame(data, DOCS)).collect()
    assert len(found) == len(data)
    fps = {t: brute_fingerprint(t) for _, t, *_ in data}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp & (1 << 64) - 1) for r in found) == sorted((i is None, i or 0, fps[t]) for i, t, *_ in data)
    values = sorted(set(fps.values()))
    at = brute_components(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3])
    least = defaultdict(lambda: None)
    for i, t, *_ in data:
        if i is not None:
            c = at[fps[t]]
            least[c] = i if least[c] is None else min(i, least[c])
    assert {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found} == {(i, fps[t], least[at[fps[t]]]) for i, t, *_ in data}


def test_links_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(6):
            w = v
            for b in rng.sample(range(64), rng.randint(1, 5)):
                w ^= 1 << b
            values.add(w)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r.a, r.b) for r in simhash.hamming_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want and want


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame(rows(spark), DOCS)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = {(r.root, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert len(ids) == len(groups) and None in ids and 0 in ids and 1 not in ids


def test_empty_and_deterministic(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(50)] + [(7, 7), (None, 3), (900, 899), (900, 899)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "x long, y long").repartition(4), "x", "y").collect()}
    want = {i: 0 for i in range(101)} | {500 + i: 500 for i in range(50)} | {899: 899, 900: 899}
    assert got == want
