import random
from collections import Counter, defaultdict

from mnemora.llm import packing
from mnemora.llm.packing import PackingPlan

SMALL = PackingPlan(capacities=(16, 32, 64), fixed=4.0, shard_items=150)
DOCS = "doc_id long, text string, lang string, length long, bin_id string"


def brute_best_fit(lengths, plan, opening):
    """The same rules over a plain list of bins; of bins with equal room, the one filled last."""
    bins, at, touched = [], [], {}
    for k, n in enumerate(lengths):
        fitting = [(c - u, i) for i, (c, u) in enumerate(bins) if c - u >= n]
        if fitting:
            least = min(x for x, _ in fitting)
            b = max((i for x, i in fitting if x == least), key=touched.get)
        else:
            allowed = [c for c in sorted(plan.capacities) if c >= n]

            def hoped(c):
                """Words a bin of ``c`` would hold if all that comes were put into it where it fits."""
                words = n
                for m in lengths[k + 1 :]:
                    words += m if words + m <= c else 0
                return max(1, words)

            c = {"longest": allowed[-1], "shortest": allowed[0]}.get(opening) or min(allowed, key=lambda c: plan.cost(c) / hoped(c))
            b = len(bins)
            bins.append((c, 0))
        bins[b] = (bins[b][0], bins[b][1] + n)
        touched[b] = k
        at.append(b)
    used = [u for _, u in bins]
    return used, sum(plan.cost(min(c for c in plan.capacities if c >= u)) for u in used)


def test_best_fit_equals_a_plain_search():
    rng = random.Random(0)
    for _ in range(60):
        lengths = sorted((rng.choice([0, 1, 5, 16, 17, 30, 40, 64]) for _ in range(rng.randint(1, 60))), reverse=True)
        for opening in ("least", "longest", "shortest"):
            at, used, cost = packing.best_fit(lengths, SMALL, opening)
            want, want_cost = brute_best_fit(lengths, SMALL, opening)
            assert packing.best_fit(lengths, SMALL, "least", 2)[:2] == packing.best_fit(lengths, SMALL, "longest")[:2]
            assert sorted(used) == sorted(want) and abs(cost - want_cost) < 1e-9
            assert [sum(n for n, b in zip(lengths, at, strict=True) if b == i) for i in range(len(used))] == used


def rows():
    rng = random.Random(1)
    data = [(i, " ".join(["w"] * rng.choice([1, 3, 9, 16, 31, 64, 65, 200])), "en", 1, "x") for i in range(400)]
    return data + [(7, data[7][1], "en", 1, "x")] * 200 + [(900, None, None, None, None), (901, "", "", 0, ""), (None, "no id", "en", 1, "x"), (902, "long " * 5000, "en", 1, "x")]


def test_every_word_is_packed_once(spark):
    data = rows()
    df = spark.createDataFrame(data, DOCS)
    got = packing.pack_documents(df, SMALL).collect()
    want = Counter((i, len((t or "").split())) for i, t, *_ in data)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.copy].append((r.start, r.length, r.piece))
        bins[r.bin_id].append(r)
    found = Counter()
    for (i, _), ps in pieces.items():
        end = 0
        for k, (start, length, piece) in enumerate(sorted(ps)):
            assert start == end and piece == k and length <= 64
            end += length
        found[i, end] += 1
    assert found == want
    for rs in bins.values():
        end = 0
        for r in sorted(rs, key=lambda r: (r.offset, r.length)):
            assert r.offset == end
            end += r.length
        assert rs[0].bin_words == end and rs[0].capacity == min(c for c in SMALL.capacities if c >= end)
    assert sum(x.bin_words for x in {r.bin_id: r for r in got}.values()) / sum(r.capacity for r in {r.bin_id: r for r in got}.values()) > 0.9
    again = packing.pack_documents(df.repartition(5), SMALL).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_opening_by_what_is_left_is_cheaper():
    """On lengths like the documents', neither always the shortest nor always the longest bin is as cheap."""
    rng, plan = random.Random(5), PackingPlan()
    cheaper = 0
    for _ in range(10):
        lengths = sorted((min(8192, int(rng.lognormvariate(6, 1.1))) for _ in range(1500)), reverse=True)
        cost = {o: packing.best_fit(lengths, plan, o)[2] for o in ("least", "longest", "shortest")}
        cheaper += cost["least"] < min(cost["longest"], cost["shortest"])
        used = packing.pack_shard(lengths, plan)[1]
        assert sum(plan.cost(min(c for c in plan.capacities if c >= u)) for u in used) <= min(cost.values())
    assert cheaper >= 8


def test_shards_are_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 60).alias("length"))
    got = packing.pack(df, SMALL).withColumn("task", F.spark_partition_id())
    assert got.select("task").distinct().count() >= 8
