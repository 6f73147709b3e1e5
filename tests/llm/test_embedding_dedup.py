import numpy as np
from mnemora.llm import embedding_dedup
from mnemora.llm.embedding_dedup import NearVectors

VECTORS = "vec_id long, embedding array<float>, label int, n_links string, node int, key string"


def planted(n=700, dim=64, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    extra = []
    for i in range(260):  # cosines from 0.90 to 0.99 around some vectors
        c = rng.uniform(0.90, 0.99)
        u = x[i % 40]
        w = rng.standard_normal(dim)
        w -= (w @ u) * u
        extra.append((c * u + np.sqrt(1 - c * c) * w / np.linalg.norm(w)) * rng.uniform(0.1, 9))
    x = np.vstack([x, np.array(extra), x[:30], x[5][None].repeat(40, 0)]).astype(np.float32)
    return [(int(i), [float(v) for v in row], [1, 2, 3, 1][k % 4] if k < n else 1, "x", 1, "k") for k, (i, row) in enumerate(zip(rng.permutation(len(x)), x, strict=True))]


def odd():
    nan, inf = float("nan"), float("inf")
    base = [1.0] + [0.0] * 63
    return [
        (5000, None, 1, None, None, None), (5001, [], 1, "", 0, ""), (5002, [0.0] * 64, 1, "", 0, ""), (5003, [nan] * 64, 1, "", 0, ""), (5004, [inf] + base[1:], 1, "", 0, ""),
        (5005, [None] + base[1:], 1, "", 0, ""), (5006, base, None, "", 0, ""), (5007, base, None, "", 0, ""), (5008, base, 9, "", 0, ""), (5009, base[:32], 9, "", 0, ""),
        (5010, [3e38] + base[1:], 9, "", 0, ""), (None, base, 9, "", 0, ""), (5011, base + base, 9, "", 0, ""), (5012, base + base, 9, "", 0, ""), (5008, base, 9, "", 0, ""), (5013, [-0.0 if v == 0 else -v for v in base], 9, "", 0, ""),
    ]


def brute(rows):
    good = lambda r: r[0] is not None and r[1] and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])
    links = [set() for _ in rows]
    ok = [i for i, r in enumerate(rows) if good(r)]
    for label, dim in {(rows[i][2], len(rows[i][1])) for i in ok}:
        at = [i for i in ok if rows[i][2] == label and len(rows[i][1]) == dim]
        x = np.array([rows[i][1] for i in at], dtype=np.float64)
        x /= np.abs(x).max(axis=1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= 0.93), strict=True):
            if a != b:
                links[at[a]].add(at[b])
    comp = {i: rows[i][0] for i in range(len(rows))}
    for _ in rows:
        changed = False
        for i, others in enumerate(links):
            least = min([comp[i], *(comp[j] for j in others)]) if others else comp[i]
            changed, comp[i] = changed or least != comp[i], least
        if not changed:
            break
    return sorted(((r[0], len(links[i]), comp[i], r[0] is not None and comp[i] == r[0]) for i, r in enumerate(rows)), key=str)


def test_equals_all_pairs(spark):
    rows = planted() + odd()
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == brute(rows)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    u = rng.standard_normal((400, 64))
    made = embedding_dedup.sketch(u, 6, 3, 1)
    u /= np.linalg.norm(u, axis=1)[:, None]
    bits = np.unpackbits(made["code"].view(np.uint8), axis=1, bitorder="little")
    planes = np.unpackbits(made["planes"].view(np.uint8).reshape(400, 4, 8), axis=2, bitorder="little")
    level = (planes * (1 << np.arange(4))[None, :, None]).sum(axis=1)
    product, ones = level @ bits.T.astype(np.int64), bits.sum(axis=1)
    estimate = (2 * (made["step"][:, None] * product + made["low"][:, None] * ones[None]) - made["total"][:, None]) / 8 / made["factor"][None]
    error = (estimate - u @ u.T)[~np.eye(400, dtype=bool)]
    assert abs(error.mean()) < 0.01
    spread = np.sqrt((1 - made["factor"] ** 2) / made["factor"] ** 2 / 63)
    assert abs(error).max() < 5.5 * np.sqrt(spread.max() ** 2 + (made["step"].max() / 2 / made["factor"].min()) ** 2)


def test_shape_and_empty(spark):
    assert NearVectors().shape(10**9)[0] > NearVectors().shape(10**5)[0] > 4
    assert embedding_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_no_cartesian_join(spark):
    rows = [(i, 1, 64, [i], 0.8, 0.0, 0.1, 0.0, [0, 0, 0, 0], [1, 2]) for i in range(5)]
    pairs = embedding_dedup.candidate_pairs(spark.createDataFrame(rows, embedding_dedup._SKETCH), NearVectors(), 1)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
