"""Near-duplicate embeddings: randomised-rotation binary codes with correction factors.

After a random rotation, the signs of a unit vector are its code, and ``<code, vector>`` is stored as
its correction factor (Gao & Long, SIGMOD 2024). Dividing the product of code and query by the factor
estimates the cosine without bias, and its standard error is known per pair; only pairs whose upper
confidence bound reaches the threshold are computed again, in double precision. The query side is held
in 4-bit steps with random rounding, so an estimate is five population counts inside the join.

Candidates are pairs that share a bucket in one of several tables of random hyperplane signs. The
number of bits follows the number of vectors of the largest label and the number of tables the miss probability: a pair
exactly at the threshold is missed with a probability of ``miss`` at most, closer pairs far less often.
No group is compared all against all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components


@dataclass(frozen=True)
class NearVectors:
    """``sigmas``: half width of the confidence interval of an estimate, in standard errors."""

    threshold: float = 0.93
    miss: float = 1e-6
    sigmas: float = 4.5
    bucket_rows: int = 32
    seed: int = 42

    def shape(self, n: int) -> tuple[int, int]:
        """Bits per bucket and number of tables where ``n`` vectors may link (those of the largest label)."""
        bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / self.bucket_rows))))
        agree = (1 - math.acos(self.threshold) / math.pi) ** bits
        return bits, math.ceil(math.log(self.miss) / math.log1p(-agree))


@lru_cache(maxsize=8)
def _rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=8)
def _planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, 1]).standard_normal((dim, bits * tables))


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as rows of signed 64-bit words."""
    packed = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")
    return packed.view("<i8").reshape(len(bits), -1)


def sketch(vectors: np.ndarray, bits: int, tables: int, seed: int) -> dict[str, np.ndarray]:
    """Codes, correction factors, 4-bit query planes and bucket keys of the rows of ``vectors``."""
    unit = _units(vectors)
    dim = -(-unit.shape[1] // 64) * 64  # codes fill whole words
    padded = np.zeros((len(unit), dim))
    padded[:, : unit.shape[1]] = unit
    turned = padded @ _rotation(dim, seed)
    sign = turned > 0
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / 15, 1e-300)
    noise = np.random.default_rng([seed, 2]).random(dim)
    level = np.clip(np.floor((turned - low) / step + noise), 0, 15).astype(np.int64)
    signs = (unit @ _planes(unit.shape[1], bits, tables, seed) > 0).reshape(len(unit), tables, bits)
    keys = (signs @ (1 << np.arange(bits, dtype=np.int64))) + (np.arange(tables, dtype=np.int64) << 32)
    return {
        "code": _words(sign), "factor": np.abs(
            turned
        ).sum(axis=1) / math.sqrt(dim), "low": low[:, 0], "step": step[:, 0], "total": level.sum(axis=1) * step[:, 0] + low[:, 0] * dim,
        "planes": np.stack([_words(level >> j & 1) for j in range(4)], axis=1).reshape(len(unit), -1), "keys": keys,
    }


_SKETCH = "node long, label long, dim int, code array<long>, factor double, low double, step double, total double, planes array<long>, keys array<long>"


def _sketched(nodes: DataFrame, near: NearVectors, bits: int, tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(rows))
                made = sketch(part.column(2).flatten().to_numpy().reshape(len(rows), int(size)), bits, tables, near.seed)
                listed = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a.ravel(), pa.int64()), a.shape[1]).cast(pa.list_(pa.int64()))
                flat = {k: listed(v) if v.ndim == 2 else pa.array(v, pa.float64()) for k, v in made.items()}
                yield pa.record_batch(
                    [
                        part.column(0), part.column(1), pa.array([size] * len(rows), pa.int32()),
                        *(flat[k] for k in ("code", "factor", "low", "step", "total", "planes", "keys"))
                    ],
                    names=[x.split()[0] for x in _SKETCH.split(", ")]
                )

    return nodes.select("node", "label", "vector").mapInArrow(run, _SKETCH)


def candidate_pairs(sketches: DataFrame, near: NearVectors, words: int) -> DataFrame:
    """Distinct ``(a, b)``, a < b, that share a bucket and whose upper bound reaches the threshold."""
    place = ["label", "dim", "key"]
    left = sketches.select("label", "dim", F.explode("keys").alias("key"), F.col("node").alias("a"), "planes", "low", "step", "total")
    right = sketches.select("label", "dim", F.explode("keys").alias("key"), F.col("node").alias("b"), "code", "factor")
    # inner product of code bits and query levels: plane j counts 2^j, word by word; shorter codes end in nulls
    ones, product = F.lit(0), F.lit(0)
    for w in range(words):
        bits = F.get("code", F.lit(w))
        ones = ones + F.coalesce(F.bit_count(bits), F.lit(0))
        for j in range(4):
            plane = F.get("planes", (F.floor((F.col("dim") + 63) / 64) * j + w).cast("int"))
            product = product + F.coalesce(F.bit_count(bits.bitwiseAND(plane)), F.lit(0)) * (1 << j)
    width = F.floor((F.col("dim") + 63) / 64) * 64.0
    estimate = (2 * (F.col("step") * product + F.col("low") * ones) - F.col("total")) / F.sqrt(width) / F.col("factor")
    spread = (1 - F.col("factor") * F.col("factor")) / (F.col("factor") * F.col("factor")) / (width - 1) + F.pow(
        F.col("step") / (2 * F.col("factor")), 2
    )
    hopeful = estimate + near.sigmas * F.sqrt(F.greatest(spread, F.lit(0.0))) >= near.threshold
    return left.join(right, place).where((F.col("a") < F.col("b")) & hopeful).select("a", "b").distinct()


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        sizes = np.diff(a.offsets.to_numpy())
        out = np.zeros(len(batch))
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            u, v = (_units(x.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), int(size))) for x in (a, b))
            out[rows] = np.einsum("ij,ij->i", u, v)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "cosine"])


def near_vectors(vectors: DataFrame, near: NearVectors = NearVectors()) -> DataFrame:
    """``(vec_id, label, n_links, component_id, kept)``, one row per row of ``vectors``.

    Vectors are linked when their labels are equal and not null, their lengths are equal and their cosine
    reaches the threshold. Null, empty and zero vectors, and vectors with null or non-finite
    components, link with nothing, nor do rows without a vec_id (whose component is null and which
    aren't kept). Repeated vectors count as one in the search and as many in ``n_links``; rows that
    repeat a vec_id stay repeated. An empty table gives no rows.
    """
    whole = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0),
        F.lit(False)
    )
    rows = rows.withColumn("usable", usable)
    classes = rows.where("usable").groupBy("label", "vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    nodes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    groups = nodes.groupBy("label", F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    largest, longest = groups.agg(F.max("n"), F.max("dim")).first()
    bits, tables = near.shape(largest or 0)
    sketches = cut(_sketched(nodes, near, bits, tables))
    pairs = candidate_pairs(sketches, near, max(1, -(-(longest or 1) // 64)))
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("vector").alias(f"{x}_vector"))
    exact = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_vector", "b_vector").mapInArrow(
        _cosines, "a long, b long, cosine double"
    )
    links = cut(exact.where(F.col("cosine") >= near.threshold).select("a", "b"))
    linked = connected_components(links, "a", "b")
    both = links.union(links.select("b", "a")).toDF("node", "other")
    copied = nodes.where("n > 1").select(F.col("node").alias("other"), (F.col("n") - 1).alias("more"))
    more = both.join(copied, "other").select("node", "more")
    counts = both.select("node", F.lit(1).cast("long").alias("more")).union(more).groupBy("node").agg(F.sum("more").alias("others"))
    placed = nodes.join(linked, "node", "left").withColumn("root", F.coalesce("component", "node")).join(counts, "node", "left")
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ends = placed.join(named, "root").select("label", "vector", "component_id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    own = rows.where("usable").join(ends, ["label", "vector"]).select("vec_id", "label", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: All pairs: for the small tables of the comparison only.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT v.vec_id, CAST(v.label AS BIGINT) AS label, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN m ON m.a = v.vec_id
"""
