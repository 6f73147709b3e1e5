"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in at most three bits
differ in at most one bit of some half, so enumerating the ball of radius one within each half
(2 x 33 keys) and fetching the table entries stored under those keys meets every such pair; the
complete distance is then verified inside the join. Only distinct fingerprints take part, so copies
of a text cost one entry however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
_BLOCK = 1 << 15


def simhash64(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
        return int(hashes.view(np.int64)[0])
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, ones, digest = len(words) - shingle + 1, np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    lo, hi = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    for i in range(0, n, _BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(lo[i : i + _BLOCK], hi[i : i + _BLOCK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = pa.array([simhash64(x.as_py()) for x in batch.column(2)], pa.int64())
        yield pa.record_batch([batch.column(0), batch.column(1), fp], names=["doc_id", "row_hash", "fp"])


def fingerprints(docs: DataFrame, row_hash: Column | None = None) -> DataFrame:
    """``(doc_id, row_hash, fp)`` per row, from whole texts. ``row_hash`` tells rows of one doc_id apart: by default a hash of the text."""
    hashed = F.xxhash64("text") if row_hash is None else row_hash
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashed.alias("row_hash"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(_hashed, "doc_id long, row_hash long, fp long")


def _half(fp: Column, which: int) -> Column:
    """Half 0 or 1 of a fingerprint, with the number of the half above it."""
    bits = F.shiftrightunsigned(fp, 32) if which == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))
    return bits + F.lit(which << 32)


def hamming_links(distinct: DataFrame, fp: str = "fp", max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)`` with a < b for all pairs of distinct fingerprints within ``max_bits`` <= 3 bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves with balls of radius one cover up to three bits")
    base = distinct.select(F.col(fp).alias("f"))
    table = base.select(F.col("f").alias("b"), F.explode(F.array(_half(F.col("f"), 0), _half(F.col("f"), 1))).alias("key"))
    ball = F.array(*[F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)]])
    probes = base.select(F.col("f").alias("a"), F.explode(F.array(_half(F.col("f"), 0), _half(F.col("f"), 1))).alias("half"))
    probes = probes.select("a", F.explode(ball).alias("flip"), "half").select("a", F.col("half").bitwiseXOR(F.col("flip")).alias("key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return probes.join(table, "key").where(near).select("a", "b")


def near_duplicates(docs: DataFrame, row_hash: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, row_hash, fp, root, component_id``.

    ``root`` names the component by a fingerprint, ``component_id`` by its smallest doc_id (null
    where all its members have a null doc_id). Null and blank texts have fingerprint zero and are
    linked like any other; repeated rows stay repeated; an empty table gives no rows.
    """
    marked = cut(fingerprints(docs, row_hash))
    members = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = connected_components(hamming_links(members), "a", "b").withColumnRenamed("node", "fp")
    rooted = members.join(linked, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ends = cut(rooted.join(named, "root").select("fp", "root", "component_id"))
    return marked.join(ends, "fp").select("doc_id", "row_hash", "fp", "root", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all its columns) with one document of each near-duplicate group.

    The document with the smallest doc_id stays; rows without a doc_id stay only where their group
    has none with one. Of rows that share that doc_id, the one with the smallest hash of all its
    columns stays (maps, which have no hash, aside), and rows repeated in full stay once.
    """
    whole = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()))
    found = near_duplicates(docs, whole)
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("i"), F.col("row_hash").alias("h"))
    kept = found.groupBy("root").agg(F.min(order).alias("k"))
    key = lambda i, h: F.concat_ws(" ", F.coalesce(i.cast("string"), F.lit("null")), h.cast("string"))
    own = docs.withColumn("__m_key", key(F.col("doc_id").cast("long"), whole))
    # one key for both steps, null ids included: texts are shuffled once
    return own.join(
        kept.select(key(F.col("k.i"), F.col("k.h")).alias("__m_key")), "__m_key", "left_semi"
    ).dropDuplicates(["__m_key"]).select(*docs.columns)
