"""Quality rules: a base rule on words, then compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. Natural prose lands in a band that
narrows as texts grow: below it a text repeats itself, above it the text is noise (encoded bytes,
random strings). The limits are therefore stated per length of the compressed piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SYMBOLS = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Band:
    """Pieces of at least ``min_bytes`` keep their text when low <= ratio <= high."""

    min_bytes: int
    low: float
    high: float


@dataclass(frozen=True)
class QualityRules:
    """The limits. ``bands`` ascend by ``min_bytes``; the last one that a text reaches holds for it.

    Short texts compress badly whatever they say (a frame header and no history), so the bands tighten
    with length. The limits come from :func:`fit_bands` over the clean texts of a bounded sample (see the
    README): low is their 0.5th percentile less 0.005, high the 99.5th and 0.03.

    ``chunks`` are bands of one size each: the whole text is cut into chunks of exactly ``min_bytes``, the
    last of them ending with the text (it overlaps the one before), so every byte of a text is judged in
    each size that the text reaches. A text that one chunk would hold is judged as a whole.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    level: int = 3
    bands: tuple[Band, ...] = (
        Band(128, 0.25, 1.00), Band(256, 0.520, 0.754), Band(512, 0.521, 0.703), Band(724, 0.497, 0.659),
        Band(1024, 0.488, 0.616), Band(1448, 0.473, 0.583), Band(2048, 0.460, 0.558), Band(2896, 0.444, 0.537),
        Band(4096, 0.434, 0.522), Band(5793, 0.425, 0.498), Band(8192, 0.414, 0.492), Band(11585, 0.412, 0.479),
        Band(16384, 0.404, 0.463), Band(23170, 0.397, 0.464), Band(32768, 0.355, 0.461),
    )
    chunks: tuple[Band, ...] = (Band(1024, 0.430, 0.650), Band(4096, 0.385, 0.528))

    def inside(self, size: int, packed: int) -> bool:
        own = [b for b in self.bands if size >= b.min_bytes]
        return not own or own[-1].low <= packed / size <= own[-1].high


def pieces(raw: bytes, size: int) -> Iterator[bytes]:
    """Chunks of exactly ``size`` bytes that cover ``raw``; none if it has no more bytes than that."""
    last = len(raw) - size
    if last > 0:
        for i in range(0, last, size):
            yield raw[i : i + size]
        yield raw[last:]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    pairs = code[:-1] * len(ids) + code[1:]
    _, pair_id = np.unique(pairs, return_inverse=True)  # keeps the window key within 64 bits for any text
    _, inverse, counts = np.unique(pair_id[:-1] * np.int64(len(ids)) + code[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


class Judge:
    """Measures texts one by one; holds a compressor per task."""

    def __init__(self, rules: QualityRules):
        self.rules, self.pack = rules, zstandard.ZstdCompressor(level=rules.level)

    def measure(self, text: str | None) -> tuple:
        rules, text = self.rules, text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        repeats = repeated_words(words)
        ratio, low, high, fine = None, None, None, True
        if raw:
            packed = len(self.pack.compress(raw))
            ratio = low = high = packed / len(raw)
            fine = rules.inside(len(raw), packed)
            for band in rules.chunks:
                parts = [len(self.pack.compress(x)) / band.min_bytes for x in pieces(raw, band.min_bytes)]
                if parts:
                    fine = fine and band.low <= min(parts) and max(parts) <= band.high
                    if band is rules.chunks[0]:
                        low, high = min(parts), max(parts)
        failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)
        base = len(words), chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeats
        return *base, failed, fine and not failed, len(raw), ratio, low, high


_FIELDS = {x: pa.int64() for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
_FIELDS |= {"base_failed": pa.bool_(), "kept": pa.bool_(), "n_bytes": pa.int64()}
_FIELDS |= {x: pa.float64() for x in ("ratio", "min_chunk_ratio", "max_chunk_ratio")}
_MEASURED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_bytes long, ratio double, min_chunk_ratio double, max_chunk_ratio double"
)


def measure(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: its counts, ratios and verdict.

    A null text counts as empty: no words, so the base rule rejects it. Ratios are null where there
    is nothing to compress; those of chunks are of the smallest size, or the text's where it has none. Rows stay one to one, repeated and null ids included; an empty table gives
    an empty one. A narrow pass over each whole text, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rules)
        for batch in batches:
            rows = [judge.measure(x.as_py()) for x in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
            arrays = (pa.array(c, t) for c, t in zip(columns, _FIELDS.values(), strict=True))
            yield pa.record_batch([batch.column(0), *arrays], names=["doc_id", *_FIELDS])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, _MEASURED)


def fit_bands(docs: DataFrame, max_rows: int = 20_000, least: int = 50, rules: QualityRules = QualityRules()) -> tuple[Band, ...]:
    """Bands for whole texts from clean documents: per half octave of bytes, percentiles of the ratio with a margin.

    Of ``docs`` that pass the base rule, the ``max_rows`` with the smallest hash of their id are used (a fixed
    sample, whatever the order of rows); a half octave with fewer than ``least`` of them gets no band, and an
    empty table gives none. What comes to the driver is one row per half octave.
    """
    sample = measure(docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), rules).where("not base_failed and n_bytes > 0")
    step = F.floor(2 * F.log2(F.col("n_bytes"))).alias("step")
    limits = sample.groupBy(step).agg(F.count("*").alias("n"), F.percentile("ratio", [0.005, 0.995]).alias("q"))
    rows = limits.where(F.col("n") >= least).orderBy("step").collect()
    return tuple(Band(round(2 ** (r.step / 2)), round(r.q[0] - 0.005, 3), round(r.q[1] + 0.03, 3)) for r in rows)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the rules keep."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rules)
        for batch in batches:
            yield batch.filter(pa.array([judge.measure(x.as_py())[6] for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
