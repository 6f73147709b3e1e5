"""Variable-capacity best-fit packing of documents into sequences.

Items descend by length; each goes to the open bin that it fills best (of equals, the one filled last). Where none has room, a bin is
opened: for every permitted length, the items still to come are dropped into it in turn, largest first, and the
length with the least cost per word that it would hold is taken. So the lengths are chosen jointly, by what
there is to fill them with. At the end each bin shrinks to the shortest permitted length that holds its contents.
That is tried for every shard with all lengths, and without the shortest, the two shortest, ... of them to open
with, and with the shortest that fits; the cheapest result stands.

Items are dealt to shards of bounded size by a hash; a shard is packed by one task, and a bin never
crosses shards. What shards lose against one global packing is at most a few open bins each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, word_count


@dataclass(frozen=True)
class PackingPlan:
    """Permitted lengths, the cost of a sequence (fixed + length + quadratic * length^2) and the shard size.

    With the costs given, a full sequence of 2048 or 4096 words costs 1.094 a word, a shorter or longer one 1.141.

    ``run`` bounds the multiplicity that one row carries: repeated documents are counted before the
    shuffle and dealt in runs of so many copies.
    """

    capacities: tuple[int, ...] = (1024, 2048, 4096, 8192)
    fixed: float = 128.0
    quadratic: float = 1.0 / 65536
    shard_items: int = 50_000
    run: int = 64
    max_tasks: int = 20_000

    def cost(self, capacity: int) -> float:
        return self.fixed + capacity + self.quadratic * capacity * capacity


class _Remaining:
    """The items not yet placed, by length, to see what would fill a bin."""

    def __init__(self, lengths: Sequence[int], longest: int):
        self.counts = [0] * (longest + 1)
        for n in lengths:
            self.counts[n] += 1
        self.mask = sum(1 << n for n, k in enumerate(self.counts) if n and k)  # bit n: some item of n words is left

    def take(self, n: int) -> None:
        self.counts[n] -= 1
        if n and not self.counts[n]:
            self.mask ^= 1 << n

    def fill(self, room: int) -> int:
        """Words that fit into ``room``, the largest item that fits being taken again and again."""
        words = 0
        mask = self.mask & ((1 << (room + 1)) - 1)
        while mask:
            n = mask.bit_length() - 1
            k = min(self.counts[n], (room - words) // n)
            words += k * n
            mask &= (1 << min(n, room - words + 1)) - 1  # smaller ones that still fit
        return words


def best_fit(lengths: Sequence[int], plan: PackingPlan, opening: str, unopened: int = 0) -> tuple[list[int], list[int], float]:
    """Bin of each item, words in each bin, total cost after shrinking. ``lengths`` must descend.

    ``opening``: ``least`` (cost per word by what is left to fill a bin), ``longest`` or ``shortest``;
    the ``unopened`` shortest lengths are left to shrinking.
    """
    caps = sorted(plan.capacities)
    room: list[list[int]] = [[] for _ in range(caps[-1] + 1)]  # open bins by words left
    left_mask = 0  # bit w: some open bin has w words left
    used: list[int] = []
    at: list[int] = []
    rest = _Remaining(lengths, caps[-1])
    for n in lengths:
        rest.take(n)
        fitting = left_mask >> n
        if fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                left_mask ^= 1 << left
        else:
            allowed = [c for c in caps[unopened:] if c >= n]
            if opening == "longest":
                left = allowed[-1]
            elif opening == "shortest":
                left = allowed[0]
            else:
                left = min(allowed, key=lambda c: plan.cost(c) / max(1, n + rest.fill(c - n)))
            b = len(used)
            used.append(0)
        used[b] += n
        left -= n
        room[left].append(b)
        left_mask |= 1 << left
        at.append(b)
    return at, used, sum(plan.cost(next(c for c in caps if c >= u)) for u in used)


def pack_shard(lengths: Sequence[int], plan: PackingPlan) -> tuple[list[int], list[int]]:
    """The cheapest of the packings tried; ties go to the first."""
    tried = [best_fit(lengths, plan, "least", k) for k in range(len(plan.capacities))]
    tried.append(best_fit(lengths, plan, "shortest"))
    return min(tried, key=lambda x: x[2])[:2]


_PLACED = "bin_id long, capacity long, bin_words long, doc_id long, copy long, piece long, start long, length long, offset long"


def pack(items: DataFrame, plan: PackingPlan = PackingPlan()) -> DataFrame:
    """One row per piece from ``(doc_id, length)``: its bin, and where it lies in document and bin.

    A document longer than the longest capacity is cut into pieces of that capacity and a rest, so
    nothing is lost; a document of length zero (null or blank text) takes no room but gets its row;
    repeated rows are packed as copies 0, 1, ...; null ids are an id; no items give no bins. The result
    depends on the items alone, not on their order or partitioning.
    """
    longest = max(plan.capacities)
    counted = items.groupBy("doc_id", "length").agg(F.count("*").alias("n"))
    runs = counted.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(plan.run).cast("long"))))
    runs = runs.withColumn("last", F.least(F.col("first") + plan.run, F.col("n")) - 1)
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / longest), F.lit(1)) - 1)
    rows = cut(runs.select("doc_id", "length", "first", "last", F.explode(pieces).alias("piece")))
    total = rows.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0
    shards = -(-total // plan.shard_items) or 1
    tasks = min(2 * shards, plan.max_tasks)  # stated, as adaptive execution would put these small rows into one task
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "length", "first", "piece"), F.lit(shards))).repartition(tasks, "shard")

    def run(table: pa.Table) -> pa.Table:
        every = []
        for doc, length, first, last, piece, shard in zip(
            *(table.column(c).to_pylist() for c in ("doc_id", "length", "first", "last", "piece", "shard")), strict=True
        ):
            start = piece * longest
            size = min(longest, length - start)
            every += [(-size, doc is None, doc or 0, length, copy, piece, start) for copy in range(first, last + 1)]
        every.sort()
        at, used = pack_shard([-x[0] for x in every], plan)
        caps = [next(c for c in sorted(plan.capacities) if c >= u) for u in used]
        filled, out = [0] * len(used), {name.split()[0]: [] for name in _PLACED.split(", ")}
        for (size, missing, doc, _, copy, piece, start), b in zip(every, at, strict=True):
            row = ((shard << 32) + b, caps[b], used[b], None if missing else doc, copy, piece, start, -size, filled[b])
            for values, x in zip(out.values(), row, strict=True):
                values.append(x)
            filled[b] -= size
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return rows.groupBy("shard").applyInArrow(run, _PLACED)


def pack_documents(docs: DataFrame, plan: PackingPlan = PackingPlan()) -> DataFrame:
    """Packs whole documents by their number of words; see :func:`pack` for nulls, blanks and repeated rows. Other columns are left out."""
    return pack(docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text").cast("string")).alias("length")), plan)
