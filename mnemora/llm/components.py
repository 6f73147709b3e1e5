"""Connected components of a link table, without gathering links anywhere.

Partitions first contract their own links with a union-find (its memory is bounded by the rows of
the partition); the remaining star edges alternate the large-star and small-star steps of Kiveris et
al. (2014) until nothing changes. Every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 65536):
        part = nodes[i : i + 65536]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["u", "v"])


def _contracted(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_contract, "u long, v long")


#: A node with more than this share of the links is a hub: there can be twice as many as its inverse at most.
_HUB_SHARE = 1 / 1000
_HUB_LEAST = 1000


def _with_least(links: DataFrame, around: DataFrame, total: int) -> DataFrame:
    """``links (u, v)`` with the smallest node ``m`` around u, for which ``around`` has ``(u, m)``.

    Rows of a hub would all meet in one task, so they get its ``m`` from a broadcast where they lie. It holds
    the nodes with over a thousandth of the ``total`` links, of which there can't be more than two thousand.
    """
    degree = links.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > max(_HUB_LEAST, int(total * _HUB_SHARE))).select("u")
    hubs = F.broadcast(around.join(F.broadcast(degree), "u").select("u", F.col("m").alias("hub_m")))
    marked = links.join(hubs, "u", "left")
    rest = marked.where("hub_m is null").select("u", "v").join(around, "u")
    return rest.select("u", "v", "m").union(marked.where("hub_m is not null").select("u", "v", "hub_m"))


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has a link to another node.

    ``component`` is the smallest node reachable. Nulls in ``a`` or ``b`` link nothing; self links,
    repeated links and both directions of a link are harmless; no links give no rows. Nodes that are
    linked with nothing don't appear: the caller keeps them as their own component.
    """
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = cut(_contracted(edges))
    before = None
    for _ in range(max_rounds):
        total = before[0] if before else edges.count()
        # large star: every larger neighbour of u moves to the smallest node around u
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        edges = _with_least(both.where("v > u"), least, total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: smaller neighbours of u, and u itself, move to the smallest of them
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = _with_least(edges, least, total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(_contracted(moved.union(least.select("u", F.col("m").alias("v")))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
