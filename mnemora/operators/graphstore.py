"""The property graph as two DataFrames: scans, search, changes, neighbours, traversal, chains.

``nodes``: node_id, node_type, properties map<string,string>, graph_origin. ``edges``: edge_id,
source_id, target_id, edge_type, properties, graph_origin. Limits come after a total order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import materialise
from ..sources.catalog import identifier

LEAST = -(1 << 63)


def live(nodes: DataFrame) -> DataFrame:
    """Nodes that aren't marked as deleted."""
    return nodes.where(F.coalesce(F.col("properties")["_deleted"], F.lit("")) == "")


def _matching(nodes: DataFrame, node_type: str | None, filters: Mapping[str, str] | None) -> DataFrame:
    if node_type is not None:
        nodes = nodes.where(F.col("node_type") == node_type)
    for key, value in (filters or {}).items():
        nodes = nodes.where(F.col("properties")[identifier(key)] == str(value))
    return nodes


def query_nodes(nodes: DataFrame, node_type: str, filters: Mapping[str, str] | None = None, limit: int = 50) -> DataFrame:
    return _matching(nodes, node_type, filters).orderBy("node_id").limit(limit)


def query_nodes_ordered(
    nodes: DataFrame, node_type: str, filters: Mapping[str, str] | None, order_by: str, numeric: bool = False, descending: bool = False,
    limit: int = 50
) -> DataFrame:
    """Sorts by a property, then cuts. Numeric order takes what is missing or no number as the least number."""
    value: Column = F.coalesce(F.col("properties")[identifier(order_by)], F.lit(""))
    if numeric:
        value = F.coalesce(value.try_cast("bigint"), F.lit(LEAST))
    return _matching(nodes, node_type, filters).orderBy(value.desc() if descending else value.asc(), "node_id").limit(limit)


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def count_nodes(nodes: DataFrame, node_type: str | None = None, filters: Mapping[str, str] | None = None) -> DataFrame:
    """One row ``n``; a store that can't be read raises instead of counting nothing."""
    return _matching(nodes, node_type, filters).agg(F.count("*").alias("n"))


def bulk_edges(nodes: DataFrame, edges: DataFrame, edge_type: str) -> DataFrame:
    """``(source_id, target_id)`` of all edges of a type between live nodes; an unknown type has none."""
    ids = live(nodes).select("node_id")
    found = edges.where(F.col("edge_type") == edge_type).select("source_id", "target_id")
    return found.join(
        ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi"
    ).join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")


def search_nodes(
    nodes: DataFrame, node_type: str, fields: Sequence[str], query: str, filters: Mapping[str, str] | None = None, limit: int = 10
) -> DataFrame:
    """Nodes one of whose ``fields`` contains the whole query, in any case."""
    hit = reduce(
        lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col("properties")[identifier(f)]), F.lit(query.lower())), F.lit(False)) for f in fields),
        F.lit(False)
    )
    return _matching(nodes, node_type, filters).where(hit).orderBy("node_id").limit(limit)


def search_all_properties(nodes: DataFrame, query: str, node_type: str | None = None, limit: int = 50) -> DataFrame:
    hit = F.exists(F.map_values("properties"), lambda v: F.contains(F.lower(v), F.lit(query.lower())))
    return _matching(nodes, node_type, None).where(hit).orderBy("node_id").limit(limit)


# -- changes ---------------------------------------------------------------------------------------


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Adds nodes; a known id is replaced, and revived if it was marked as deleted."""
    return nodes.join(new.select("node_id"), "node_id", "left_anti").unionByName(new.dropDuplicates(["node_id"]))


def update_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Overlays ``changes`` (node_id, set_properties) on the properties of known nodes."""
    merged = F.map_concat(
        F.map_filter("properties", lambda k, _: ~F.coalesce(F.array_contains(F.map_keys("set_properties"), k), F.lit(False))),
        F.coalesce("set_properties", F.create_map().cast("map<string,string>"))
    )
    joined = nodes.join(changes.select("node_id", "set_properties"), "node_id", "left")
    return joined.select(
        "node_id", "node_type", F.when(F.col("set_properties").isNull(), F.col("properties")).otherwise(merged).alias("properties"), "graph_origin"
    )


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes in ``ids`` (node_id) and their edges."""
    gone = ids.select("node_id").distinct()
    kept = edges.join(
        gone.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti"
    ).join(gone.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), kept


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(edges with the new ones, rejected)``: an edge needs both its ends; a missing edge_id is derived."""
    ids = nodes.select("node_id").distinct()
    named = new.withColumn("edge_id", F.coalesce("edge_id", F.concat_ws("->", "source_id", "edge_type", "target_id")))
    ends = named.join(
        ids.select(F.col("node_id").alias("source_id"), F.lit(True).alias("has_source")), "source_id", "left"
    ).join(ids.select(F.col("node_id").alias("target_id"), F.lit(True).alias("has_target")), "target_id", "left")
    sound = F.coalesce(F.col("has_source") & F.col("has_target"), F.lit(False))
    return edges.unionByName(ends.where(sound).select(*edges.columns)), ends.where(~sound).select(*edges.columns)


def delete_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select("source_id", "target_id", "edge_type"), ["source_id", "target_id", "edge_type"], "left_anti")


# -- walks -----------------------------------------------------------------------------------------


def steps(edges: DataFrame, edge_types: Sequence[str] | None = None, direction: str = "outgoing") -> DataFrame:
    """``(here, there, edge_id, edge_type, side)``: edges as they may be walked; both sides for ``both``."""
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"unknown direction: {direction!r}")
    if edge_types is not None:
        edges = edges.where(F.col("edge_type").isin(*edge_types))
    out = edges.select(F.col("source_id").alias("here"), F.col("target_id").alias("there"), "edge_id", "edge_type", F.lit(0).alias("side"))
    back = edges.select(F.col("target_id").alias("here"), F.col("source_id").alias("there"), "edge_id", "edge_type", F.lit(1).alias("side"))
    return out if direction == "outgoing" else back if direction == "incoming" else out.unionAll(back)


def query_neighbors(
    nodes: DataFrame, edges: DataFrame, starts: DataFrame, edge_type: str | None = None, direction: str = "outgoing", limit: int = 50
) -> DataFrame:
    """``(start_id, node_id, edge_id, edge_type, side)`` around each row of ``starts`` (node_id).

    Outgoing edges come first; a self loop shows twice under ``both``. ``limit`` holds per start.
    """
    walk = steps(edges, None if edge_type is None else [edge_type], direction)
    found = starts.select(F.col("node_id").alias("start_id")).join(walk, F.col("start_id") == F.col("here")).join(
        live(nodes).select("node_id"), F.col("there") == F.col("node_id"), "left_semi"
    )
    order = Window.partitionBy("start_id").orderBy("side", "edge_type", "there", "edge_id")
    ranked = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    return ranked.select("start_id", F.col("there").alias("node_id"), "edge_id", "edge_type", "side")


def traverse(
    nodes: DataFrame, edges: DataFrame, starts: DataFrame, edge_types: Sequence[str] | None = None, max_hops: int = 3, direction: str = "outgoing",
    expand: Column | None = None
) -> DataFrame:
    """``(start_id, from_id, to_id, edge_id, edge_type, hops, crossed)``: every edge crossed within ``max_hops``.

    An edge is crossed to a visited node too, but only first visits are walked on; ``expand`` over the
    columns of ``nodes`` keeps others from being entered. ``crossed`` marks another graph origin. The hops
    are unrolled: one join per hop, against the nodes not visited before.
    """
    allowed = live(nodes) if expand is None else live(nodes).where(expand)
    origin = live(nodes).select(F.col("node_id").alias("id"), F.col("graph_origin").alias("o"))
    walk = steps(edges, edge_types, direction)
    walk = walk.join(origin.select(F.col("id").alias("here"), F.col("o").alias("here_o")), "here").join(
        origin.select(F.col("id").alias("there"), F.col("o").alias("there_o")), "there"
    )
    walk = walk.join(
        allowed.select(F.col("node_id").alias("there")), "there", "left_semi"
    ).withColumn("crossed", ~F.col("here_o").eqNullSafe(F.col("there_o")))
    frontier = starts.select(F.col("node_id").alias("start_id"), F.col("node_id").alias("here")).distinct()
    visited, out = frontier, None
    for hop in range(1, max_hops + 1):
        paths = frontier.join(walk, "here").select(
            "start_id", F.col("here").alias("from_id"), F.col("there").alias("to_id"), "edge_id", "edge_type", F.lit(hop).alias("hops"), "crossed"
        )
        out = paths if out is None else out.unionAll(paths)
        if hop < max_hops:
            frontier = paths.select("start_id", F.col("to_id").alias("here")).distinct().join(visited, ["start_id", "here"], "left_anti")
            visited = visited.unionAll(frontier)
    return out


def distances(reached: DataFrame) -> DataFrame:
    """``(start_id, node_id, hops)``: fewest hops from :func:`traverse`."""
    return reached.groupBy("start_id", F.col("to_id").alias("node_id")).agg(F.min("hops").alias("hops"))


def distances_from(
    nodes: DataFrame, edges: DataFrame, starts: DataFrame, edge_types: Sequence[str] | None = None, max_hops: int = 3, direction: str = "outgoing",
    expand: Column | None = None
) -> DataFrame:
    """:func:`distances` of :func:`traverse`, without a row for each edge that each start crosses.

    From its first step on a walk depends on the node entered alone. So walks begin at the distinct neighbours, starts
    with the same neighbours share what these reach, and only the result has a row per start and node.
    """
    ids = starts.select(F.col("node_id").alias("start_id")).distinct()
    first = traverse(nodes, edges, ids.withColumnRenamed("start_id", "node_id"), edge_types, 1, direction, expand)
    kin = materialise(first.groupBy("start_id").agg(F.array_sort(F.collect_set("to_id")).alias("kin")))
    classes = kin.select("kin").distinct().select("kin", F.explode("kin").alias("node_id"))
    entries = classes.select("node_id").distinct()
    entered = entries.select(F.col("node_id").alias("entry"), "node_id", F.lit(1).alias("hops"))
    if max_hops > 1:
        further = distances(traverse(nodes, edges, entries, edge_types, max_hops - 1, direction, expand))
        entered = entered.unionAll(further.select(F.col("start_id").alias("entry"), "node_id", F.col("hops") + 1))
    reached = classes.withColumnRenamed("node_id", "entry").join(entered, "entry").groupBy("kin", "node_id").agg(F.min("hops").alias("hops"))
    spread = kin.repartition(kin.sparkSession.sparkContext.defaultParallelism * 4, "start_id")
    return spread.join(reached, "kin").select("start_id", "node_id", "hops")


def chains(edges: DataFrame, edge_type: str = "SUPERSEDES") -> DataFrame:
    """``(head_id, position, node_id, reason)``: from every node that nothing supersedes, newest to oldest.

    Positions count from 0; the reason is that of the edge taken; where a node supersedes several, the smallest
    target is followed. Pointer doubling reaches a chain of any length in the logarithm of it many rounds. A chain that
    runs into a circle ends before the first node it would visit again; a circle without a head has none.
    """
    first = F.min(F.struct("target_id", F.col("properties")["reason"].alias("reason")))
    links = edges.where(F.col("edge_type") == edge_type).groupBy("source_id").agg(first.alias("e")).select("source_id", "e.*")
    heads = links.join(links.select(F.col("target_id").alias("source_id")), "source_id", "left_anti").select(F.col("source_id").alias("head_id"))
    reached = heads.select("head_id", F.lit(0).alias("position"), F.col("head_id").alias("node_id"), F.lit(None).cast("string").alias("reason"))
    jumps, length = materialise(links.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "reason")), 1
    while True:
        met = reached.join(jumps, reached["node_id"] == jumps["a"])
        further = met.select("head_id", (F.col("position") + length).alias("position"), F.col("b").alias("node_id"), jumps["reason"])
        every = reached.unionAll(further)  # of a circle's nodes the first visit stays
        once = every.groupBy("head_id", "node_id").agg(
            F.min(F.struct("position", "reason")).alias("f")
        ).select("head_id", "f.position", "node_id", "f.reason")
        before, reached = reached, materialise(once)
        if reached.join(before, ["head_id", "node_id"], "left_anti").isEmpty():
            return reached
        left, right = jumps.alias("l"), jumps.alias("r")
        jumps = materialise(
            left.join(right, F.col("l.b") == F.col("r.a")).select(F.col("l.a").alias("a"), F.col("r.b").alias("b"), F.col("r.reason").alias("reason"))
        )
        length *= 2


def provenance(edges: DataFrame, edge_type: str = "DERIVES_FROM") -> DataFrame:
    """``(node_id, episode_id)``: what facts or procedures derive from."""
    return edges.where(F.col("edge_type") == edge_type).select(F.col("source_id").alias("node_id"), F.col("target_id").alias("episode_id"))
