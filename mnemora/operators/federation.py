"""Several stores read as one, and the registry of the agents that share them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graphstore

LOCAL_CONFIDENCE, REMOTE_CONFIDENCE = 1.0, 0.9


def merge(stores: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Nodes of all stores with ``source``: one per id, then one per content, earlier stores and smaller ids first.

    A node that another store repeats under its id is gone before contents are compared.
    """
    every = None
    for place, (name, nodes) in enumerate(stores):
        tagged = nodes.withColumns({"source": F.lit(name), "__place": F.lit(place)})
        every = tagged if every is None else every.unionByName(tagged)
    once = every.withColumn("__n", F.row_number().over(Window.partitionBy("node_id").orderBy("__place"))).where("__n = 1")
    hashed = once.withColumn("content_hash", T.node_hash(F.col("node_type"), F.col("properties")))
    first = hashed.withColumn("__n", F.row_number().over(Window.partitionBy("content_hash").orderBy("__place", "node_id"))).where("__n = 1")
    return first.drop("__n", "__place")


def federated_query(
    stores: Sequence[tuple[str, DataFrame]], node_type: str, fields: Sequence[str], query: str, confirmations: DataFrame, limit: int = 10
) -> DataFrame:
    """Annotated hits over all stores: ``node_id, source, confidence, confirmation_count``; the limit comes after deduplication."""
    found = merge([(n, graphstore.search_nodes(df, node_type, fields, query, limit=2147483632)) for n, df in stores])
    local = stores[0][0]
    annotated = found.join(confirmations, "node_id", "left").select(
        "node_id", "source", F.when(F.col("source") == local, LOCAL_CONFIDENCE).otherwise(REMOTE_CONFIDENCE).alias("confidence"),
        F.coalesce("confirmation_count", F.lit(0)).alias("confirmation_count")
    )
    return annotated.orderBy(F.desc("confidence"), F.desc("confirmation_count"), "node_id").limit(limit)


def federated_neighbors(stores: Sequence[tuple[str, DataFrame, DataFrame]], starts: DataFrame, direction: str = "outgoing") -> DataFrame:
    """``(start_id, node_id, edge_type, source)``: neighbours in all stores, one per edge type and content."""
    every = None
    for place, (name, nodes, edges) in enumerate(stores):
        near = graphstore.query_neighbors(nodes, edges, starts, direction=direction, limit=2147483632).join(
            nodes.select("node_id", T.node_hash(F.col("node_type"), F.col("properties")).alias("h")), "node_id"
        )
        near = near.select("start_id", "node_id", "edge_type", "h", F.lit(name).alias("source"), F.lit(place).alias("place"))
        every = near if every is None else every.unionAll(near)
    order = Window.partitionBy("start_id", "edge_type", "h").orderBy("place", "node_id")
    return every.withColumn("n", F.row_number().over(order)).where("n = 1").select("start_id", "node_id", "edge_type", "source")


def crosses_boundary(reached: DataFrame) -> DataFrame:
    """``(start_id, crossed_boundaries)`` of a traversal."""
    return reached.groupBy("start_id").agg(F.bool_or("crossed").alias("crossed_boundaries"))


# -- the hive --------------------------------------------------------------------------------------


def register_agents(agents: DataFrame, new: DataFrame) -> DataFrame:
    """The registry afterwards; an agent registered again keeps its row. Trust lies in [0, 1], 0 if missing."""
    checked = new.withColumn("trust", F.coalesce("trust", F.lit(0.0)))
    checked = checked.withColumn(
        "trust",
        F.when(F.col("trust").between(0.0, 1.0), F.col("trust")).otherwise(F.raise_error(F.concat(F.lit("trust out of range: "), "agent_id")))
    )
    return agents.unionByName(checked.dropDuplicates(["agent_id"]).join(agents.select("agent_id"), "agent_id", "left_anti"), allowMissingColumns=True)


def update_trust(agents: DataFrame, changes: DataFrame) -> DataFrame:
    last = changes.groupBy("agent_id").agg(F.max_by("trust", F.col("at")).alias("__new_trust"))
    joined = agents.join(last, "agent_id", "left")
    sound = F.when(
        F.col("__new_trust").isNull() | F.col("__new_trust").between(0.0, 1.0), F.coalesce("__new_trust", "trust")
    ).otherwise(F.raise_error(F.concat(F.lit("trust out of range: "), "agent_id")))
    return joined.withColumn("trust", sound).drop("__new_trust")


def agent_trust(agents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(agent_id, trust)`` of each wanted agent, 0 for strangers."""
    return wanted.select("agent_id").join(agents.select("agent_id", "trust"), "agent_id", "left").select(
        "agent_id", F.coalesce("trust", F.lit(0.0)).alias("trust")
    )


def increment_fact_counts(agents: DataFrame, stored: DataFrame) -> DataFrame:
    added = stored.groupBy("agent_id").agg(F.count("*").alias("__added"))
    return agents.join(added, "agent_id", "left").withColumn(
        "fact_count", F.coalesce("fact_count", F.lit(0)) + F.coalesce("__added", F.lit(0))
    ).drop("__added")


def assertions(rows: DataFrame, edge_type: str, properties: Mapping[str, Column] | None = None) -> DataFrame:
    """CONFIRMED_BY, CONTRADICTS or SAME_CONCEPT edges from rows (source_id, target_id)."""
    if edge_type not in ("CONFIRMED_BY", "CONTRADICTS", "SAME_CONCEPT"):
        raise ValueError(f"unknown assertion: {edge_type!r}")
    return rows.select("source_id", "target_id", F.lit(edge_type).alias("edge_type"), *(c.alias(k) for k, c in (properties or {}).items()))


def confirmation_counts(edges: DataFrame) -> DataFrame:
    return edges.where("edge_type = 'CONFIRMED_BY'").groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("confirmation_count"))


def expert_agents(agents: DataFrame, domain: str, limit: int | None = None) -> DataFrame:
    found = agents.where(F.contains(F.lower("domain"), F.lit(domain.lower()))).orderBy(F.desc(F.col("trust").cast("double")), "agent_id")
    return found if limit is None else found.limit(limit)
