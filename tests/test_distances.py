"""Distances from many starts against those of the plain traversal."""

import random

import pytest
from mnemora.operators import graphstore
from pyspark.sql import functions as F

NODES = "node_id string, node_type string, properties map<string,string>, graph_origin string"
EDGES = "edge_id string, source_id string, target_id string, edge_type string, properties map<string,string>, graph_origin string"


@pytest.mark.parametrize("direction, hops", [("both", 3), ("outgoing", 1), ("incoming", 2)])
def test_o99_distances_from_equal_those_of_the_traversal(spark, direction, hops):
    rng = random.Random(9)
    nodes = spark.createDataFrame([(f"n{i:02d}", "ab"[i % 2], {"_deleted": "1"} if i == 7 else {}, "l") for i in range(24)], NODES)
    ends = [(f"n{rng.randrange(24):02d}", f"n{rng.randrange(24):02d}") for _ in range(30)] + [("n03", "n03")]
    edges = spark.createDataFrame([(f"e{i}", s, t, "XY"[i % 3 == 0], {}, "l") for i, (s, t) in enumerate(ends)], EDGES)
    args = nodes, edges, nodes.where("node_type = 'a'"), ["X"], hops, direction, F.col("node_id") != "n05"
    rows = lambda df: sorted(tuple(r) for r in df.select("start_id", "node_id", "hops").collect())
    got = rows(graphstore.distances_from(*args))
    assert got and got == rows(graphstore.distances(graphstore.traverse(*args)))
