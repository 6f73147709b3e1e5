"""Export to and import from JSON: one folder of JSON lines per section, and a small manifest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = "1.0"
NODE_SECTIONS = ("semantic_nodes", "episodic_nodes")
EDGE_SECTIONS = ("similar_to_edges", "derives_from_edges", "supersedes_edges")
_ENDS = {
    "similar_to_edges": ("semantic_nodes", "semantic_nodes"), "derives_from_edges": ("semantic_nodes", "episodic_nodes"),
    "supersedes_edges": ("semantic_nodes", "semantic_nodes")
}


def as_json(sections: Mapping[str, DataFrame]) -> DataFrame:
    """``(section, json)``: every row of every section as one JSON object."""
    out = None
    for name, df in sections.items():
        rows = df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("json"))
        out = rows if out is None else out.unionAll(rows)
    return out


def export_json(sections: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Writes the sections below ``path`` and a manifest of counts; returns the manifest."""
    spark = next(iter(sections.values())).sparkSession
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    counts = as_json(sections).groupBy("section").agg(F.count("*").alias("n_rows"))
    counts.withColumn("format_version", F.lit(FORMAT_VERSION)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema("section string, n_rows long, format_version string").json(f"{path}/manifest")


def import_json(spark: SparkSession, path: str, current: Mapping[str, DataFrame], merge: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Sections after the import, and ``(section, imported, skipped, errors)``.

    Without ``merge`` the file replaces what is there. With it, nodes whose id is known are skipped.
    Edges need both of their ends; those without are counted as errors.
    """
    read = {n: spark.read.schema(current[n].schema).json(f"{path}/{n}") for n in current}
    return combine(read, current, merge)


def combine(read: Mapping[str, DataFrame], current: Mapping[str, DataFrame], merge: bool) -> tuple[dict[str, DataFrame], DataFrame]:
    """The rules of :func:`import_json` over sections already read."""
    after: dict[str, DataFrame] = {}
    stats = None

    def note(name: str, total: DataFrame, new: DataFrame, errors: DataFrame | None) -> None:
        nonlocal stats
        parts = [
            total.agg(F.count("*").alias("t")), new.agg(F.count("*").alias("n")),
            (errors if errors is not None else total.limit(0)).agg(F.count("*").alias("e"))
        ]
        row = parts[0].crossJoin(parts[1]).crossJoin(parts[2]).select(
            F.lit(name).alias("section"), F.col("n").alias("imported"), (F.col("t") - F.col("n") - F.col("e")).alias("skipped"),
            F.col("e").alias("errors")
        )
        stats = row if stats is None else stats.unionAll(row)

    for name in (n for n in NODE_SECTIONS if n in read):
        once = read[name].dropDuplicates(["node_id"])
        new = once.join(current[name].select("node_id"), "node_id", "left_anti") if merge else once
        note(name, read[name], new, None)
        after[name] = current[name].unionByName(new) if merge else new
    for name in (n for n in EDGE_SECTIONS if n in read):
        a, b = _ENDS[name]
        ends = read[name].join(
            after[a].select(F.col("node_id").alias("source_id")).distinct(), "source_id", "left_semi"
        ).join(after[b].select(F.col("node_id").alias("target_id")).distinct(), "target_id", "left_semi")
        sound = ends.dropDuplicates(["source_id", "target_id"])
        lost = read[name].join(ends.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti")
        new = sound.join(current[name].select("source_id", "target_id"), ["source_id", "target_id"], "left_anti") if merge else sound
        note(name, read[name], new, lost)
        after[name] = current[name].unionByName(new) if merge else new
    return after, stats
