"""Quality of recall and distillation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def precision_at_k(ranked: DataFrame, query: str, k: int) -> DataFrame:
    """One row ``precision``: share of the first ``k`` of ``ranked`` (pos, concept, content) with a word of the query; null without words or rows."""
    asked = F.filter(T.query_tokens(query, "plain"), lambda w: w != "*")
    top = ranked.orderBy("pos").limit(max(k, 0))
    said = T.plain_tokens(F.concat_ws(" ", "concept", "content"))
    return top.select(
        F.arrays_overlap(asked, said).cast("double").alias("hit"), asked.alias("q")
    ).agg(F.avg(F.when(F.size("q") > 0, F.col("hit"))).alias("precision"))


def labelled_precision(ranked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """``(query, precision_at_k, reciprocal_rank)`` per query of ``ranked`` (query, item_id, pos from 1) against ``labels`` (query, item_id)."""
    hits = ranked.where(F.col("pos") <= k).join(labels.distinct(), ["query", "item_id"], "left_semi").groupBy("query").agg(F.count("*").alias("n"))
    first = ranked.join(labels.distinct(), ["query", "item_id"], "left_semi").groupBy("query").agg(F.min("pos").alias("first"))
    every = labels.select("query").distinct()
    return every.join(hits, "query", "left").join(first, "query", "left").select(
        "query", (F.coalesce("n", F.lit(0)) / k).alias("precision_at_k"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank")
    )


def distil(episodes: DataFrame) -> DataFrame:
    """``(node_id, pos, fact)``: the facts in each episode, repeats included."""
    return episodes.select("node_id", F.posexplode(T.distilled_facts(F.col("content"))).alias("pos", "fact"))


def distil_corpus(episodes: DataFrame, order: str = "node_id") -> DataFrame:
    """``(fact, node_id, pos)``: facts of a corpus, each once in any case; the first episode in ``order`` that states it counts."""
    every = episodes.select("node_id", F.col(order).alias("o"), F.posexplode(T.distilled_facts(F.col("content"))).alias("pos", "fact"))
    first = every.groupBy(F.lower("fact").alias("k")).agg(F.min(F.struct("o", "pos", "fact", "node_id")).alias("f"))
    return first.select("f.fact", "f.node_id", "f.pos")


def fact_yield(episodes: DataFrame) -> DataFrame:
    """One row ``(distilled, baseline)``: distinct facts, and distinct whole episodes that say something."""
    facts = episodes.select(F.explode(T.distilled_facts(F.col("content"))).alias("f")).agg(F.count_distinct(F.lower("f")).alias("distilled"))
    whole = episodes.agg(F.count_distinct(F.lower(T.normalised_fact(F.col("content")))).alias("baseline"))
    return facts.crossJoin(whole)


def with_positions(df: DataFrame, group: str, *order: str) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
