"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Within a source, documents ascend by size; each expects ``target / source_size`` copies. The prefix
sum of expected copies, shifted by one random offset per source, crosses an integer once for every
copy emitted. Ascending sizes bound the error of a source's words by its largest document.

Prefix sums take no task with a whole source in it: counts per (source, size, salt) are summed first,
their prefixes need one row per distinct size of a source and then one per salt, and only the rank
within a (source, size, salt) is taken over rows. The salt splits sizes that many rows share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 42


def _source_key(source: Column) -> Column:
    """A source's name without nulls; null differs from every name and sorts after them."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def _salt(doc_id: Column) -> Column:
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 2)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(src, source_size, target)`` from ``(src, size)``.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes.
    A target stops at ``max_repeats`` times its source's size; the excess is shared again by weight.
    Solved in one pass: by ascending cap over weight, a source is capped exactly while its cap lies
    below its share of what the sources before it left. One row per source takes part.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    ordinal = F.row_number().over(Window.orderBy("src")) - 1
    per = per.select(
        "src", "source_size", F.element_at(F.array(*map(F.lit, weights)), (ordinal % len(weights) + 1).cast("int")).cast("double").alias("w")
    )
    per = per.withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    whole, earlier = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    gone = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0.0))
    per = per.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(whole) - gone("cap")) / (F.sum("w").over(whole) - gone("w")))
    per = per.withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    return per.select("src", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("w")).alias("target"))


def with_sizes(docs: DataFrame) -> DataFrame:
    """Adds what mixing goes by: ``__m_src``, ``__m_size`` (words) and ``__m_salt``."""
    return docs.withColumns(
        {
            "__m_src": _source_key(F.col("source").cast("string")), "__m_size": word_count(F.col("text").cast("string")),
            "__m_salt": _salt(F.col("doc_id"))
        }
    )


def copies(
    sized: DataFrame, counted: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED
) -> DataFrame:
    """Adds ``__m_source_size``, ``__m_target`` and ``__m_copies`` to rows from :func:`with_sizes`.

    ``counted`` may hold the same rows' three columns ready made, to spare a second look at the texts.
    Every run gives the same copies: the offsets hash the seed and the source's name, and ranks go by
    size, salt and doc_id. Rows equal in these (repeated rows) are interchangeable. Null texts have size
    zero; a source of size zero has target zero and no copies; an empty table stays empty.
    """
    key = ["__m_src", "__m_size", "__m_salt"]
    counts = (sized if counted is None else counted).groupBy(*key).agg(F.count("*").alias("n"))
    per_size = counts.groupBy("__m_src", "__m_size").agg(F.sum("n").alias("n"))
    below = Window.partitionBy("__m_src").orderBy("__m_size").rowsBetween(Window.unboundedPreceding, -1)
    per_size = per_size.select(
        "__m_src", "__m_size", (F.col("__m_size") * F.col("n")).alias("words"), F.coalesce(F.sum("n").over(below), F.lit(0)).alias("below")
    )
    targets = source_targets(
        per_size.select(F.col("__m_src").alias("src"), F.col("words").alias("size")), weights, max_repeats
    ).withColumnRenamed("src", "__m_src")
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), F.col("__m_src")), 256), 1, 5)
    targets = targets.withColumn("offset", (F.conv(digits, 16, 10).cast("double") + 0.5) / 1048576)  # 21 bits: sums with it stay exact
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    earlier = Window.partitionBy("__m_src", "__m_size").orderBy("__m_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("within"))
    starts = starts.join(per_size.drop("words"), ["__m_src", "__m_size"]).join(targets, "__m_src")
    starts = starts.select(
        *key, (F.col("within") + F.col("below")).alias("__m_before"), F.col("source_size").alias("__m_source_size"),
        F.col("target").alias("__m_target"), F.col("offset").alias("__m_offset"), F.col("rate").alias("__m_rate")
    )
    ranked = sized.withColumn("__m_rank", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id"))).join(starts, key)
    upto = lambda k: F.floor((F.col("__m_before") + F.col("__m_rank") - k) * F.col("__m_rate") + F.col("__m_offset"))
    ranked = ranked.withColumn("__m_copies", F.least(upto(0) - upto(1), F.lit(max_repeats)).cast("long"))
    return ranked.drop("__m_before", "__m_offset", "__m_rate", "__m_rank")


def shares(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: the words that the mix takes of each document."""
    sized = cut(with_sizes(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "__m_src", "__m_size", "__m_salt"))
    found = copies(sized)
    return found.select(
        "doc_id", F.col("__m_size").alias("size"), F.col("__m_source_size").alias("source_size"), F.col("__m_target").alias("target"),
        (F.col("__m_copies") * F.col("__m_size")).alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed rows: each document as often as the sampling emits it, with its columns unchanged."""
    sized = with_sizes(docs)
    counted = cut(sized.select("__m_src", "__m_size", "__m_salt"))
    emitted = copies(sized, counted).where("__m_copies > 0").withColumn("__m_copy", F.explode(F.sequence(F.lit(1), F.col("__m_copies").cast("int"))))
    return emitted.select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 2) AS salt
  FROM documents
), s AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM d GROUP BY src
), c AS (SELECT *, CAST(source_size AS DOUBLE) * 3 AS cap FROM s
), l AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER e, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER e, 0)) AS level
  FROM c WINDOW e AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT src, source_size, CASE WHEN cap <= level * w THEN cap
         ELSE max(CASE WHEN cap > level * w THEN level END) OVER () * w END AS target,
         (CAST('0x' || substr(sha256('42|' || src), 1, 5) AS BIGINT) + 0.5) / 1048576 AS u
  FROM l
), r AS (
  SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.src ORDER BY size, salt, doc_id) AS i
  FROM d JOIN t USING (src)
)
SELECT doc_id, size, source_size, target,
       CAST(size * least(floor(i * rate + u) - floor((i - 1) * rate + u), 3) AS BIGINT) AS taken
FROM r
"""
