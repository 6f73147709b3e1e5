"""Similar pairs of facts without a row for each two facts that share a word.

A pair reaches the threshold only if its content words overlap enough given what its tags and concept add. Under a shared
concept word the least overlap is low, so that nearly all facts of the concept share a frequent word: they are compared
as blocks in memory (``blockjoin``). Without one the least overlap is high, and facts meet in
tokens of a prefix: a fact's tokens, rarest first, up to the length within which two facts of the needed Jaccard
similarity must meet (Chaudhuri et al. 2006). Where they meet, the places of the token in both orders bound what
they can still reach. Candidates are then scored exactly; facts whose tags have no partner take no part.
Tokens are compared by 64-bit hash.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..plans.lineage import materialise, remove, scratch
from . import blockjoin

#: So many of the most frequent tokens are put last; which ones they are changes speed, not results.
FREQUENT = 1024
#: Facts of a concept word that are sorted together; profiles (tags and concept) up to which those without a partner are left out.
TOGETHER, PROFILES = 16384, 1024


def _hashed(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def prepared(facts: DataFrame, fresh: bool = True) -> DataFrame:
    """``node_id, agent_id, concept, w, t, c, fresh``: token sets of content, tags and concept, as hashes."""
    sets = {"w": T.token_hashes(F.col("content")), "t": _hashed(T.tag_set(F.col("tags"))), "c": T.token_hashes(F.col("concept"))}
    return facts.select("node_id", "agent_id", "concept", *(x.alias(k) for k, x in sets.items()), F.lit(fresh).alias("fresh"))


def score(a: str = "a", b: str = "b") -> Column:
    return T.composite(*(T.jaccard(F.col(f"{a}.{k}"), F.col(f"{b}.{k}")) for k in "wtc"))


def _ordered(ready: DataFrame) -> DataFrame:
    """``ready`` with ``ws``: content tokens with the most frequent last. Materialised: prefixes of several lengths are cut from it."""
    seen = ready.select(F.explode("w").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    frequent = seen.orderBy(F.desc("n"), "token").limit(FREQUENT).agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("f"))
    frequent = frequent.select(F.transform("f", lambda x: x["token"]).alias("frequent"))  # one row
    ws = F.concat(F.array_except("w", "frequent"), F.array_intersect("frequent", "w"))
    return materialise(ready.crossJoin(F.broadcast(frequent)).select("node_id", "agent_id", "fresh", "c", ws.alias("ws")))


def _prefixes(ordered: DataFrame, least: float) -> DataFrame:
    """Rarest tokens and their places, as many as a partner with Jaccard ``least`` can't all lack."""
    size = F.size("ws")
    prefix = F.slice("ws", 1, F.greatest(size - F.ceil(size * least - 1e-9) + 1, F.lit(0)).cast("int"))
    return ordered.select("agent_id", "node_id", "fresh", "c", size.alias("size"), F.posexplode(prefix).alias("place", "token"))


def _meeting(prefixes: DataFrame, key: list[str], least: float) -> DataFrame:
    """Pairs with a fresh fact that meet in a token and can reach a Jaccard similarity of ``least`` from there."""
    side = lambda x: [F.col(k).alias(f"{k}_{x}") for k in ("node_id", "fresh", "size", "place")]
    left, right = prefixes.where("fresh").select(*key, *side("l")), prefixes.select(*key, *side("r"))
    once = (F.col("node_id_l") < F.col("node_id_r")) | ((F.col("node_id_l") > F.col("node_id_r")) & ~F.col("fresh_r"))
    # before the first token they share, they share none: from it on, no more than the shorter rest
    reach = F.least(F.col("size_l") - F.col("place_l"), F.col("size_r") - F.col("place_r"))
    fine = (F.least("size_l", "size_r") + 1e-9 >= F.greatest("size_l", "size_r") * least) & (reach + 1e-6 >= least / (1 + least) * (F.col("size_l") + F.col("size_r")))
    met = left.join(right, key).where(once & fine)
    return met.select(F.least("node_id_l", "node_id_r").alias("a"), F.greatest("node_id_l", "node_id_r").alias("b")).distinct()


def _near(ready: DataFrame, threshold: float, folder: str) -> DataFrame:
    """``(a, b, score)`` of pairs that share a concept word: rows are written once, as blocks, and compared block by block."""
    spark = ready.sparkSession
    weights, size = vocab.SIMILARITY_WEIGHTS, F.size("w")
    keyed = ready.where(F.col("agent_id").isNotNull()).withColumn("g", F.explode("c"))
    groups = materialise(keyed.groupBy("agent_id", "g").agg(F.count("*").alias("n")))
    rows = groups.agg(F.sum("n")).first()[0] or 0
    large = groups.where(F.col("n") > blockjoin.BLOCK)
    spread = max(spark.sparkContext.defaultParallelism, -(-rows // TOGETHER))
    salt = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("w"), F.ceil(F.col("n") / TOGETHER)))  # equal facts stay together
    # facts without words are left out where blocks are cut: a filter here would move below the sets and work them out twice
    sized = keyed.withColumn("w", F.sort_array("w")).join(F.broadcast(large), ["agent_id", "g"], "left").withColumn("salt", salt)
    dealt = sized.repartition(spread, "agent_id", "g", "salt").sortWithinPartitions("agent_id", "g", "salt", F.desc("fresh"), "t", "c", size, F.xxhash64("w"))
    written = dealt.select("agent_id", "g", "n", "node_id", "fresh", "t", "c", "w").mapInArrow(partial(blockjoin.cut_blocks, folder), blockjoin.SUMMARY)
    blocks = materialise(written)
    side = lambda x: blocks.select("run", *(F.col(k).alias(f"{k}_{x}") for k in ("path", "fresh", "lo", "hi")))
    least = (threshold - weights[1] - weights[2]) / weights[0]
    fine = (F.col("hi_l") + 1e-9 >= F.col("lo_r") * least) & (F.col("hi_r") + 1e-9 >= F.col("lo_l") * least)
    met = side("l").join(side("r"), "run").where((F.col("path_l") <= F.col("path_r")) & (F.col("fresh_l") | F.col("fresh_r")) & fine)
    met = materialise(met.select("path_l", "path_r"))
    tasks = max(spark.sparkContext.defaultParallelism, min(-(-met.count() // 4), 4096))
    dealt = met.repartitionByRange(tasks, "path_l", "path_r").sortWithinPartitions("path_l", "path_r")  # even shares; a left block stays
    return dealt.mapInArrow(partial(blockjoin.compare, threshold, weights), blockjoin.PAIRS)


def _with_partners(ready: DataFrame, least: float) -> DataFrame | None:
    """Facts that may be similar to one without a common concept word, by what their tags add; None if there are none.

    Beyond ``PROFILES`` combinations of tags and concept nothing is left out.
    """
    w, t, _ = vocab.SIMILARITY_WEIGHTS
    profiles = ready.where("agent_id is not null").select("agent_id", "t", "c").distinct().limit(PROFILES + 1).collect()
    if len(profiles) > PROFILES:
        return ready
    sets = [(p, frozenset(p.t), frozenset(p.c)) for p in profiles]
    share = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    kept = [p for p, a, c in sets if any(p.agent_id == q.agent_id and not c & d and w + t * share(a, b) >= least - 1e-9 for q, b, d in sets)]
    if not kept:
        return None
    known = ready.sparkSession.createDataFrame(kept, ready.select("agent_id", "t", "c").schema)
    return ready.join(F.broadcast(known), ["agent_id", "t", "c"], "left_semi")


def _scored(ready: DataFrame, threshold: float, folder: str) -> DataFrame:
    w, t, c = vocab.SIMILARITY_WEIGHTS
    near, far = (threshold - t - c) / w, (threshold - t) / w
    if near <= 0:
        raise ValueError(f"a threshold of {threshold} needs no common word; it must exceed {t + c}")
    found = _near(ready, threshold, folder)
    apart = _with_partners(ready, threshold) if far <= 1 else None
    if apart is None:
        return found
    apart = materialise(apart)  # read several times below; texts are tokenised once
    met = _meeting(_prefixes(_ordered(apart), far), ["agent_id", "token"], far)
    side = lambda x: apart.select(F.col("node_id").alias(x), F.struct("w", "t", "c").alias(f"{x}_s"))
    both = met.join(side("a"), "a").join(side("b"), "b").where(~F.arrays_overlap("a_s.c", "b_s.c"))
    scored = both.select("a", "b", score("a_s", "b_s").alias("score"))
    return found.unionByName(scored.where(F.col("score") >= threshold - 1e-12))


def candidates(ready: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``, a < b by node_id, of one agent, one of them fresh: every pair that reaches ``threshold``.

    Raises where the threshold is so low that pairs without a common content word could reach it.
    """
    return _scored(ready, threshold, _folder(ready)).select("a", "b")


def _folder(df: DataFrame) -> str:
    return scratch(df.sparkSession, "blocks")


def similar_pairs(facts: DataFrame, threshold: float = vocab.LINK_THRESHOLD, new: DataFrame | None = None) -> DataFrame:
    """``(a, b, score)``, a < b: all pairs of an agent's facts with composite similarity of ``threshold`` and more.

    With ``new`` (rows of the same columns that aren't in ``facts``) only pairs that hold one of them: blocks of
    old facts are compared with blocks of new ones alone, never among themselves. Facts without content words,
    tags or agent are similar to none; ids must be unique. The blocks are removed when the pairs are there.
    """
    ready = prepared(facts) if new is None else prepared(facts, fresh=False).unionByName(prepared(new))
    folder = _folder(ready)
    try:
        return materialise(_scored(ready, threshold, folder))
    finally:
        remove(ready.sparkSession, folder)


def unlinked(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b) without a SIMILAR_TO edge in either direction."""
    known = edges.where(F.col("edge_type") == "SIMILAR_TO").select(
        F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")
    ).distinct()
    return pairs.join(known, ["a", "b"], "left_anti")


def link_similar(
    facts: DataFrame, edges: DataFrame | None = None, threshold: float = vocab.LINK_THRESHOLD, bidirectional: bool = True, new: DataFrame | None = None
) -> DataFrame:
    """SIMILAR_TO edges to append: ``source_id, target_id, edge_type, similarity_score`` (four decimals); ``new`` as in :func:`similar_pairs`."""
    pairs = similar_pairs(facts, threshold, new)
    pairs = pairs if edges is None else unlinked(pairs, edges)
    rounded = F.round("score", 4).alias("similarity_score")
    shaped = lambda s, t: pairs.select(F.col(s).alias("source_id"), F.col(t).alias("target_id"), F.lit("SIMILAR_TO").alias("edge_type"), rounded)
    return shaped("a", "b").unionAll(shaped("b", "a")) if bidirectional else shaped("a", "b")
