"""Token counts as delta-maintained rollups.

A batch of changes (inserts, deletes, revised texts) is tokenised once and turned into signed rows:
minus what a document counted before, plus what it counts now. Their sums by source, language and
tokenizer version are added to the totals, which are never recomputed from documents.

A store is a folder: ``state`` holds what each touched document counts after a batch, ``deltas`` the
batch's signed sums, ``commits`` one marker per batch, written last. A batch without a marker doesn't
exist for readers and is overwritten when it is tried again; a batch with one is skipped, so applying it
twice changes nothing. Every so many batches the state and the sums so far are written as one ``snapshot``;
later batches read that and what came after it, and of both only the documents they touch. One writer at a
time; any number of readers. Files go through Spark alone, so the folder can be in any store that Spark reaches.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

#: How the public byte-level vocabularies cut a text into pieces before merging (fixed value of these vocabularies).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER_SETTING = "spark.mnemora.tokenizers"
_KEYS = ["source", "lang", "tokenizer"]


def default_version(spark: SparkSession) -> tuple[str, str]:
    """Name and file of the vocabulary counted with unless told otherwise, in the folder that the session's setting names."""
    return "byte_bpe_50k", f"{spark.conf.get(TOKENIZER_SETTING, '/opt/tokenizers')}/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def _encoding(name: str, vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: DataFrame, version: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``tokenizer`` and ``n_tokens`` to ``texts`` and drops its column ``text``; null texts have none.

    ``version`` names a vocabulary file in the driver's reach; its bytes (of the fixed size of a
    vocabulary, under 2 MB) are broadcast, so executors need no file.
    """
    name, path = version or default_version(texts.sparkSession)
    with open(path, "rb") as f:
        vocabulary = texts.sparkSession.sparkContext.broadcast(f.read())
    at = texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(name, vocabulary.value).encode_ordinary
        for batch in batches:
            n = pa.array([len(encode(x.as_py() or "")) for x in batch.column(at)], pa.int64())
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [x for i, x in enumerate(batch.schema.names) if i != at]
            yield pa.record_batch([*columns, pa.array([name] * len(n), pa.string()), n], names=[*names, "tokenizer", "n_tokens"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInArrow(run, f"{fields}, tokenizer string, n_tokens long")


class TokenRollup:
    """Totals of documents and tokens by source, language and tokenizer version."""

    def __init__(self, spark: SparkSession, root: str, version: tuple[str, str] | None = None, snapshot_every: int = 16):
        self.spark, self.root, self.snapshot_every = spark, root.rstrip("/"), snapshot_every
        self.version = version or default_version(spark)

    def _done(self, part: str) -> list[str]:
        """Names of finished folders of a part, in order: ``<ordinal>-<tokenizer>-<batch id in hex>`` for commits."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        done = [x.getPath() for x in store.listStatus(path)]
        return sorted(p.getName() for p in done if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _since(self, names: list[str], tokenizer: str) -> tuple[str | None, list[str]]:
        """A tokenizer's newest snapshot and its batches after it."""
        held = [x for x in self._done("snapshots") if x.split("-")[1] == tokenizer]
        last = held[-1] if held else None
        return last, [x for x in names if x.split("-")[1] == tokenizer and (last is None or x[:9] > last[:9])]

    def _read(self, part: str, last: str | None, names: list[str]) -> DataFrame | None:
        paths = [f"{self.root}/{part}-snapshots/{last}"] if last else []
        paths += [f"{self.root}/{part}/{x}" for x in names]
        return self.spark.read.parquet(*paths) if paths else None

    def _current(self, names: list[str], keys: DataFrame | None = None) -> DataFrame | None:
        """What the documents known to this tokenizer, or those of ``keys``, count now: the rows of their newest batch."""
        every = self._read("state", *self._since(names, self.version[0]))
        if every is None:
            return None
        if keys is not None:
            every = every.join(keys, "key", "left_semi")
        newest = every.groupBy("key").agg(F.max_by("rows", "ordinal").alias("rows"), F.max("ordinal").alias("ordinal"))
        return newest.where(F.size("rows") > 0)

    def apply(self, batch_id: str, changes: DataFrame, all_rows: bool = False) -> bool:
        """Commits ``changes`` (op, doc_id, text, source, lang; optionally version); False if it was committed before.

        ``op`` is ``upsert`` (or ``insert``, ``revise``) or ``delete``. Inserting a known document
        revises it, deleting an unknown one changes nothing. Of several changes to a document in one
        batch the one with the largest ``version`` counts; of equal versions a delete, then the text with the
        largest hash. With ``all_rows`` all rows of a document together are what it counts from then on (tables that
        repeat ids, or hold rows without one); its deletes count only without other rows. A null doc_id is an id like any other; null sources
        and languages are groups of their own; further columns are left out; an empty batch commits nothing but its marker. An unknown or null op stops the batch before it is
        committed.
        """
        names = self._done("commits")
        name = f"{self.version[0]}-{batch_id.encode().hex()}"
        if any(x.split("-", 1)[1] == name for x in names):
            return False
        ordinal = len(names)
        folder = f"{ordinal:09d}-{name}"
        version = F.col("version").cast("long") if "version" in changes.columns else F.lit(0).cast("long")
        unknown = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(F.col("op").cast("string"), F.lit("null"))))
        op = F.when(F.col("op").isin("insert", "upsert", "revise", "delete"), F.col("op")).otherwise(unknown)
        rows = changes.select(
            F.coalesce(
                F.col("doc_id").cast("string"), F.lit("null")
            ).alias("key"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
            (op != "delete").alias("live"), version.alias("version"), F.xxhash64("text").alias("text_hash"), F.when(
                op != "delete", F.col("text").cast("string")
            ).alias("text"),
        )
        counted = count_tokens(rows, self.version)
        if all_rows:
            sums = counted.groupBy("key", "source", "lang").agg(
                F.count_if("live").alias("docs"), F.sum(F.when(F.col("live"), F.col("n_tokens")).otherwise(0)).alias("tokens")
            )
        else:
            order = F.struct("version", ~F.col("live"), "text_hash", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
            last = counted.groupBy("key").agg(F.max_by(F.struct("source", "lang", "n_tokens", "live"), order).alias("s")).select("key", "s.*")
            sums = last.select(
                "key", "source", "lang", F.col("live").cast("long").alias("docs"),
                F.when(F.col("live"), F.col("n_tokens")).otherwise(0).alias("tokens")
            )
        state = sums.groupBy("key").agg(F.collect_list(F.when(F.col("docs") > 0, F.struct("source", "lang", "docs", "tokens"))).alias("rows"))
        state.withColumn("ordinal", F.lit(ordinal)).write.mode("overwrite").parquet(f"{self.root}/state/{folder}")
        state = self.spark.read.parquet(f"{self.root}/state/{folder}")
        flat = lambda df, sign: df.select(F.inline("rows")).select(
            "source", "lang", (sign * F.col("docs")).alias("d_docs"), (sign * F.col("tokens")).alias("d_tokens")
        )
        signed = flat(state, 1)
        if (before := self._current(names, state.select("key"))) is not None:
            signed = signed.union(flat(before, -1))
        self._sums(signed).write.mode("overwrite").parquet(f"{self.root}/deltas/{folder}")
        self._mark("commits", folder, batch_id)
        if (ordinal + 1) % self.snapshot_every == 0:
            self.snapshot()
        return True

    def _sums(self, signed: DataFrame) -> DataFrame:
        sums = signed.groupBy("source", "lang").agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        return sums.withColumn("tokenizer", F.lit(self.version[0]))

    def _mark(self, part: str, folder: str, what: str) -> None:
        self.spark.range(1, numPartitions=1).select(F.lit(what).alias("batch_id")).write.mode("overwrite").parquet(f"{self.root}/{part}/{folder}")

    def snapshot(self) -> None:
        """Writes this tokenizer's state and sums so far in one piece; deleted documents are left behind."""
        names = self._done("commits")
        last, since = self._since(names, self.version[0])
        if since:
            folder = f"{since[-1][:9]}-{self.version[0]}"
            self._current(names).write.mode("overwrite").parquet(f"{self.root}/state-snapshots/{folder}")
            self._sums(self._read("deltas", last, since)).write.mode("overwrite").parquet(f"{self.root}/deltas-snapshots/{folder}")
            self._mark("snapshots", folder, folder)

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens``: the sums of all committed deltas; groups without documents are left out."""
        names = self._done("commits")
        parts = [self._read("deltas", *self._since(names, t)) for t in sorted({x.split("-")[1] for x in names})]
        if not parts:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        sums = reduce(DataFrame.unionByName, parts).groupBy(*_KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def count_documents(docs: DataFrame, root: str | None = None, version: tuple[str, str] | None = None) -> DataFrame:
    """The totals of all rows of ``docs``, reached as a store reaches them: by loads, revisions, deletes and retries.

    The load holds every document, those of several lines with their first line only, and a mirror of short ones
    of one line under another id. A second batch revises the former to their whole texts, a third deletes the
    mirrors; each is committed and tried again, which changes nothing. All rows of a repeated id count, and all
    rows without one. An empty table has no totals.
    """
    rollup = TokenRollup(docs.sparkSession, root or scratch(docs.sparkSession, "token-rollup"), version)
    several = F.coalesce(F.instr("text", "\n") > 0, F.lit(False))
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("doc_id"), F.col("text").cast("string").alias("text"), "source", "lang")
    own = own.withColumn("doc_id", F.when(several, F.concat("doc_id", F.lit("/lines"))).otherwise(F.col("doc_id")))  # rows of an id that are revised together
    drafts = own.withColumn("text", F.when(several, F.substring_index("text", "\n", 1)).otherwise(F.col("text")))
    mirrors = own.where(~several & (F.length(F.coalesce("text", F.lit(""))) < 400)).withColumn("doc_id", F.concat(F.lit("mirror/"), "doc_id"))
    revised = own.where(several)
    batches = {"load": ("insert", drafts.union(mirrors)), "revise": ("revise", revised), "withdraw": ("delete", mirrors)}
    for batch_id, (op, rows) in batches.items():
        for _ in range(2):
            rollup.apply(batch_id, rows.withColumn("op", F.lit(op)), all_rows=True)
    return rollup.totals()
