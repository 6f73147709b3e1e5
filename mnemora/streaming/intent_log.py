"""A change log of intents, applied exactly once.

Writers append intents as files; the applier is a streaming query whose checkpoint is the durable
cursor. Each micro-batch is fenced by epoch, freed of intents that the ledger knows, applied, and entered
in the ledger under its batch number, so a batch that runs again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import vocab

INTENTS = "offset string, intent_id string, kind string, agent_name string, epoch long, payload string"
LEDGER = "intent_id string, offset string, epoch long, batch long"


def offset(segment: int, position: int) -> str:
    """Offsets order as strings."""
    return f"{segment:020d}:{position:020d}"


def validated(intents: DataFrame) -> DataFrame:
    """Intents with a known kind; any other stops the job, as a broken record inside the log must."""
    kind = F.when(F.col("kind").isin(*vocab.INTENT_KINDS), F.col("kind")).otherwise(
        F.raise_error(F.concat(F.lit("unknown kind of intent: "), F.coalesce("kind", F.lit("null"))))
    )
    return intents.withColumn("kind", kind)


def fenced(intents: DataFrame, epoch_so_far: int = 0) -> DataFrame:
    """Intents that no newer writer had fenced off: in order of offset, epochs never fall.

    The largest epoch so far is a running maximum over offsets; it is taken per segment first, so that no
    task sees more than one segment.
    """
    parts = intents.withColumn("segment", F.split_part("offset", F.lit(":"), F.lit(1)))
    tops = parts.groupBy("segment").agg(F.max("epoch").alias("top"))
    earlier = tops.withColumn(
        "before", F.coalesce(F.max("top").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(epoch_so_far))
    )
    own = Window.partitionBy("segment").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    joined = parts.join(earlier.select("segment", "before"), "segment").withColumn("top", F.max("epoch").over(own))
    return joined.where((F.col("epoch") >= F.col("top")) & (F.col("epoch") >= F.col("before"))).drop("segment", "before", "top")


def unapplied(intents: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each intent once (its first offset), without those in the ledger."""
    first = intents.groupBy("intent_id").agg(
        F.min_by(F.struct(*[c for c in intents.columns if c != "intent_id"]), "offset").alias("i")
    ).select("intent_id", "i.*")
    return first.join(ledger.select("intent_id").distinct(), "intent_id", "left_anti").select(*intents.columns)


def prune(ledger: DataFrame, watermark: str) -> DataFrame:
    """The ledger without entries below an offset: those can't come again."""
    return ledger.where(F.col("offset") >= watermark)


class IntentLog:
    """An append-only folder of intents and the ledger of what was applied."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, intents: DataFrame) -> None:
        """Durable once it returns: files appear whole or not at all."""
        validated(intents).write.mode("append").parquet(f"{self.root}/intents")

    def read_next(self, after: str | None = None, limit: int = 100) -> DataFrame:
        """The first intents beyond an offset, in order, for readers that keep a cursor of their own."""
        rows = self.spark.read.schema(INTENTS).parquet(f"{self.root}/intents")
        return (rows if after is None else rows.where(F.col("offset") > after)).orderBy("offset").limit(limit)

    def ledger(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/ledger")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger/*") if there else self.spark.createDataFrame([], LEDGER)

    def compact(self, watermark: str | None = None) -> None:
        """Writes the ledger as one folder, without entries below ``watermark``: intents before it can't come again.

        Not while a drain runs. The new folder stands before the old ones go; an entry that is there twice
        in between is harmless.
        """
        rows = self.ledger() if watermark is None else prune(self.ledger(), watermark)
        base = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/ledger")
        store = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [x.getPath() for x in store.listStatus(base)] if store.exists(base) else []
        rows.write.parquet(f"{self.root}/ledger/c{uuid.uuid4().hex}")
        for path in old:
            store.delete(path, True)

    def drain(self, apply: Callable[[DataFrame, int], None], watermark: str | None = None) -> StreamingQuery:
        """Applies all that has arrived; ``apply`` gets the new intents of a batch, in no order, and its number.

        Afterwards the ledger is compacted, and pruned below ``watermark`` if one is given.
        """

        def step(batch: DataFrame, number: int) -> None:
            done = self.ledger().where(F.col("batch") != number)
            top = done.agg(F.coalesce(F.max("epoch"), F.lit(0))).first()[0]
            fresh = unapplied(fenced(batch, top), done).persist()
            try:
                apply(fresh, number)
                fresh.select(
                    "intent_id", "offset", "epoch", F.lit(number).cast("long").alias("batch")
                ).write.mode("overwrite").parquet(f"{self.root}/ledger/b{number:09d}")
            finally:
                fresh.unpersist()

        source = self.spark.readStream.schema(INTENTS).parquet(f"{self.root}/intents")
        query = source.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.root}/cursor").trigger(availableNow=True).start()
        query.awaitTermination()
        self.compact(watermark)
        return query
