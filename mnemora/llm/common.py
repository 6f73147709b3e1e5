"""What several operators share: the checkpoint folder, lineage cuts and word rules."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every operator: maximal runs of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent on a single machine (tests) a temporary folder takes its place; on a
    cluster its absence is an error, as other machines don't see such a folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate data, wherever Spark reaches it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one for data that results are read from; removed when the driver's Python ends."""
    folder = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def forget() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already; the folder then stays
            remove(spark, folder)

    atexit.register(forget)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage.

    The copy outlives lost executors, and what follows reads it in place of redoing the work.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def word_count(text: Column) -> Column:
    """Number of words; null counts as none.

    Word ends are made line ends and counted by length, which stays on byte strings and allocates no
    array of words.
    """
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\u000b\u000c\r", "     ")
    starts = F.regexp_replace(F.concat(F.lit(" "), spaced), " +(?=[^ ])", "\n")
    return (F.length(starts) - F.length(F.translate(starts, "\n", ""))).cast("long")
