"""Cutting the lineage of iterative plans in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder stands in only where that setting is absent on a single machine (tests); on a cluster
    its absence is an error, as other machines don't see such a folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return (configured or spark.sparkContext.getCheckpointDir()).rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read in place from then on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate data, wherever Spark reaches it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one for intermediate data; removed when the driver's Python ends, if not before."""
    folder = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"

    def forget() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already; the folder then stays
            remove(spark, folder)

    atexit.register(forget)
    return folder


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in a new folder of intermediate data, of which later steps read only their columns."""
    folder = scratch(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
