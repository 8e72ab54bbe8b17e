"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """Driver and executors have no folder in common to write to."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session has none, a temporary one is set if driver and executors are one process; anywhere else each
    machine would write to its own disk and the reader would miss rows, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all machines share; the master is {context.master}")
            named = tempfile.mkdtemp(prefix="spacelab-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application's JVM ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read back: cuts the lineage, what made it runs once, and lost executors cost little.

    The files go when the application's JVM ends.  ``codec``: compression, if not the session's.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    writer = df.write if codec is None else df.write.option("compression", codec)
    writer.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
