"""The folder that driver and executors share, and lineage cut through it."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a folder of our own only where that is unset and all tasks run in this machine, as in tests."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    return context.getCheckpointDir().get()


def cut(rows: DataFrame) -> DataFrame:
    """The rows, computed once and read back from the shared folder."""
    spark = rows.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return rows.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are written: the context cleans up what the JVM has collected."""
    for _ in range(2):  # what Python lets go of reaches the JVM, and its queue of files to delete, after a moment
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, by Spark's own access to it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Stored:
    """Rows written to the shared folder as compressed Parquet, one part after the other, for what is large or read twice."""

    def __init__(self, *parts: DataFrame):
        self.spark = parts[0].sparkSession
        self.path = f"{shared_folder(self.spark)}/stored-{uuid.uuid4().hex}"
        for rows in parts:
            rows.write.mode("append").option("compression", "zstd").parquet(self.path)
        self.rows = self.spark.read.parquet(self.path)

    def discard(self) -> None:
        """Delete the files; nothing may read the rows any more."""
        delete(self.spark, self.path)
