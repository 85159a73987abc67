"""Lineage cut through the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(rows: DataFrame) -> DataFrame:
    """The rows, computed once and read back from `spark.checkpoint.dir`; a folder of our own only where that is unset and all tasks run in this machine."""
    spark = rows.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="weftline-")
        context.setCheckpointDir(folder)
    return rows.checkpoint(eager=True)
