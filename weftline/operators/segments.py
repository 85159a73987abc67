"""A runner that renders segments, records those that are written, and goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def recorded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The manifest under a path: the key, fingerprint and rows of each segment that is whole; empty before the first one."""
    manifest = f"{path}/manifest"
    return spark.read.schema(schema).parquet(manifest) if _there(spark, manifest) else spark.createDataFrame([], schema)


def run(rows: DataFrame, key: list[str], fingerprint: str, path: str, render: Callable[[DataFrame], DataFrame], at_once: int = 64) -> DataFrame:
    """Render the segments of `rows` that the manifest lacks at this fingerprint, and return what is recorded of all of them.

    Segments go in batches of `at_once`: a batch's partitions are overwritten under `path`/segments, then
    counted from what was written, then recorded. A run that ends in between has written nothing that the next one
    trusts: segments without a record are written anew, those of another fingerprint too. render keeps the key's columns.
    """
    spark = rows.sparkSession
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "fingerprint string", "rows long"])
    batch = F.floor((F.row_number().over(_order(key)) - 1) / at_once)
    planned = rows.select(*key).distinct()
    while True:
        done = recorded(spark, path, schema).where(F.col("fingerprint") == fingerprint)
        left = planned.join(done, key, "left_anti").withColumn("_batch", batch).where("_batch = 0").select(*key)  # a row a segment, not a frame
        if left.isEmpty():
            return done.join(planned, key, "left_semi")
        some = spark.createDataFrame(left.collect(), left.schema)  # at most `at_once` keys
        render(rows.join(F.broadcast(some), key, "left_semi")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(f"{path}/segments")
        written = spark.read.parquet(f"{path}/segments")
        same = [F.col(k).cast(kinds[k]).alias(k) for k in key]
        counts = written.select(*same).join(F.broadcast(some), key, "left_semi").groupBy(*key).agg(F.count("*").alias("rows"))
        whole = some.join(counts, key, "left").select(*key, F.lit(fingerprint).alias("fingerprint"), F.coalesce("rows", F.lit(0)).alias("rows"))
        whole.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _order(key: list[str]):
    from pyspark.sql import Window

    return Window.orderBy(*key)
