"""The segment runner: what a broken run leaves is finished by the next one, and nothing is rendered twice."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import segments


def test_a_broken_run_is_finished_by_the_next_one(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 2).alias("job"), (F.col("id") % 20 / 4).cast("int").alias("idx"), F.col("id").alias("frame"))
    seen, path = [], str(tmp_path / "render")

    def render(some, broken=False):
        seen.append(sorted(map(tuple, some.select("job", "idx").distinct().collect())))
        return some.withColumn("out", F.when(F.lit(broken) & (F.col("frame") == 99), F.raise_error(F.lit("no memory"))).otherwise(F.col("frame") * 2))

    with pytest.raises(Exception, match="no memory"):
        segments.run(rows, ["job", "idx"], "v1", path, lambda some: render(some, True), at_once=3)
    assert len(seen) == 4 and sum(map(len, seen)) == 10  # the last batch of one segment broke
    found = segments.run(rows, ["job", "idx"], "v1", path, render, at_once=3)
    assert seen[4:] == [seen[3]] and sorted(map(tuple, found.select("job", "idx").collect())) == sorted(x for part in seen[:4] for x in part)
    out = spark.read.parquet(f"{path}/segments")
    assert out.count() == 100 and out.where("out = frame * 2").count() == 100 and found.agg(F.sum("rows")).first()[0] == 100
    segments.run(rows, ["job", "idx"], "v1", path, render, at_once=3)
    assert len(seen) == 5  # nothing is left to do
    segments.run(rows.where("job = 1"), ["job", "idx"], "v2", path, render, at_once=100)
    assert len(seen) == 6 and {j for j, _ in seen[5]} == {1} and spark.read.parquet(f"{path}/segments").count() == 100


def test_no_segments(spark, tmp_path):
    rows = spark.createDataFrame([], "job long, idx int, frame long")
    assert segments.run(rows, ["job", "idx"], "v1", str(tmp_path), lambda some: some).count() == 0
