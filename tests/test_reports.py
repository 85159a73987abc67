"""Order statistics by counting, and the number of scans that plans take."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import report
from weftline.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_percentiles_are_exact_in_skewed_keys(spark, monkeypatch):
    monkeypatch.setattr(report, "BUCKETS", 64)  # so that many passes are needed
    r = random.Random(4)
    values = {
        "hot": [r.choice([1.5, 1.5, 1.5, r.random()]) for _ in range(3_000)], "same": [7.25] * 500, "one": [3.0], "two": [-1.0, 4.0], "wide": [r.uniform(-1, 1) * 10.0 ** r.randint(-300, 300) for _ in range(400)],
        "ends": [-1.7e308, 1.7e308, 0.0], "near": [1.0 + i * 2.0**-52 for i in range(40)], None: [5.0, 1.0, 2.0],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("hot", None), ("none", None), ("nan", float("nan")), ("two", float("nan"))]
    r.shuffle(rows)
    at = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    found = {x["k"]: x for x in report.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", at).collect()}
    assert set(found) == set(values) | {"none", "nan"}
    for k, vs in values.items():
        ordered = sorted(vs)
        for q in at:
            place = q * (len(vs) - 1)
            low, high = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
            assert found[k][f"p{round(100 * q)}"] == low + (high - low) * (place - np.floor(place)), (k, q)
    assert found["none"]["p50"] is None and found["nan"]["p50"] is None
    assert report.percentiles(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


def test_bystanders_are_no_failures(spark):
    rows = [("a", 0.14), ("a", 0.15), ("a", 0.9), ("a", None), ("b", 0.01)]
    found = {x["k"]: x for x in report.identity_profile(spark.createDataFrame(rows, "k string, s double"), ["k"], "s").collect()}
    assert (found["a"]["counted"], found["a"]["left_out"], found["a"]["p50"]) == (2, 1, pytest.approx(0.525)) and (found["b"]["counted"], found["b"]["p50"]) == (0, None)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
@pytest.mark.parametrize("name, most", [("outlier_rejection", 1), ("agreement_filter", 1), ("stratified_sample", 1), ("win_tally", 0), ("acquire_references", 0)])
def test_plans_read_their_table_once_at_most(spark, name, most):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= most


def test_the_percentile_of_jumps_is_counted_in_ranges(spark):
    r, schema = random.Random(8), "jump double, edge boolean"
    many = [(r.choice([r.uniform(0, 1e5), float(r.randrange(50))]), r.random() < 0.3) for _ in range(3_000)] + [(None, True), (None, False), (1.0, None)]
    for rows in (many, many + [(float("nan"), False)] * 3, many + [(float("nan"), False)] * 100, [(float("nan"), False)] * 2, [(2.5, False)], [(2.5, True)], [(None, False)], []):
        frame = spark.createDataFrame(rows, schema)
        found = report.boundary_jump(frame, "jump", F.col("edge"))
        assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()  # one task's table of all distinct jumps
        b, e = F.when(F.col("edge"), F.col("jump")), F.when(~F.col("edge"), F.col("jump"))
        want = frame.agg(F.avg(b), F.max(b), F.avg(e), F.max(e), F.percentile(e, F.lit(0.99)).alias("p")).withColumn("seamless", F.col("max(CASE WHEN edge THEN jump END)") <= F.col("p"))
        for x, y in zip(found.first(), want.first(), strict=True):
            assert (x is None and y is None) or x == pytest.approx(y, rel=1e-12, nan_ok=True)
