import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import fold, geo, score, vec
from weftline.operators import select

GOOD = dict(
    identity_mean=0.8, identity_min=0.7, identity_stability_mean=0.95, flow_flicker_mean=4.0, mask_jitter_mean=0.03, expression_delta_mean=0.014,
    seam_mean=0.8, color_discontinuity_mean=6.0, sharpness_mean=300.0, texture_retention_mean=0.9, ms_per_frame=200.0, identity_switches=0,
)
SCHEMA = ", ".join(f"{k} {'long' if k == 'identity_switches' else 'double'}" for k in GOOD)
WORSE = dict(
    identity_mean=0.5, identity_min=0.4, identity_stability_mean=0.85, flow_flicker_mean=10.0, mask_jitter_mean=0.09, expression_delta_mean=0.020,
    seam_mean=1.3, color_discontinuity_mean=18.0, sharpness_mean=100.0, texture_retention_mean=0.5, ms_per_frame=900.0, identity_switches=3,
)


def scores(spark, rows):
    return [r["score"] for r in spark.createDataFrame([tuple(r[k] for k in GOOD) for r in rows], SCHEMA).select(score.composite().alias("score")).collect()]


def test_each_worse_input_lowers_the_score(spark):
    rows = [GOOD] + [GOOD | {k: v} for k, v in WORSE.items()]
    best, *others = scores(spark, rows)
    assert all(x < best for x in others)
    assert 0 <= min(others) and best <= 1


def test_missing_metric_counts_as_worst_and_bounds_hold(spark):
    full, without, top = scores(spark, [GOOD, GOOD | {"seam_mean": None}, {k: {"identity_switches": 0}.get(k, 0.0 if k in ("flow_flicker_mean", "mask_jitter_mean", "expression_delta_mean", "seam_mean", "color_discontinuity_mean", "ms_per_frame") else 1e6) for k in GOOD}])
    assert without < full
    assert top == pytest.approx(1.0)
    assert sum(score.WEIGHTS.values()) == pytest.approx(1.0)


def test_min_falls_back_to_mean_only_where_the_column_is_absent(spark):
    rows = spark.createDataFrame([tuple((GOOD | {"identity_min": None})[k] for k in GOOD)], SCHEMA)
    with_null = rows.select(score.composite().alias("s")).first()["s"]
    absent = rows.drop("identity_min").select(score.composite(has_min=False).alias("s")).first()["s"]
    assert absent > with_null


def test_summary_drops_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    r = df.agg(*select.summary(F.col("v"), "v")).first()
    assert (r["v_mean"], r["v_min"], r["v_max"], r["v_std"], r["v_n"]) == (2.0, 1.0, 3.0, 1.0, 2)
    r = df.where("v is null").agg(*select.summary(F.col("v"), "v")).first()
    assert r["v_mean"] is None and r["v_n"] == 0


def test_gate_gives_the_first_reason(spark):
    df = spark.createDataFrame([(79.9, 0.1, 0.0, 0.0), (80.0, 0.54, 0.0, 0.0), (80.0, 0.55, 39.0, 0.0), (80.0, 0.55, 40.0, 24.0), (80.0, 0.55, 40.0, 25.0)], "face_px double, detector_conf double, sharpness double, exposure double")
    assert [r[0] for r in df.select(score.gate()).collect()] == ["face too small", "low detector confidence", "blurred", "exposure", None]


def test_bins_are_half_open_and_bounded(spark):
    df = spark.createDataFrame([(-8.0,), (7.99,), (8.0,), (200.0,), (-201.0,), (None,)], "y double")
    assert [r[0] for r in df.select(score.binned("y")).collect()] == ["frontal", "frontal", "right_15", None, None, None]


def test_human_durations_and_progress(spark):
    df = spark.createDataFrame([(89.9,), (90.0,), (5399.0,), (5400.0,)], "s double")
    assert [r[0] for r in df.select(score.human_duration(F.col("s"))).collect()] == ["89s", "1m 30s", "89m 59s", "1h 30m"]
    df = spark.createDataFrame([("preparing", 50.0), ("restoring audio", 100.0), ("other", 42.0)], "s string, p double")
    assert [round(r[0], 6) for r in df.select(score.overall_progress(F.col("s"), F.col("p"))).collect()] == [1.0, 99.9, 42.0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vec.dot("a", "b"), vec.cosine("a", "b"), vec.norm("a"), vec.unit("a"), vec.blend("a", "b", 0.25)).collect()
    assert r[0][0] == 24 and r[0][1] == pytest.approx(0.96) and r[0][2] == 5 and r[0][3] == pytest.approx([0.6, 0.8]) and r[0][4] == [3.75, 3.25]
    assert r[1][1] == 0.0 and r[1][3] == [0.0, 0.0]
    assert r[2][0] is None and r[2][1] is None


def test_boxes_and_shapes(spark):
    df = spark.createDataFrame([([0.0, 0.0, 10.0, 10.0], [5.0, 5.0, 15.0, 15.0], [20.0, 0.0, 30.0, 10.0])], "a array<double>, b array<double>, c array<double>")
    r = df.select(geo.iou("a", "b"), geo.iou("a", "c"), geo.iou("a", "a"), geo.size("a")).first()
    assert r[0] == pytest.approx(25 / 175) and r[1] == 0 and r[2] == 1 and r[3] == 10
    points = [(0.0, 0.0), (10.0, 0.0), (5.0, 8.0)]
    moved = [(2 * x + 7, 2 * y - 3) for x, y in points]
    kind = "array<struct<x: double, y: double>>"
    df = spark.createDataFrame([(points, moved, points[:2], 0.5)], f"a {kind}, b {kind}, c {kind}, s double")
    r = df.select(geo.expression_delta("a", "b"), geo.landmark_delta("a", "c", "s"), geo.landmark_delta("a", "b", "s")).first()
    assert r[0] == pytest.approx(0.0, abs=1e-12) and r[1] == 0.0
    assert r[2] == pytest.approx(sum(math.dist(p, q) for p, q in zip(points, moved)) / 3)


def series(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").groupBy().agg(fold.ordered(["i"], ["v"]).alias("rows"))


def test_ema_seeds_with_the_first_value(spark):
    out = series(spark, [10, 20, 0]).select(fold.ema("rows", "v", 0.8)).first()[0]
    assert out == pytest.approx([10, 12, 9.6])


def test_adaptive_ema_lets_go_of_large_steps(spark):
    small, large = (series(spark, [0, step]).select(fold.adaptive_ema("rows", "v")).first()[0][1] / step for step in (1, 60))
    assert small < large and large == pytest.approx(1.0, abs=1e-3)


def cuts_by_hand(values, floor=8.0, ratio=3.0, window=24, warmup=3):
    recent, out = [], []
    for v in values:
        s = sorted(recent)
        median = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2 if s else 0.0
        cut = len(recent) >= warmup and v >= floor and v >= ratio * max(median, 1.0)
        out.append(cut)
        recent = [v] if cut else (recent + [v])[-window:]
    return out


def test_scene_cuts_match_the_rule_and_restart(spark):
    rng = random.Random(5)
    values = [50, 1, 1, 60] + [rng.choice([1, 2, 3, 4, 40, 90]) + rng.random() for _ in range(150)]
    out = series(spark, values).select(fold.scene_cuts("rows", "v")).first()[0]
    assert out == cuts_by_hand([float(v) for v in values]) and any(out)
    assert out[0] is False


def test_throttle_counts_from_the_last_emitted(spark):
    out = series(spark, [0, 0.3, 0.6, 0.9, 1.2]).select(fold.throttled("rows", "v")).first()[0]
    assert out == [True, False, True, False, True]


def test_greedy_is_not_transitive(spark):
    """b clashes with a, c with b only: c stays, for b was not kept."""
    at = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    rows = [(1, 0.0, at(0)), (2, 0.0, at(20)), (3, 0.0, at(40)), (4, 30.0, at(0))]
    df = spark.createDataFrame(rows, "i int, yaw double, embedding array<double>").groupBy().agg(fold.ordered(["i"], ["yaw", "embedding"]).alias("rows"))
    assert [k["i"] for k in df.select(fold.greedy_dedup("rows")).first()[0]] == [1, 3, 4]
    assert [k["i"] for k in df.select(fold.greedy_dedup("rows", most=2)).first()[0]] == [1, 3]


def test_nms_keeps_the_best(spark):
    rows = [(1, [0.0, 0.0, 10.0, 10.0]), (2, [1.0, 0.0, 11.0, 10.0]), (3, [30.0, 0.0, 40.0, 10.0])]
    df = spark.createDataFrame(rows, "i int, box array<double>").groupBy().agg(fold.ordered(["i"], ["box"]).alias("rows"))
    assert [k["i"] for k in df.select(fold.nms("rows")).first()[0]] == [1, 3]


def test_skips_are_bounded(spark):
    rows = spark.createDataFrame([(i, i != 12) for i in range(20)], "i int, ok boolean").groupBy().agg(fold.ordered(["i"], ["ok"]).alias("rows"))
    out = rows.select(fold.bounded_skips("rows", "ok", 8)).first()[0]
    assert out == [True] * 8 + [False] + [True] * 3 + [False] + [True] * 7


def test_unknown_names_fail_the_query(spark):
    from weftline.operators import control

    registry = spark.createDataFrame([("a", 1), ("b", 2)], "name string, size int")
    assert control.looked_up(spark.createDataFrame([("a",)], "name string"), registry, "name").first()["size"] == 1
    with pytest.raises(Exception, match="not registered: z"):
        control.looked_up(spark.createDataFrame([("z",)], "name string"), registry, "name").collect()
