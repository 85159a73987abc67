import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import score
from weftline.operators import control, observe, report, select, sequence, track
from weftline.operators.track import MAX_MISSES, follow
from weftline.sources import files, sampling
from weftline.streaming import tracks


def look(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def observations(spark, rows):
    return spark.createDataFrame(rows, "k int, vec_id long, yaw double, embedding array<double>, q double")


def test_outliers_only_go_from_three_up_and_never_all(spark):
    rows = [(1, 1, 0.0, look(0), 1.0), (1, 2, 0.0, look(170), 0.1)]
    rows += [(2, 3, 0.0, look(0), 1.0), (2, 4, 0.0, look(5), 1.0), (2, 5, 0.0, look(179), 0.1)]
    out = {r["vec_id"]: r for r in observe.reject_outliers(observations(spark, rows), ["k"], F.col("q")).collect()}
    assert [out[i]["kept"] for i in range(1, 6)] == [True, True, True, True, False]
    assert out[5]["consensus"] is None and out[3]["consensus"] > 0.99
    out = observe.reject_outliers(observations(spark, rows), ["k"], F.col("q"), floor=1.5).collect()
    assert all(r["kept"] for r in out)  # nobody agrees: all stay


def test_near_pairs_fire_at_the_default_limits(spark):
    rows = [(1, 1, 0.0, look(0), 1.0), (1, 2, 12.0, look(30), 1.0), (1, 3, 12.1, look(0), 1.0), (1, 4, -11.9, look(31.5), 1.0)]
    out = {(r["a"], r["b"]) for r in observe.near_pairs(observations(spark, rows), ["k"]).collect()}
    assert out == {(1, 2), (2, 3)}  # cos 30 = .866, cos 31.5 = .853; 12.1 is too far from 0


def test_acquire_prefers_photos_then_bands(spark):
    rows = [(1, 0.0, 0.9, False, look(0)), (2, 5.0, 0.5, True, look(0)), (3, 20.0, 0.8, False, look(60)), (4, 21.0, 0.3, True, look(90)), (5, -40.0, 0.2, False, look(120)), (6, 4.0, 0.85, False, look(1))]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, vec_id long, yaw double, q double, is_photo boolean, embedding array<double>")
    out = [(r["vec_id"], r["why"]) for r in observe.acquire(df, "k", F.col("q")).orderBy("pick").collect()]
    assert out == [(2, "anchor"), (4, "right_mild"), (5, "left_strong"), (3, "fill")]  # 1 and 6 look like the anchor


def test_acquire_looks_past_any_number_of_copies(spark):
    copies = [(i, 0.0, 0.9, False, look(0)) for i in range(1, 451)] + [(i, 20.0, 0.8, False, look(60)) for i in range(451, 901)]
    rows = copies + [(901, 1.0, 0.2, False, look(120)), (902, 21.0, 0.1, True, look(150)), (903, 9.0, 0.15, False, look(90))]
    df = spark.createDataFrame([(k, *r) for k in (1, None) for r in rows], "k int, vec_id long, yaw double, q double, is_photo boolean, embedding array<double>")
    out = [(r["k"], r["vec_id"], r["why"]) for r in observe.acquire(df.where("vec_id <> 902"), "k", F.col("q")).orderBy("k", "pick").collect()]
    assert out == [(k, *x) for k in (None, 1) for x in [(1, "anchor"), (451, "right_mild"), (901, "fill"), (903, "fill")]]
    out = [(r["vec_id"], r["why"]) for r in observe.acquire(df.where("k = 1"), "k", F.col("q")).orderBy("pick").collect()]
    assert out == [(902, "anchor"), (1, "frontal"), (451, "fill"), (901, "fill"), (903, "fill")]


def test_pose_kernel_falls_back_to_quality_far_away(spark):
    df = observations(spark, [(1, 1, 0.0, [1.0, 0.0], 1.0), (1, 2, 0.0, [0.0, 1.0], 3.0)])
    out = {(r["target"], r["dim"]): r["value"] for r in observe.pose_conditioned(df, ["k"], [0.0, 500.0], quality=F.col("q")).collect()}
    assert out[0.0, 1] == pytest.approx(0.75) and out[500.0, 1] == pytest.approx(0.75)


def test_guard_and_winner(spark):
    df = spark.createDataFrame([("bare", 0.80, 0.7), ("sharp", 0.75, 0.9), ("soft", 0.77, 0.8), ("blind", None, 0.1), ("bad", 0.9, -1.0)], "candidate string, identity_mean double, score double")
    out = select.guarded(df, F.col("candidate") == "bare")
    assert {r["candidate"]: r["eligible"] for r in out.collect()} == {"bare": True, "sharp": False, "soft": True, "blind": True, "bad": True}
    assert select.winner(out).first()["candidate"] == "soft"
    assert select.winner(out.withColumn("eligible", F.lit(False))).first()["candidate"] == "sharp"


def test_stratified_sample_takes_extremes_and_fills(spark):
    df = spark.createDataFrame([(i, float(i == 7), 100.0 - (i == 9), 50.0, 50.0, 1) for i in range(40)], "frame long, yaw double, blur double, face_size double, brightness double, n_faces int")
    out = {r["frame"]: r["reason"] for r in select.stratified_sample(df).collect()}
    assert len(out) == 14 and out[7] == 0 and out[9] == 1


@pytest.mark.parametrize("span,want", [(0.0, []), (50.0, [50]), (90.0, [90]), (91.0, [91]), (119.9, [119.9]), (120.0, [90, 30]), (270.0, [90, 90, 90]), (-5.0, [])])
def test_segment_plan(spark, span, want):
    out = control.segment_plan(spark.createDataFrame([(1, 10.0, 10.0 + span)], "job int, start_s double, end_s double"), "job").orderBy("idx").collect()
    assert [round(r["seg_end"] - r["seg_start"], 6) for r in out] == want


def test_resume_needs_the_same_nonzero_size(spark):
    planned = spark.createDataFrame([(1, i) for i in range(4)], "job int, idx int")
    manifest = spark.createDataFrame([(1, 0, 10), (1, 1, 0), (1, 2, 10)], "job int, idx int, bytes int")
    found = spark.createDataFrame([(1, 0, 10), (1, 1, 0), (1, 2, 9)], "job int, idx int, bytes int")
    assert sorted(r["idx"] for r in control.resume(planned, manifest, ["job", "idx"], found).collect()) == [1, 2, 3]


def test_fingerprint_sees_the_tail_between_one_and_two_samples(spark):
    df = spark.createDataFrame([("a" * 10 + "b" * 5,), ("a" * 10 + "c" * 5,), (None,)], "t string")
    a, b, c = (r[0] for r in df.select(control.content_fingerprint(F.col("t"), 10)).collect())
    assert a != b and c is None


def test_rollup_weights_means(spark):
    df = spark.createDataFrame([(1, 10, 1, 0.2), (1, 30, 2, 0.4)], "job int, frames int, cuts int, jitter double")
    r = report.rolled_up(df, ["job"], ["cuts"], ["jitter"], "frames").first()
    assert r["cuts"] == 3 and r["jitter"] == pytest.approx(0.35)


def test_win_tally_skips_unknown_and_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0, None), ("b", 2.0, 5.0, 1.0)], "candidate string, x double, y double, z double")
    assert {tuple(r) for r in report.win_tally(df, {"x": True, "y": False, "z": True}).collect()} == {("a", 0, 1), ("b", 1, 1)}


def test_correlation_guards_constants(spark):
    df = spark.createDataFrame([(0.1 * i, float(i), 1.0) for i in range(6)], "o double, c double, k double")
    out = {r["condition"]: r["corr"] for r in report.condition_correlation(df, "o", ["c", "k"], F.col("o") < 0.3).collect()}
    assert out == {"c": 1.0, "k": 0.0}


def test_hidden_regions_do_not_count(spark):
    df = spark.createDataFrame([({"left_eye": 0.0, "right_eye": 1.0}, 30.0), ({"left_eye": 0.0, "right_eye": 1.0}, 0.0)], "v map<string, double>, yaw double")
    a, b = report.visible_fraction(df, "v", "yaw").collect()
    assert a["visible"] == 1.0 and a["occluded"] == [] and b["visible"] == 0.5 and b["occluded"] == ["left_eye"]


def test_samples(spark):
    clips = spark.createDataFrame([(1, 100, 30.0), (2, 3, 30.0), (3, 0, 30.0)], "clip int, total int, fps double")
    by = lambda df, c: sorted(r["frame"] for r in df.where(F.col("clip") == c).collect())
    even = sampling.even_indices(clips, "clip", "total", 5)
    assert by(even, 1) == [0, 25, 50, 74, 99] and by(even, 2) == [0, 1, 2] and by(even, 3) == []
    assert by(sampling.even_indices(clips, "clip", "total", 5, truncate=True), 1) == [0, 24, 49, 74, 99]
    assert by(sampling.stride_indices(clips, "clip", "total", "fps", 4.0, 3), 1) == [0, 8, 16]
    assert len(by(sampling.conditional_indices(clips, "clip", "total"), 1)) == 100


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"key": "x", "version": 2}')
    (tmp_path / "b.json").write_text("{not json")
    (tmp_path / "c.json").write_text('{"key": "y", "version": 1}')
    out = files.json_documents(spark, str(tmp_path / "*.json"), "key string, version int", ("version", 2))
    assert [r["key"] for r in out.collect()] == ["x"]
    (tmp_path / "g.csv").write_text("1.5,2\nbad,row\n2.5,3\n")
    assert files.samples(spark, str(tmp_path / "g.csv"), "a double, b int").count() == 2
    df = spark.createDataFrame([(1, ["a", "b"], [1.0, 2.0])], "i int, n array<string>, v array<double>")
    assert [tuple(r) for r in files.zipped(df, "n", "v", "name", "value").collect()] == [(1, "a", 1.0), (1, "b", 2.0)]
    for key, value in ((1, "old"), (2, "old"), (1, "new")):
        files.write_keyed(spark.createDataFrame([(key, value)], "k int, v string"), str(tmp_path / "t"), "k")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("k", "v").collect()} == {(1, "new"), (2, "old")}


A, B = np.array([1.0, 0.0, 0.0]), np.array([0.0, 1.0, 0.0])


class Clip:
    """A clip fed frame by frame: detections are (number, x, embedding or None, size)."""

    def __init__(self, diagonal=400.0):
        self.diagonal, self.tracks, self.lock, self.events = diagonal, track.none(3), track.Lock(), []

    def frame(self, *detections, cut=False):
        d = [(*x, 20.0)[:4] for x in detections]
        box = np.array([[x, 0.0, x + size, size] for _, x, _, size in d]).reshape(-1, 4)
        look = np.array([np.zeros(3) if e is None else e for _, _, e, _ in d]).reshape(-1, 3)
        f = track.Frame(np.array([n for n, *_ in d]), box, np.full(len(d), 0.9), look, np.array([e is not None for _, _, e, _ in d], bool), cut)
        self.tracks, number, turn = track.advance(self.tracks, f, self.diagonal)
        seen = [i for i in np.argsort(turn, kind="stable") if number[i]]
        looks = {n: e for n, e in zip(self.tracks.number, self.tracks.look)}
        self.lock, best, event = track.hold(self.lock, number[seen], np.array([looks[number[i]] for i in seen]).reshape(-1, 3), np.array([d[i][3] ** 2 for i in seen]))
        self.events.append(event)
        self.followed = None if best is None else d[seen[best]][0]
        return {int(number[i]): d[i][0] for i in seen}


def test_crossing_faces_keep_their_tracks():
    clip = Clip()
    for f in range(40):
        assert clip.frame((0, 4.0 * f, A), (1, 160 - 4.0 * f, B)) == {1: 0, 2: 1}


def test_identity_vetoes_a_match_by_place():
    clip = Clip()
    clip.frame((0, 50, A))
    assert clip.frame((0, 50, B)) == {2: 0} and clip.tracks.vetoed == 1
    # A pair that a better claim has already settled is no veto.
    clip = Clip()
    clip.frame((0, 50, A), (1, 70, B))
    clip.frame((0, 50, A), (1, 70, B))
    assert clip.tracks.vetoed == 0


def test_missed_tracks_slow_down_and_a_cut_stops_them():
    clip = Clip()
    for f in range(3):
        clip.frame((0, 10.0 * f, A))
    assert np.allclose(clip.tracks.speed, [[7.5, 0]])  # 0.5 * 0 + 0.5 * 10, then 0.5 * 5 + 0.5 * 10
    clip.frame()
    assert np.allclose(clip.tracks.speed, [[6.0, 0]]) and clip.tracks.missed.tolist() == [1]
    assert clip.frame((5, 26.0, None)) == {1: 5}  # 20 + 6 is where it is looked for; without an embedding place decides
    clip.frame((5, 26.0, A), cut=True)
    assert np.allclose(clip.tracks.speed, [[0, 0]])


def test_tracks_end_after_misses_and_faces_without_embedding_start_none():
    clip = Clip()
    clip.frame((0, 50, A), (1, 200, None))
    assert clip.tracks.number.tolist() == [1]
    for _ in range(MAX_MISSES):
        clip.frame()
    assert clip.tracks.lost == 0
    clip.frame()
    assert clip.tracks.lost == 1 and not len(clip.tracks.number)
    assert clip.frame((0, 50, A)) == {2: 0}


def test_lock_skips_strangers_and_reacquires():
    clip = Clip()
    clip.frame((0, 50, A, 40.0), (1, 200, B))
    assert clip.followed == 0
    for _ in range(MAX_MISSES + 6):
        clip.frame((1, 200, B, 90.0))  # the stranger grows, the person is gone
        assert clip.followed is None
    clip.frame((7, 300, A))
    assert clip.followed == 7 and clip.events.count("reacquired") == 1
    clip.frame((7, 100, A), cut=True)
    assert clip.followed == 7


def test_lock_lets_go_of_a_track_that_drifts():
    clip, angle = Clip(), 0.0
    while "switched" not in clip.events and angle < 10:
        clip.frame((0, 50, np.array([np.cos(angle), np.sin(angle), 0.0])))
        angle += 0.06
    assert "switched" in clip.events and clip.followed is None and clip.tracks.created == 1
    clip.frame((0, 50, np.array([np.cos(angle), np.sin(angle), 0.0])))
    assert clip.events[-1] == "locked"


def test_claims_equal_a_walk_over_sorted_pairs():
    r = np.random.default_rng(4)
    for _ in range(200):
        n, m = r.integers(0, 6, 2)
        value, allowed = r.integers(0, 5, (n, m)) / 4, r.random((n, m)) < 0.7
        rows, columns, want, refused = set(), set(), [], 0
        for _, i, j in sorted(((value[i, j], i, j) for i in range(n) for j in range(m)), reverse=True):
            if i not in rows and j not in columns:
                if allowed[i, j]:
                    rows.add(i), columns.add(j), want.append((i, j))
                else:
                    refused += 1
        got, free = track.claims(value, allowed)
        assert got == want and int((free & ~allowed).sum()) == refused


def test_frames_may_go_on_in_the_next_batch():
    rows = pd.DataFrame({"clip": [1] * 5 + [2] * 3, "frame": [0, 0, 1, 1, 1, 1, 1, 2], "det": range(8)})
    whole = [(c, f, g["det"].tolist()) for c, f, g in track.frames(iter([rows]), "clip")]
    for size in (1, 2, 3):
        assert [(c, f, g["det"].tolist()) for c, f, g in track.frames((rows[i : i + size] for i in range(0, 8, size)), "clip")] == whole


def test_nearest_alike(spark):
    box = lambda x: [x, 0.0, x + 10.0, 10.0]
    rows = spark.createDataFrame([(1, 0, box(0.0), 0.5), (1, 1, box(50.0), 0.4), (2, 0, box(0.0), -0.3), (3, 0, box(0.0), None), (3, 1, box(9.0), 0.1)], "f int, det int, box array<double>, s double")
    got = lambda df: {r["f"]: r["det"] for r in df.collect()}
    assert got(sequence.nearest_alike(rows, ["f"], "s", F.array(F.lit(55.0), F.lit(5.0)), 100.0)) == {1: 1, 2: None, 3: 1}
    assert got(sequence.nearest_alike(rows, ["f"], "s", None, 0.0)) == {1: 0, 2: None, 3: None}
    assert got(sequence.nearest_alike(rows.drop("s"), ["f"], "s", None, 0.0)) == {1: 0, 2: 0, 3: 0}


def test_ladder_is_strict_and_ends_with_the_second_detector(spark):
    assert select.ladder(0.5) == [(1, 0.5), (1, 0.3), (2, 0.35), (2, 0.25)] and select.ladder(0.3, second=False) == [(1, 0.3), (1, 0.25)]
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.31), (2, 1, 0.3), (2, 2, 0.36), (3, 2, 0.35), (3, 2, 0.2), (4, 1, 0.51), (4, 1, 0.5), (4, 2, 0.9), (5, 2, 0.25)], "f int, d int, s double")
    out = select.tiered(rows, "f", "s", "d", select.ladder(0.5))
    assert sorted((r["f"], r["s"], r["tier"]) for r in out.collect()) == [(1, 0.31, 2), (1, 0.5, 2), (2, 0.36, 3), (3, 0.35, 4), (4, 0.51, 1)]


def rows(n=12):
    out = []
    for f in range(n):
        out += [(1, f, 0, [4.0 * f, 0.0, 4.0 * f + 20, 20.0], 0.9, [1.0, 0.0]), (1, f, 1, [100 - 4.0 * f, 0.0, 120 - 4.0 * f, 20.0], 0.9, [0.0, 1.0])]
    return out


SCHEMA = "clip int, frame long, det int, box array<double>, score double, embedding array<double>"


def test_follow_gives_a_row_a_frame(spark):
    out = follow(spark.createDataFrame(rows(), SCHEMA), "clip", 400.0).collect()
    assert len(out) == 12 and len({r["det"] for r in out}) == 1


def test_streamed_tracks_equal_batch_tracks(spark, tmp_path):
    for i, part in enumerate((rows()[:10], rows()[10:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracks.assign(stream, "clip", 400.0).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    out = spark.table("tracked").collect()
    assert len(out) == 24 and {(r["det"], r["track"]) for r in out} == {(0, 1), (1, 2)}


def test_liveness_and_evictions(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:02:00"), ("b", "2024-01-01 00:00:00")], "w string, t string").withColumn("t", F.to_timestamp("t"))
    out = {r["w"]: r["alive"] for r in control.liveness(df, ["w"], "t", F.to_timestamp(F.lit("2024-01-01 00:04:00"))).collect()}
    assert out == {"a": True, "b": False}
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate("aab")], "r int, i int, m string")
    assert [r["evict"] for r in control.evictions(df, ["i"], "m", ["r"]).orderBy("i").collect()] == [False, True, True]


def test_holdout_columns_never_reach_the_score():
    used = {m for _, m, *_ in score.TERMS} | set(select.MEANS.values())
    assert not any("holdout" in m or "sface" in m for m in used)


def test_a_group_of_jobs_is_seen_while_it_runs_and_can_be_cancelled(spark):
    import threading
    import time

    ended = []

    def work():
        try:
            control.in_group(spark, "render-1", lambda: spark.range(4).repartition(4).foreach(lambda _: time.sleep(60)))
        except Exception as e:  # noqa: BLE001  the JVM reports a cancelled job as a failed one
            ended.append(e)

    from pyspark import InheritableThread

    t = InheritableThread(target=work)
    t.start()
    for _ in range(200):
        if control.is_active(spark, "render-1"):
            break
        time.sleep(0.1)
    assert control.is_active(spark, "render-1")
    control.cancel_group(spark, "render-1")
    t.join(40)
    assert ended and not t.is_alive() and isinstance(t, threading.Thread)


def test_strategies_are_functions_of_a_column(spark):
    """A strategy maps a pose to a vector; evaluation takes any."""
    rows = spark.createDataFrame([(1, -30.0), (1, 0.0), (1, 30.0)], "k int, yaw double")
    strategies = {"fixed": lambda yaw: F.array(F.lit(1.0), F.lit(0.0)), "turned": lambda yaw: F.array(F.cos(F.radians(yaw)), F.sin(F.radians(yaw)))}
    truth = F.array(F.cos(F.radians("yaw")), F.sin(F.radians("yaw")))
    out = rows.agg(*(F.avg(F.aggregate(F.zip_with(s(F.col("yaw")), truth, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)).alias(n) for n, s in strategies.items())).first()
    assert out["turned"] == pytest.approx(1.0) and out["fixed"] < 1.0
