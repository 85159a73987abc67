"""Walks against plain passes: batches, keys and cuts in between, nulls, ties and long series."""

import random
import statistics

import numpy as np
import pytest

from weftline.operators import track, walk

ROWS = "clip string, frame long, look array<double>, size double, cut boolean"


def rows(n=400, seed=1, clips=("a", "b", None)):
    r = random.Random(seed)
    return [(r.choice(clips), i, None if r.random() < 0.05 else [r.gauss(0, 30) for _ in range(6)], r.choice([None, 0.0, 50.0, 200.0]), r.choice([True, None] + [False] * 18)) for i in range(n)]


def series(found):
    out = {}
    for x in sorted(found, key=lambda x: x[1]):
        out.setdefault(x[0], []).append(x)
    return out


def test_vectors_are_smoothed_and_made_of_unit_length(spark):
    data = rows()
    want = {}
    for xs in series(data).values():
        state = None
        for _, frame, look, _, cut in xs:
            state = None if cut else state
            if look is None:
                want[frame] = None
                continue
            state = np.array(look) if state is None else 0.75 * state + 0.25 * np.array(look)
            want[frame] = state / np.linalg.norm(state)
    found = walk.smoothed(spark.createDataFrame(data, ROWS).repartition(3), ["clip"], ["frame"], "look", 0.75, cut="cut").collect()
    assert len(found) == len(data) and set(found[0].asDict()) == {"clip", "frame", "look", "smoothed"}
    for x in found:
        assert (x["smoothed"] is None) == (want[x["frame"]] is None)
        assert x["smoothed"] is None or np.allclose(x["smoothed"], want[x["frame"]])
    zero = spark.createDataFrame([("a", 1, [0.0, 0.0], 1.0, False)], ROWS)
    assert walk.smoothed(zero, ["clip"], ["frame"], "look").first()["smoothed"] == [0.0, 0.0]
    assert walk.smoothed(zero.limit(0), ["clip"], ["frame"], "look").count() == 0


def test_matrices_move_less_the_nearer_they_are(spark):
    data = rows(seed=2)
    want = {}
    for xs in series(data).values():
        state = None
        for _, frame, m, size, cut in xs:
            state = None if cut else state
            if m is None:
                continue
            m = np.array(m).reshape(2, 3)
            if state is not None:
                away = np.linalg.norm(m[:, 2] - state[:, 2]) / max(size or 0, 1.0) * 100
                w = 0.6 * np.exp(-away / 6.0)
                m = w * state + (1 - w) * m
            want[frame] = state = m
    for x in walk.smoothed_matrix(spark.createDataFrame(data, ROWS).repartition(3), ["clip"], ["frame"], "look", "size", cut="cut").collect():
        assert (x["smoothed"] is None) == (x["frame"] not in want) and (x["smoothed"] is None or np.allclose(x["smoothed"], want[x["frame"]].ravel()))
    big = walk.smoothed_matrix(spark.createDataFrame([("a", 1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], 1000.0, False), ("a", 2, [1.0, 0.0, 1.0, 0.0, 1.0, 0.0], 1000.0, False)], ROWS), ["clip"], ["frame"], "look", "size")
    small = big.sparkSession.createDataFrame([("a", 1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], 10.0, False), ("a", 2, [1.0, 0.0, 1.0, 0.0, 1.0, 0.0], 10.0, False)], ROWS)
    step = lambda f: f.orderBy("frame").collect()[1]["smoothed"][2]
    assert step(big) < step(walk.smoothed_matrix(small, ["clip"], ["frame"], "look", "size"))  # the same step weighs more on a small face


def test_median_of_the_last_values():
    r, recent, plain = random.Random(3), walk.Recent(5), []
    for _ in range(300):
        x = float(r.randint(0, 9))
        if r.random() < 0.1:
            recent.restart(x)
            plain = [x]
        else:
            recent.add(x)
            plain = [*plain, x][-5:]
        assert recent.median() == statistics.median(plain) and len(recent) == len(plain)


def test_scene_cuts_by_histogram_and_by_spike(spark):
    flat, other = [5.0, 5.0, 5.0], [0.0, 9.0, 1.0]
    steps = [([1.0, 2.0, 9.0], 0), ([1.0, 2.1, 9.0], 1), ([1.0, 2.0, 9.1], 2), ([9.0, 2.0, 1.0], 3), ([9.0, 2.0, 1.0], 4), ([9.0, 2.1, 1.0], 5), ([9.0, 2.0, 1.0], 6), ([9.0, 2.0, 1.0], 50), ([9.0, 2.0, 1.0], 51), (flat, 52), (flat, 53), (other, 54)]
    data = [("x", i, h, [float(s)] * 4) for i, (h, s) in enumerate(steps)] + [("y", 1, None, [1.0]), ("y", 2, flat, [1.0])]
    frame = spark.createDataFrame(data, "clip string, frame long, h array<double>, f array<double>")
    found = {(r["clip"], r["frame"]): r["is_cut"] for r in walk.scene_cuts(frame, ["clip"], ["frame"], "h", "f").collect()}
    assert [k for k, v in found.items() if v] == [("x", 3), ("x", 7)] and ("y", 1) not in found and len(found) == 13
    assert walk.correlation(np.array([1.0, 2, 4]), np.array([2.0, 4, 8])) == pytest.approx(1) and walk.correlation(np.array(flat), np.array(other)) == 1.0


def test_identity_checks_are_skipped_at_most_eight_times_in_a_row(spark):
    person, stranger = [1.0, 0.0], [0.0, 1.0]
    box = lambda x, w=60.0: [x, 0.0, x + w, 60.0]
    data = [("a", i, 0, box(100.0 + i), person, False) for i in range(12)]
    data += [("a", 12, 0, box(400.0), person, False), ("a", 13, 0, box(401.0), person, False), ("a", 14, 0, box(402.0), person, False)]
    data += [("a", 15, 0, box(403.0), person, False), ("a", 15, 1, box(10.0, 20.0), stranger, False), ("a", 16, 0, box(404.0), person, False), ("a", 17, 0, box(405.0), person, True), ("a", 18, 0, box(406.0), stranger, False)]
    frame = spark.createDataFrame(data, "clip string, frame long, det int, box array<double>, embedding array<double>, cut boolean").selectExpr("*", "0.9 as score")
    found = sorted(track.follow_fast(frame, "clip", 1000.0).collect(), key=lambda r: r["frame"])
    checks = [r["check"] for r in found]
    assert checks[:12] == ["unlocked"] + ["skipped"] * 8 + ["forced"] + ["skipped"] * 2
    assert checks[12:] == ["refused", "refused", "refused", "faces", "refused", "forced", "skipped"]  # the jump leaves a speed that fades by halves
    assert {r["det"] for r in found} == {0} and found[-1]["event"] == "followed"  # a stranger in a skipped frame isn't looked at
    short = track.follow_fast(frame, "clip", 1000.0, skips=1).collect()
    assert sum(r["check"] == "skipped" for r in short) < checks.count("skipped")
    assert track.follow_fast(frame.limit(0), "clip", 1000.0).count() == 0


def test_throttling_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = [("k", i, i * 0.2, i == 33) for i in range(100)]
        found = walk.throttled(spark.createDataFrame(data, "key string, n long, t double, last boolean"), ["key"], ["n"], "t", 0.5, "last").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last, want = None, []
    for _, n, t, must in data:
        if last is None or t - last >= 0.5 or must:
            last = t
            want.append(n)
    assert sorted(r["n"] for r in found if r["emitted"]) == want
