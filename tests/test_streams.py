"""Streams against their batch operators: several micro-batches, restarts from the checkpoint, time to live and timers."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import track, walk
from weftline.streaming import tracks

SEEN = "clip string, frame long, det int, box array<double>, score double, embedding array<double>"


def detections(n=26, seed=3):
    """Two clips of two persons; one leaves for a while, one frame has a stranger, one detection has no embedding."""
    r, rows = random.Random(seed), []
    looks = ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0])
    for clip in ("a", "b"):
        for frame in range(n):
            for det in (0, 1):
                if det == 0 and 8 <= frame < 14:
                    continue
                x = (frame * 2.0 if det == 0 else 200.0 - frame) + r.uniform(-1, 1)
                look = None if (frame, det) == (5, 1) else looks[2 if (frame, det) == (10, 1) else det]
                rows.append((clip, frame, det, [x, 10.0, x + 40 - 10 * det, 60.0], 0.9, look))
    return rows


def fed(spark, folder, parts, schema):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def drained(stream, folder, mode="append"):
    """All rows that a stream gives until its input is used up, through files, as after a restart."""
    def sink(batch, number):
        batch.write.mode("append").parquet(str(folder / "out"))

    q = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return stream.sparkSession.read.parquet(str(folder / "out"))


def sorted_rows(frame, columns):
    return sorted(map(repr, map(tuple, frame.select(*columns).collect())))


@pytest.mark.parametrize("operator", ["assign", "follow"])
def test_stream_equals_batch_over_micro_batches_and_a_restart(spark, tmp_path, operator):
    rows = detections()
    parts = [[x for x in rows if lo <= x[1] < hi][::-1] for lo, hi in ((0, 4), (4, 11), (11, 20), (20, 26))]
    batch = getattr(track, operator)(spark.createDataFrame(rows, SEEN), "clip", 400.0)
    stream = fed(spark, tmp_path, parts[:2], SEEN)
    first = drained(getattr(tracks, operator)(stream, "clip", 400.0), tmp_path).count()
    stream = fed(spark, tmp_path, parts[2:], SEEN)  # a new query goes on from the checkpoint
    found = drained(getattr(tracks, operator)(stream, "clip", 400.0), tmp_path)
    assert first < found.count() and sorted_rows(found, batch.columns) == sorted_rows(batch, batch.columns)
    if operator == "follow":
        assert {"locked", "followed", "skipped"} <= {r["event"] for r in found.collect()}


def test_frames_in_order_are_taken_as_they_come(spark, tmp_path):
    rows = [x for x in detections(12) if x[0] == "a"]
    stream = fed(spark, tmp_path, [rows[:9], rows[9:]], SEEN)
    found = drained(tracks.assign(stream, "clip", 400.0, in_order=True), tmp_path)
    batch = track.assign(spark.createDataFrame(rows, SEEN), "clip", 400.0)
    # The ninth row parts a frame: what comes later of it is a frame of its own, matched once more.
    assert found.count() == batch.count() and {r["track"] for r in found.collect()} >= {r["track"] for r in batch.where("frame < 4").collect()}


def test_a_clip_that_rests_longer_than_its_time_to_live_starts_anew(spark, tmp_path):
    import time

    rows = [("a", i, 0, [i * 2.0, 10.0, i * 2.0 + 40, 60.0], 0.9, [1.0, 0.0]) for i in range(4)]
    stream = fed(spark, tmp_path, [rows[:2]], SEEN)
    q = tracks.follow(stream, "clip", 400.0, ttl_ms=2_000).writeStream.format("memory").queryName("rested").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(20):
            if spark.table("rested").count() == 2:
                break
            time.sleep(1)
        time.sleep(4)
        spark.createDataFrame(rows[2:], SEEN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(20):
            if spark.table("rested").count() == 4:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert sorted((r["frame"], r["event"]) for r in spark.table("rested").collect()) == [(0, "locked"), (1, "followed"), (2, "locked"), (3, "followed")]


def test_throttled_stream_equals_batch(spark, tmp_path):
    schema = "job string, t double, final boolean"
    r = random.Random(1)
    rows = [(job, round(i * 0.1 + r.random() / 20, 3), i == 37) for job in ("x", "y") for i in range(60)]
    parts = [[x for x in rows if lo <= x[1] < hi] for lo, hi in ((0, 1.7), (1.7, 3.1), (3.1, 99))]
    found = drained(tracks.throttled(fed(spark, tmp_path, parts, schema), "job", "t", 0.5, "final"), tmp_path)
    batch = walk.throttled(spark.createDataFrame(rows, schema), ["job"], ["t"], "t", 0.5, "final").where("emitted")
    assert sorted_rows(found, ["job", "t"]) == sorted_rows(batch, ["job", "t"]) and 0 < found.count() < len(rows)


def test_a_silent_key_is_reported_without_a_beat_of_its_own(spark, tmp_path):
    schema = "worker string, at timestamp"
    beats = lambda rows: [(w, t) for w, t in rows]
    at = lambda m, s=0: __import__("datetime").datetime(2024, 1, 1, 0, m, s)
    parts = [
        beats([("a", at(0)), ("b", at(0)), ("b", at(0, 30))]),
        beats([("a", at(2)), ("a", at(1))]),
        beats([("a", at(3, 45))]),  # b's 180 s ended at 3:30; the watermark passes that now
        beats([("a", at(5))]),
        beats([("b", at(6)), ("a", at(6))]),
    ]
    found = drained(tracks.liveness(fed(spark, tmp_path, parts, schema), "worker", "at", 180.0, "5 seconds"), tmp_path, "update")
    rows = sorted((r["worker"], r["last"], r["state"]) for r in found.collect())
    assert rows == [("a", at(0), "alive"), ("b", at(0, 30), "alive"), ("b", at(0, 30), "stale"), ("b", at(6), "alive")]
    assert found.where(F.col("state") == "stale").count() == 1
