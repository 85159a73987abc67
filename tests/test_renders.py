"""Render records, joined segments, candidates that a stage makes, and photos of a request."""

import hashlib

from pyspark.sql import functions as F

from weftline.functions import score
from weftline.operators import control, ordinal, report, select
from weftline.sources import files


def test_library_columns_of_records_that_change(spark):
    rows = [
        (1, '{"quality":"q","engine":"v0","result":{"engine":"v2","config":{"swapper":"a","enhancer_blend":0.7,"mask":"full","color_match":true},"frames":12,"tracking":{"identity_switches":3},"timings":{"total_s":4.5},"mask_sources":["m",1]}}'),
        (2, '{"result":'), (3, None), (4, "[]"), (5, '{"result":{"engine":null,"frames":"many","config":"none","tracking":[1]},"engine":"v9"}'), (6, '{"result":{"frames":1e3,"benchmark_score":2,"config":{"color_match":"yes","unknown":{"x":1}}}}'), (7, ""),
    ]
    frame = spark.createDataFrame(rows, "job int, record string").withColumn("_record", F.lit("own"))
    found = {r["job"]: r.asDict() for r in control.library_columns(frame, "record").collect()}
    assert set(found[1]) == {"job", "record", "_record", "engine", "mask_sources"} | {c for c, _, _ in control.LIBRARY}
    one = found[1]
    assert (one["engine"], one["swapper"], one["enhancer_blend"], one["color_match"], one["frames"], one["identity_switches"], one["render_seconds"], one["mask_sources"]) == ("v2", "a", 0.7, True, 12, 3, 4.5, '["m",1]')
    for job in (2, 3, 4, 7):
        assert found[job]["engine"] == "v1" and all(found[job][c] is None for c, _, _ in control.LIBRARY)
    assert found[5]["engine"] == "v9" and found[5]["frames"] is None and found[5]["swapper"] is None and found[6]["frames"] == 1000 and found[6]["benchmark_score"] == 2.0


def test_segments_are_joined_with_their_faults(spark):
    keys = [(0, f, f) for f in range(5)] + [(1, f, 5 + f) for f in range(5)] + [(2, f, 8 + f) for f in range(4)] + [(3, 0, 20), (3, 0, 20), (3, 1, 21)]
    frame = spark.createDataFrame(keys[::-1], "seg long, frame long, n long").repartition(5)
    found = sorted((r["ordinal"], r["seg"], r["frame"], r["fault"]) for r in ordinal.joined(frame, "seg", "frame", F.col("n")).collect())
    assert [x[:3] for x in found] == [(i, s, f) for i, (s, f, _) in enumerate(keys)]
    assert {(s, f, fault) for _, s, f, fault in found if fault} == {(2, 0, "overlap"), (3, 0, "gap"), (3, 0, "repeat")}
    assert ordinal.joined(frame.limit(0), "seg", "frame", F.col("n")).count() == 0


def test_places_need_no_single_partition(spark):
    rows = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("v")).repartition(9)
    numbered = ordinal.numbered(rows, ["v"])
    assert numbered.where("v <> ordinal").count() == 0 and numbered.count() == 5_000
    assert "SinglePartition" not in rows.repartitionByRange("v").sortWithinPartitions("v")._jdf.queryExecution().executedPlan().toString()


def test_a_stage_makes_its_candidates_and_leaves_out_those_measured(spark):
    schema = "job string, label string, mask string, color_match boolean, swapper string, score double"
    winners = spark.createDataFrame([("a", "w", "full", True, "s1", 0.5), ("b", "x", "model", False, "s2", 0.9), ("c", "y", None, None, "s3", 0.1)], schema)
    done = spark.createDataFrame([("a", "w / mask:model"), ("b", "w / mask:parsing")], "job string, label string")
    made = {(r["job"], r["label"]): r for r in select.variants(winners, done, ["job"]).collect()}
    assert set(made) == {("a", "w / mask:parsing"), ("a", "w / no colour match"), ("b", "x / mask:parsing"), ("b", "x / mask:full"), ("c", "y / mask:model"), ("c", "y / mask:parsing"), ("c", "y / mask:full"), ("c", "y / no colour match")}
    assert made["a", "w / no colour match"]["mask"] == "full" and made["a", "w / no colour match"]["color_match"] is False and made["a", "w / mask:parsing"]["color_match"] is True
    measure = lambda c: c.withColumn("score", F.when(F.col("mask") == "parsing", 0.7).when(F.col("mask") == "full", 0.3))
    found = {(r["job"], r["label"]): (r["score"], r["failed"], r["better"]) for r in select.refined(winners, done, ["job"], measure).collect()}
    assert found["a", "w / mask:parsing"] == (0.7, False, True) and found["b", "x / mask:full"] == (0.3, False, False) and found["c", "y / mask:model"] == (-1.0, True, False)


def test_matrix_has_a_cell_for_each_configuration_and_category(spark):
    rows = spark.createDataFrame([("x", 1, 0.5), ("x", 2, None), ("y", 3, 1.0), ("y", 3, 0.0)], "config string, category int, v double")
    found = {(r["config"], r["category"]): (r["mean"], r["n"], r["missing"]) for r in report.matrix(rows, "config", "category", "v").collect()}
    assert len(found) == 6 and found["y", 3] == (0.5, 2, False) and found["x", 2] == (None, 0, True) and found["x", 3] == (None, 0, True)


def test_photos_of_a_folder_with_a_broken_file(spark, tmp_path):
    content = {"a.jpg": b"\xff\xd8\xff\xe0 body", "b.png": b"\x89PNG\r\n", "c.jpg": b"not an image", "d.webp": b"RIFF0000WEBP", "e.bmp": b"?", "f.jpg": b"\xff\xd8\xff\xdb", "g.jpg": b"\xff\xd8\xff\xdb2"}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    found = files.photos(spark, str(tmp_path))
    rows = {r["name"]: r for r in found.collect()}
    assert {n: (r["bytes"], r["sha256"]) for n, r in rows.items()} == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in content.items()}
    assert [n for n, r in sorted(rows.items()) if r["format"] is None] == ["c.jpg", "e.bmp"]
    request = found.select(F.lit(1).alias("request"), "name", F.col("format").isNotNull().alias("readable"))
    faces = spark.createDataFrame([(1, "a.jpg"), (1, "a.jpg"), (1, "g.jpg")], "request int, name string")
    problems = files.source_problems(request, faces, ["request"], "name")
    assert {r["name"]: r["problem"] for r in problems.collect()} == {
        "a.jpg": None, "b.png": "no face found", "c.jpg": "unreadable or unsupported", "d.webp": "no face found", "e.bmp": "unreadable or unsupported",
        "f.jpg": "not read: more than 5 photos", "g.jpg": "not read: more than 5 photos",
    }
    assert files.unusable(problems, ["request"]).count() == 0
    assert files.unusable(problems.where("name = 'c.jpg'"), ["request"]).first()["error"] == "c.jpg: unreadable or unsupported"


def test_times_ranges_and_lengths(spark):
    rows = spark.createDataFrame([("a@12.5", 6.0, 144, 23.839), ("b", 0.0, 10, 25.0), ("c@x", 3.0, 0, 25.0), ("d@1@2", 8.0, 10, 25.0)], "n string, s double, f int, r double")
    found = rows.select(score.source_time(F.col("n")), score.audio_seconds(F.col("s"), F.col("f"), F.col("r")), score.range_error(F.col("s"), F.lit(6.0))).collect()
    assert [r[0] for r in found] == [12.5, None, None, 2.0] and [r[1] for r in found] == [6.090522, None, 3.05, 8.05]
    assert [r[2] for r in found] == ["range is empty", None, None, "range is empty"]


def test_detectors_are_judged_by_the_face_that_is_there(spark):
    tries = spark.createDataFrame([("c", d, f, 10.0 * d) for d in (1, 2) for f in range(3)], "clip string, detector int, frame int, ms double")
    at = lambda x: ([x, 0.0], [[x - 1, 0.0], [x + 1, 0.0]])
    found = [("c", 1, 0, 0, *at(11.0)), ("c", 1, 0, 1, *at(50.0)), ("c", 1, 1, 0, *at(13.0)), ("c", 2, 2, 0, *at(5.0))]
    reference = spark.createDataFrame([("c", 0, *at(10.0)), ("c", 1, *at(10.0))], "clip string, frame int, centre array<double>, points array<array<double>>")
    rows = {r["detector"]: r for r in report.detector_rows(tries, spark.createDataFrame(found, "clip string, detector int, frame int, det int, centre array<double>, points array<array<double>>"), reference).collect()}
    assert (rows[1]["recall"], rows[1]["boxes_total"], rows[1]["landmark_err_px"], rows[1]["ms"]) == (0.667, 3, 2.0, 10.0)
    assert (rows[2]["recall"], rows[2]["boxes_total"], rows[2]["landmark_err_px"]) == (0.333, 1, None)
