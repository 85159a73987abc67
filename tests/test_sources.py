"""Samples of cards, as batches and as a stream, and batches with their failures as a column."""

from weftline.sources import files

CARD = "memory double, used int, power double, temp int"
LINES = ["4600, 43, 120.5, 61", " 4601 ,44,121,62", "4602, [N/A], 120, 61", "short, 1", "", "4603, 45, 122.5, 63, extra"]


def test_first_card_of_each_poll(spark):
    polls = spark.createDataFrame([(1, "4600, 43, 120.5, 61\n9999, 1, 1, 1\n"), (2, "\n 4601, 44, 121, 62"), (3, ""), (4, None), (5, "x, y\n4600, 43, 120.5, 61")], "at int, output string")
    found = sorted(map(tuple, files.first_card(polls, "output", CARD).collect()))
    assert found == [(1, 4600.0, 43, 120.5, 61), (2, 4601.0, 44, 121.0, 62)]


def test_samples_come_as_a_stream(spark, tmp_path):
    for i in range(0, len(LINES), 2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.csv").write_text("\n".join(LINES[i : i + 2]) + "\n")
    stream = files.sample_stream(spark, str(tmp_path / "in"), CARD, 1)
    q = stream.writeStream.format("memory").queryName("cards").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("cards").collect())) == [(4600.0, 43, 120.5, 61), (4601.0, 44, 121.0, 62), (4603.0, 45, 122.5, 63)]
    assert q.lastProgress is not None and spark.table("cards").columns == ["memory", "used", "power", "temp"]


def test_a_batch_has_its_failures_as_a_column(spark):
    wanted = spark.createDataFrame([("a", 5, "x"), ("b", 5, "x"), ("c", 5, "x"), ("d", None, None), ("e", 5, None)], "name string, size long, digest string")
    found = spark.createDataFrame([("a", 5, "x"), ("b", 6, "x"), ("c", 5, "y"), ("d", 1, "z")], "name string, size long, digest string")
    errors = {r["name"]: r["error"] for r in files.ensured(wanted, found, "name", "size", "digest").collect()}
    assert errors == {"a": None, "b": "size is 6, not 5", "c": "digest differs", "d": None, "e": "missing"}
