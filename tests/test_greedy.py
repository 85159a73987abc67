"""Greedy choice by rounds against a plain pass, in keys that no task could hold as an array."""

import random

import numpy as np
from pyspark.sql import functions as F

from weftline.functions import fold, vec
from weftline.operators import greedy, observe

VIEWS = "who string, vec_id long, yaw double, q double, embedding array<double>"


def views(n, seed, dims=3, keys=("a", "b", None), spread=160):
    r = random.Random(seed)
    return [(r.choice(keys), i, r.uniform(-spread / 2, spread / 2), round(r.random(), 1), [r.gauss(0, 1) for _ in range(dims)]) for i in range(n)]


def close(a, b, pose, similarity):
    u, v = (np.array(x[4]) / max(np.linalg.norm(x[4]), 1e-6) for x in (a, b))
    return abs(a[2] - b[2]) <= pose and float(u @ v) >= similarity


def one_pass(rows, pose, similarity):
    """vec_id of the kept row that each row clashes with first, best first; None for those kept."""
    out, kept = {}, []
    for x in sorted(rows, key=lambda r: (str(r[0]), -r[3], r[1])):
        of = next((k[1] for k in kept if k[0] == x[0] and close(k, x, pose, similarity)), None)
        out[x[1]] = of
        if of is None:
            kept.append(x)
    return out


def test_rounds_equal_one_pass(spark):
    for dims, pose, similarity in ((3, 12.0, 0.30), (2, 160.0, 0.99)):
        rows = [r for r in views(300, dims * 7, dims) if r[0]]
        frame = spark.createDataFrame(rows, VIEWS)
        want = one_pass(rows, pose, similarity)
        assert None in want.values() and any(v is not None for v in want.values())
        marked = observe.marked_duplicates(frame, ["who"], F.col("q"), pose, similarity).collect()
        assert {r["vec_id"]: r["duplicate_of"] for r in marked} == want and {r["penalty"] for r in marked} == {1.0, 0.5}
        kept = observe.deduplicated(frame, ["who"], F.col("q"), pose, similarity, most=7).collect()
        for who in ("a", "b"):
            best = sorted((-r[3], r[1]) for r in rows if r[0] == who and want[r[1]] is None)[:7]
            assert [(r["rank"], r["vec_id"]) for r in sorted(kept, key=lambda r: r["rank"]) if r["who"] == who] == [(i, v) for i, (_, v) in enumerate(best)]


def test_a_chain_of_clashes_is_settled_link_by_link(spark):
    clashes = spark.createDataFrame([("k", i, i + 1) for i in range(9)] + [("k", 0, 9), ("other", 5, 6)], "who string, better long, worse long")
    assert sorted(tuple(r) for r in greedy.dropped(clashes, ["who"]).collect()) == [("k", 1), ("k", 3), ("k", 5), ("k", 7), ("k", 9), ("other", 6)]
    assert greedy.dropped(clashes.limit(0), ["who"]) is None


def test_no_rows_null_keys_and_zero_vectors(spark):
    rows = [("a", 1, 0.0, 0.5, [0.0, 0.0]), ("a", 2, 1.0, 0.4, [1.0, 0.0]), ("a", 3, 2.0, 0.3, [2.0, 0.0]), ("a", 4, 500.0, 0.2, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, VIEWS)
    assert {r["vec_id"]: r["duplicate_of"] for r in observe.marked_duplicates(frame, ["who"], F.col("q"), 12.0, 0.86).collect()} == {1: None, 2: None, 3: 2, 4: None}
    assert observe.marked_duplicates(frame.limit(0), ["who"], F.col("q")).count() == 0 and observe.deduplicated(frame.limit(0), ["who"], F.col("q")).count() == 0


def test_pivots_lose_no_pair_and_spare_most_comparisons(spark):
    r = np.random.default_rng(5)
    middles = r.normal(size=(60, 3))
    rows = [("hot", i, float(i % 10), 0.5, (middles[i % 60] + r.normal(size=3) * 0.1).tolist()) for i in range(900)]
    frame = spark.createDataFrame(rows, VIEWS)
    found = {(x["a"], x["b"]) for x in observe.near_pairs(frame, ["who"], 12.0, 0.86).collect()}
    looks = np.array([x[4] for x in rows])
    looks /= np.linalg.norm(looks, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(looks @ looks.T >= 0.86, 1))
    assert found == set(zip(a.tolist(), b.tolist())) and len(found) > 1_000
    compared = greedy.comparisons(frame, ["who"], 12.0, 0.86).first()
    assert compared["all_pairs"] == 900 * 899 // 2 and len(found) < compared["compared"] < 0.5 * compared["all_pairs"]


def test_one_key_of_two_hundred_thousand_rows(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        i = F.col("id")
        rows = spark.range(200_000, numPartitions=16).select(
            F.lit("hot").alias("who"), i.alias("vec_id"), (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 10).alias("yaw"),
            (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000).alias("q"), F.array(F.lit(1.0), (i % 2).cast("double")).alias("embedding"),
        )
        marked = observe.marked_duplicates(rows, ["who"], F.col("q"), 0.5, 0.9).select("vec_id", "duplicate_of").toPandas()
        table = rows.drop("who").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    place = {v: k for k, v in enumerate(table.sort_values(["q", "vec_id"], ascending=[False, True])["vec_id"].tolist())}
    of, cells = {}, {}
    yaw = dict(zip(table["vec_id"].tolist(), table["yaw"].tolist()))
    for v in sorted(yaw, key=place.get):
        cell = int(yaw[v] // 0.5)
        near = [k for c in (cell - 1, cell, cell + 1) for k in cells.get((v % 2, c), ()) if abs(yaw[k] - yaw[v]) <= 0.5]
        of[v] = min(near, key=place.get, default=None)
        if not near:
            cells.setdefault((v % 2, cell), []).append(v)
    got = {int(v): None if np.isnan(d) else int(d) for v, d in zip(marked["vec_id"], marked["duplicate_of"].astype(float))}
    assert got == of


def test_boxes_are_suppressed_as_by_a_pass_over_an_array(spark):
    r = random.Random(4)
    rows = []
    for i in range(600):
        x, y, w, h = r.uniform(0, 60), r.uniform(0, 20), r.choice([2, 5, 9, 30]), r.choice([3, 6, 12])
        rows.append((r.choice([1, 2]), i, [x, y, x + w * r.uniform(1, 1.3), y + h], round(r.random(), 2)))
    frame = spark.createDataFrame(rows, "clip int, det long, box array<double>, score double")
    kept = greedy.suppressed(frame, ["clip"], -F.col("score"), "det", 0.4)
    lists = frame.withColumn("order", -F.col("score")).groupBy("clip").agg(fold.ordered(["order", "det"], ["box"]).alias("rows"))
    want = lists.select("clip", F.explode(fold.nms("rows", 0.4)).alias("k")).select("clip", "k.det")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect())) and 0 < kept.count() < 600


def test_blocks_find_the_pairs_that_a_join_finds(spark, monkeypatch):
    odd = [("a", 900, 0.0, 0.5, None), ("a", 901, None, 0.5, [1.0, 0.0, 0.0]), ("a", 902, float("nan"), 0.5, [1.0, 0.0, 0.0]), (None, 903, 0.0, 0.5, [1.0, 0.0, 0.0])]
    odd += [("a", 904, 0.0, 0.5, [1.0, None, 0.0]), ("a", 905, 0.0, 0.5, [float("nan"), 0.0, 1.0]), ("a", 906, 0.0, 0.5, [1.0, 0.5]), ("a", 907, 1.0, 0.5, [1.0, 0.4]), ("a", 908, 0.0, 0.5, [])]
    odd += [("a", 7, 3.0, 0.1, [1.0, 0.0, 0.0]), ("a", 909, 0.0, 0.5, [0.0, 0.0, 0.0])]  # an id of two rows, a vector of no length
    frame = spark.createDataFrame(views(260, 11) + odd, VIEWS)
    for pose, similarity in ((12.0, 0.30), (40.0, 0.86)):
        found = []
        for few, block in ((10**9, 4_096), (0, 40)):
            monkeypatch.setattr(greedy, "FEW", few)
            monkeypatch.setattr(greedy, "BLOCK", block)
            rows = greedy.near_pairs(frame, ["who"], -F.col("q"), pose, similarity)
            found.append(sorted((r["who"], *r["better"], *r["worse"], repr(r["similarity"])) for r in rows.collect()))
        assert found[0] == found[1] and len(found[0]) > 100
        assert {(906, 907)} | ({(905, 909)} if similarity < greedy.PIVOTS_FROM else set()) <= {tuple(sorted((x[2], x[4]))) for x in found[0]}  # NaN counts as more than any number
        want = [(a, b) for a in views(260, 11) for b in views(260, 11) if a[0] and a[0] == b[0] and (-a[3], a[1]) < (-b[3], b[1]) and close(a, b, pose, similarity)]
        assert sorted((x[2], x[4]) for x in found[0] if max(x[2], x[4]) < 900 and (-0.1, 7) not in (x[1:3], x[3:5])) == sorted((a[1], b[1]) for a, b in want)
