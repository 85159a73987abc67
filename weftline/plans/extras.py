"""Queries for filters, joins and scalar rules that the other modules don't show."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import geo, score, vec
from weftline.operators import observe, select, sequence
from weftline.plans.registry import query
from weftline.plans.stand_ins import DET, OBS, detections, observations, table
from weftline.plans.vectors import CENTRES


@query(f"WITH {CENTRES}, a AS (SELECT vec_id, list_inner_product(e, centre) / sqrt(list_inner_product(e, e)) AS s FROM q, centre WHERE centre.label = 3) SELECT vec_id, round(s, 6) AS similarity FROM a WHERE round(s, 6) >= 5e-2")
def same_person_filter(spark, sf_dir):
    rows = observations(spark, sf_dir)
    anchor = observe.weighted_centre(rows.where("label = 3"), ["label"], score.quality()).select("centre")
    # The anchor is one row.
    near = rows.join(F.broadcast(anchor), F.lit(True)).withColumn("similarity", F.round(vec.cosine("embedding", "centre"), 6))
    return near.where("similarity >= 0.05").select("vec_id", "similarity")


@query(f"""WITH {OBS}, s AS (SELECT label, generate_subscripts(e, 1) AS dim, unnest(e) AS x FROM obs), m AS (SELECT label, dim, avg(x) AS v FROM s GROUP BY ALL), c AS (SELECT label, list(v ORDER BY dim) AS c FROM m GROUP BY label),
a AS (SELECT vec_id, label, list_inner_product(e, c) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(c, c))) AS s FROM obs JOIN c USING (label)),
g AS (SELECT label, count(*) AS n, max((s >= 15e-2)::INT) AS any_in FROM a GROUP BY label) SELECT vec_id, label, n < 3 OR any_in = 0 OR s >= 15e-2 AS kept FROM a JOIN g USING (label)""")
def agreement_filter(spark, sf_dir):
    return observe.reject_outliers(observations(spark, sf_dir), ["label"], 1.0, floor=0.15).select("vec_id", "label", "kept")


@query("""WITH t AS (SELECT l_orderkey AS frame, l_linenumber AS det, l_partkey % 20 * 5 AS s, CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE 1 END AS d FROM lineitem),
s(tier, d, least) AS (VALUES (1, 1, 50), (2, 1, 30), (3, 2, 35), (4, 2, 25)), p AS (SELECT frame, det, min(tier) AS tier FROM t JOIN s ON t.d = s.d AND t.s > s.least GROUP BY ALL),
b AS (SELECT frame, min(tier) AS tier FROM p GROUP BY frame) SELECT t.frame, t.det, b.tier FROM t JOIN b USING (frame) JOIN s ON s.tier = b.tier AND s.d = t.d AND t.s > s.least""")
def threshold_fallback(spark, sf_dir):
    """Scores in steps of 0.05, so that many stand on a threshold."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("det"), (F.col("l_partkey") % 20 * 5 / 100).alias("s"), F.when(F.col("l_suppkey") % 3 == 0, 2).otherwise(1).alias("detector")
    )
    return select.tiered(rows, "frame", "s", "detector", select.ladder(0.5)).select("frame", "det", "tier")


@query(f"""WITH {DET}, c AS (SELECT frame, det, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, row_number() OVER (PARTITION BY frame ORDER BY (x2 - x1) * (y2 - y1) DESC, det) AS r FROM det),
d AS (SELECT c.frame, c.det, row_number() OVER (PARTITION BY c.frame ORDER BY round(sqrt(pow(c.x - o.x, 2) + pow(c.y - o.y, 2)), 6), c.det) AS r, round(sqrt(pow(c.x - o.x, 2) + pow(c.y - o.y, 2)), 6) AS away FROM c JOIN c o ON o.frame = c.frame AND o.r = 1 AND c.det <> o.det)
SELECT frame, det, away FROM d WHERE r = 1""")
def nearest_face(spark, sf_dir):
    rows = detections(spark, sf_dir)
    middle = geo.centre("box")
    largest = select.best_per(rows, ["frame"], F.desc(geo.area("box")), F.col("det")).select("frame", F.col("det").alias("own"), middle.alias("m"))
    near = rows.join(largest, "frame").where("det <> own")
    away = F.round(F.sqrt(F.pow(middle[0] - F.col("m")[0], 2) + F.pow(middle[1] - F.col("m")[1], 2)), 6)
    return select.best_per(near.withColumn("away", away), ["frame"], F.col("away"), F.col("det")).select("frame", "det", "away")


@query("""WITH a AS (SELECT l_orderkey AS clip, l_linenumber AS frame, max(l_quantity) AS v FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY ALL), b AS (SELECT l_orderkey AS clip, l_linenumber AS frame, max(l_tax) AS w FROM lineitem WHERE l_partkey % 2 > 0 GROUP BY ALL)
SELECT clip, frame, v, w, round(abs(v - w * 100), 4) AS diff FROM a LEFT JOIN b USING (clip, frame)""")
def frame_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").alias("frame"), "l_partkey", "l_quantity", "l_tax")
    one = rows.where("l_partkey % 3 > 0").groupBy("clip", "frame").agg(F.max("l_quantity").alias("v"))
    two = rows.where("l_partkey % 2 > 0").groupBy("clip", "frame").agg(F.max("l_tax").alias("w"))
    return one.join(two, ["clip", "frame"], "left").withColumn("diff", F.round(F.abs(F.col("v") - F.col("w") * 100), 4))


@query("""WITH s AS (SELECT l_orderkey AS job, l_linenumber AS idx, sum(l_quantity::BIGINT)::BIGINT AS frames FROM lineitem GROUP BY ALL)
SELECT job, idx, (sum(frames) OVER (PARTITION BY job ORDER BY idx ROWS UNBOUNDED PRECEDING) - frames)::BIGINT AS boundary FROM s""")
def boundary_frames(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("idx")).agg(F.sum(F.col("l_quantity").cast("long")).alias("frames"))
    return rows.select("job", "idx", (F.sum("frames").over(sequence.over(["job"], ["idx"])) - F.col("frames")).alias("boundary"))


@query("SELECT p_partkey AS clip, CASE WHEN greatest(p_size * 80, p_partkey % 2400) >= 2160 THEN 1280 WHEN greatest(p_size * 80, p_partkey % 2400) >= 1440 THEN 1024 WHEN greatest(p_size * 80, p_partkey % 2400) >= 1080 THEN 960 ELSE 640 END AS detector FROM part")
def detector_ladder(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("clip"), score.detector_size(F.col("p_size") * 80, F.col("p_partkey") % 2400).alias("detector"))


@query("""WITH c AS (SELECT o_orderkey AS job, (o_orderkey % 300)::DOUBLE AS dur, (CASE WHEN o_custkey % 4 = 0 THEN o_custkey % 50 ELSE 0 END)::DOUBLE AS st, (CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 400 ELSE 0 END)::DOUBLE AS en FROM orders),
r AS (SELECT *, CASE WHEN en > 0 THEN least(en, dur) ELSE dur END AS last FROM c) SELECT job, st AS first, last, st > 0 OR (greatest(0, last - st) > 0 AND dur > 0 AND greatest(0, last - st) < dur - 1e-3) AS ranged FROM r""")
def resolved_ranges(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda every, n: F.when(cust % every == 0, cust % n).otherwise(0).cast("double")
    first, last, ranged = score.resolved_range((key % 300).cast("double"), pick(4, 50), pick(3, 400))
    return table(spark, sf_dir, "orders").select(key.alias("job"), first.alias("first"), last.alias("last"), ranged.alias("ranged"))


@query("SELECT event_id, round((1000 - event_id % 1000) / greatest((event_id % 30)::DOUBLE, 1e-6), 4) AS seconds FROM events WHERE event_id % 30 > 0")
def remaining_time(spark, sf_dir):
    left = score.remaining_seconds(F.col("event_id") % 1000, F.lit(1000), (F.col("event_id") % 30).cast("double"))
    return table(spark, sf_dir, "events").where("event_id % 30 > 0").select("event_id", F.round(left, 4).alias("seconds"))


@query("""SELECT p_partkey AS model, concat_ws(' / ', p_brand, CASE WHEN p_size % 3 = 0 THEN 'no-enhance' ELSE p_type || '@' || floor(p_size % 11 / 10 * 100)::BIGINT || '%' END, 'mask:' || p_size, CASE WHEN p_size % 2 = 0 THEN 'no-colour-match' END, CASE WHEN p_size % 5 > 0 THEN 'boost:' || (p_size % 5) END) AS label FROM part""")
def config_labels(spark, sf_dir):
    size = F.col("p_size")
    label = score.config_label(F.col("p_brand"), F.when(size % 3 != 0, F.col("p_type")), size % 11 / 10, size.cast("string"), size % 2 != 0, size % 5)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model"), label.alias("label"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'video' ELSE 'photo' END AS kind, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'insufficient memory' ELSE 'failed' END AS error FROM events""")
def source_and_error_kinds(spark, sf_dir):
    i = F.col("event_id")
    name = F.concat(F.lit("clip"), F.when(i % 5 == 0, "@1.5").otherwise(""))
    message = F.when(i % 7 == 0, None).when(i % 3 == 0, "CUDA Out Of Memory here").otherwise("bad shape")
    return table(spark, sf_dir, "events").select("event_id", score.source_kind(name).alias("kind"), score.error_class(message).alias("error"))


@query("""WITH k AS (SELECT vec_id, (vec_id % 40)::DOUBLE AS lx, (vec_id % 30)::DOUBLE AS ly, (vec_id % 40 + vec_id % 17 + 1)::DOUBLE AS rx, (vec_id % 30 + vec_id % 5)::DOUBLE AS ry, (vec_id % 40 + vec_id % 13)::DOUBLE AS nx FROM embeddings)
SELECT vec_id, round((nx - (lx + rx) / 2) / sqrt(pow(rx - lx, 2) + pow(ry - ly, 2)) * 90, 5) AS yaw, round(degrees(atan2(ry - ly, rx - lx)), 5) AS roll FROM k""")
def pose_angles(spark, sf_dir):
    i = F.col("vec_id")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    points = F.array(point(i % 40, i % 30), point(i % 40 + i % 17 + 1, i % 30 + i % 5), point(i % 40 + i % 13, i % 30))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", points.alias("p"))
    yaw, roll = geo.pose_proxy("p")
    return rows.select("vec_id", F.round(yaw, 5).alias("yaw"), F.round(roll, 5).alias("roll"))


@query("SELECT p_partkey AS model, 'detector' AS role FROM part WHERE p_size <= 10 UNION ALL SELECT p_partkey, 'swapper' FROM part WHERE p_size BETWEEN 11 AND 30 UNION ALL SELECT p_partkey, 'enhancer' FROM part WHERE p_size > 30")
def registry_union(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model"), "p_size")
    role = lambda where, name: part.where(where).select("model", F.lit(name).alias("role"))
    return role("p_size <= 10", "detector").unionByName(role("p_size between 11 and 30", "swapper")).unionByName(role("p_size > 30", "enhancer"))


@query("""WITH c AS (SELECT l_orderkey AS clip, l_linenumber AS face, l_suppkey, (l_partkey % 100)::DOUBLE AS om, (l_partkey % 30)::DOUBLE AS os, (l_suppkey % 100)::DOUBLE AS wm, (l_suppkey % 25)::DOUBLE AS ws FROM lineitem),
g AS (SELECT *, least(greatest(ws / greatest(os, 1e-3), 6e-1), 16e-1) AS g FROM c)
SELECT clip, face, l_suppkey AS supplier, round(1 + (g - 1) * 65e-2, 6) AS gain, round(least(greatest(wm - om * g, -28e0), 28e0) * 65e-2, 6) + 0e0 AS shift FROM g""")
def colour_parameters(spark, sf_dir):
    own, want = F.col("l_partkey"), F.col("l_suppkey")
    d = lambda x: x.cast("double")
    gain, shift = score.colour_correction(d(own % 100), d(own % 30), d(want % 100), d(want % 25), score.COLOUR_STRENGTH)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("clip"), F.col("l_linenumber").alias("face"), want.alias("supplier"), F.round(gain, 6).alias("gain"), (F.round(shift, 6) + 0.0).alias("shift")
    )


@query("""WITH c AS (SELECT p_partkey AS clip, p_size * 37 AS w, 1 + p_partkey % 1000 AS h FROM part), s AS (SELECT *, least(640 / w, 640 / h) AS scale FROM c)
SELECT clip, round(scale, 6) AS scale, greatest(1, round_even(w * scale, 0)::BIGINT) AS fit_width, greatest(1, round_even(h * scale, 0)::BIGINT) AS fit_height FROM s""")
def letterbox_fit(spark, sf_dir):
    scale, width, height = score.letterboxed(F.col("p_size") * 37, 1 + F.col("p_partkey") % 1000, F.lit(640))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("clip"), F.round(scale, 6).alias("scale"), width.alias("fit_width"), height.alias("fit_height"))


_FACE = """f AS (SELECT vec_id, label, (vec_id % 40)::DOUBLE AS lx, (vec_id % 30)::DOUBLE AS ly, (vec_id % 40 + 10 + vec_id % 17)::DOUBLE AS rx, (vec_id % 30 + vec_id % 5)::DOUBLE AS ry, (vec_id % 40 + vec_id % 13)::DOUBLE AS nx, (vec_id % 30 + 9)::DOUBLE AS ny,
(vec_id % 40 + 1)::DOUBLE AS ax, (vec_id % 30 + 20)::DOUBLE AS ay, (vec_id % 40 + 12 + vec_id % 3)::DOUBLE AS bx, (vec_id % 30 + 20 + vec_id % 4)::DOUBLE AS by_ FROM embeddings)"""


def _faces(spark, sf_dir):
    i = F.col("vec_id")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = i % 40, i % 30
    points = F.array(point(x, y), point(x + 10 + i % 17, y + i % 5), point(x + i % 13, y + 9), point(x + 1, y + 20), point(x + 12 + i % 3, y + 20 + i % 4))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", points.alias("p"))


@query(f"""WITH {_FACE}, e AS (SELECT *, sqrt(pow(rx - lx, 2) + pow(ry - ly, 2)) AS eye FROM f)
SELECT vec_id, round(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) / eye, 6) AS width, round(sqrt(pow((ax + bx) / 2 - nx, 2) + pow((ay + by_) / 2 - ny, 2)) / eye, 6) AS opening,
round(abs(degrees(atan2(ry - ly, rx - lx)) - degrees(atan2(by_ - ay, bx - ax))), 5) AS skew FROM e""")
def mouth_shapes(spark, sf_dir):
    width, opening, skew = geo.mouth_shape("p")
    return _faces(spark, sf_dir).select("vec_id", F.round(width, 6).alias("width"), F.round(opening, 6).alias("opening"), F.round(skew, 5).alias("skew"))


_MOVED = " + ".join(f"sqrt(pow({x} - lag({x}) OVER w, 2) + pow({y} - lag({y}) OVER w, 2))" for x, y in (("lx", "ly"), ("rx", "ry"), ("nx", "ny"), ("ax", "ay"), ("bx", "by_")))


@query(f"WITH {_FACE} SELECT vec_id, coalesce(round(({_MOVED}) / 5 / sqrt(pow(rx - lx, 2) + pow(ry - ly, 2)), 6), 0e0) AS motion FROM f WINDOW w AS (PARTITION BY label ORDER BY vec_id)")
def landmark_motion(spark, sf_dir):
    before = F.lag("p").over(sequence.over(["label"], ["vec_id"]))
    return _faces(spark, sf_dir).withColumn("before", before).select("vec_id", F.round(geo.landmark_motion("before", "p"), 6).alias("motion"))
