"""Queries on ordered series, boxes and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import fold, geo
from weftline.operators import sequence, track, walk
from weftline.plans.registry import query
from weftline.plans.stand_ins import DET, detections, series, table

_SHOTS = """sh AS (SELECT user_id AS clip, ts, event_id, value, event_type, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS shot FROM events),
li AS (SELECT clip, shot, list(value ORDER BY ts, event_id) AS v, list(event_id ORDER BY ts, event_id) AS ids FROM sh GROUP BY clip, shot),
ix AS (SELECT clip, shot, v, ids, unnest(range(1, len(v) + 1)) AS i FROM li)"""


def _shots(spark, sf_dir):
    return sequence.shots(series(spark, sf_dir), ["clip"], ["ts", "event_id"], "cut")


@query("SELECT event_id, round(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 6) AS delta FROM events")
def consecutive_delta(spark, sf_dir):
    return sequence.deltas(series(spark, sf_dir), ["clip"], ["ts", "event_id"], "value").select("event_id", F.round("delta", 6).alias("delta"))


@query(f"WITH {_SHOTS} SELECT clip, event_id, shot FROM sh")
def shot_segments(spark, sf_dir):
    return _shots(spark, sf_dir).select("clip", "event_id", "shot")


@query(f"WITH {_SHOTS} SELECT ids[i] AS event_id, round(list_reduce(v[1:i], lambda s, x: 8e-1 * s + (1e0 - 8e-1) * x), 6) AS smoothed FROM ix")
def ema(spark, sf_dir):
    rows = sequence.ema(_shots(spark, sf_dir), ["clip", "shot"], ["ts", "event_id"], "value", 0.80)
    return rows.select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query(f"WITH {_SHOTS} SELECT ids[i] AS event_id, round(list_reduce(v[1:i], lambda s, x: 6e-1 * exp(-abs(x - s) / 6e0) * s + (1e0 - 6e-1 * exp(-abs(x - s) / 6e0)) * x), 5) AS smoothed FROM ix")
def adaptive_ema(spark, sf_dir):
    rows = sequence.adaptive_ema(_shots(spark, sf_dir), ["clip", "shot"], ["ts", "event_id"], "value")
    return rows.select("event_id", F.round("smoothed", 5).alias("smoothed"))


@query("""WITH w AS (SELECT event_id, value, quantile_cont(value, 0.5) OVER b AS base, count(value) OVER b AS n FROM events WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT event_id, round(base, 6) AS baseline, n >= 3 AND value >= 8 AND value >= 3 * greatest(base, 1e0) AS spike FROM w""")
def spike_baseline_window(spark, sf_dir):
    rows = sequence.spikes(series(spark, sf_dir), ["clip"], ["ts", "event_id"], "value")
    return rows.select("event_id", F.round("baseline", 6).alias("baseline"), "spike")


_ORDERED = "o AS (SELECT user_id AS clip, event_id, value, floor(epoch(ts)) AS t, event_type = 'purchase' AS final, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)"


@query(f"""WITH RECURSIVE {_ORDERED}, st(clip, r, event_id, recent, is_cut) AS (SELECT clip, r, event_id, [value], false FROM o WHERE r = 1 UNION ALL
SELECT clip, r, event_id, CASE WHEN cut THEN [value] ELSE list_append(recent, value)[-24:] END, cut FROM (
  SELECT o.*, s.recent, len(s.recent) >= 3 AND o.value >= 8 AND o.value >= 3 * greatest(list_aggregate(s.recent, 'median'), 1e0) AS cut FROM st s JOIN o ON o.clip = s.clip AND o.r = s.r + 1))
SELECT clip, event_id, is_cut FROM st""")
def scene_cut_exact(spark, sf_dir):
    return walk.spike_cuts(series(spark, sf_dir), ["clip"], ["ts", "event_id"], "value").select("clip", "event_id", "is_cut")


@query(f"""WITH RECURSIVE {_ORDERED}, st(clip, r, event_id, last, emitted) AS (SELECT clip, r, event_id, t, true FROM o WHERE r = 1 UNION ALL
SELECT clip, r, event_id, CASE WHEN due THEN t ELSE last END, due FROM (SELECT o.*, s.last, o.t - s.last >= 3600 OR o.final AS due FROM st s JOIN o ON o.clip = s.clip AND o.r = s.r + 1))
SELECT clip, event_id, emitted FROM st""")
def throttled_progress(spark, sf_dir):
    rows = series(spark, sf_dir).withColumn("t", F.unix_timestamp("ts").cast("double")).withColumn("final", F.col("event_type") == "purchase")
    return walk.throttled(rows, ["clip"], ["ts", "event_id"], "t", 3600.0, "final").select("clip", "event_id", "emitted")


@query("""WITH l AS (SELECT user_id AS clip, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS same FROM events)
SELECT clip, count(*) FILTER (WHERE same) AS repeats, count(*) AS n FROM l GROUP BY clip""")
def duplicate_runs(spark, sf_dir):
    rows = sequence.runs(series(spark, sf_dir), ["clip"], ["ts", "event_id"], "event_type")
    return rows.groupBy("clip").agg(F.count(F.when(F.col("repeated"), 1)).alias("repeats"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id AS clip, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events),
c AS (SELECT clip, step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY n DESC, step) AS r FROM c)
SELECT clip, min(step) AS shortest, max(step) AS longest, min(step) FILTER (WHERE r = 1) AS usual, count(*) AS kinds FROM r GROUP BY clip""")
def frame_steps(spark, sf_dir):
    return sequence.steps(series(spark, sf_dir), ["clip"], ["event_id"], F.col("event_id"))


@query(f"""WITH {DET}, b AS (SELECT frame, det, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS area FROM det), p AS (SELECT a.frame, a.det AS a, b.det AS b,
greatest(0e0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0e0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, a.area + b.area AS s FROM b a JOIN b ON a.frame = b.frame AND a.det < b.det)
SELECT frame, a, b, round(CASE WHEN i <= 0 THEN 0e0 ELSE i / greatest(s - i, 1e-6) END, 6) AS iou FROM p""")
def iou_pairs(spark, sf_dir):
    rows = detections(spark, sf_dir)
    left = rows.select("frame", F.col("det").alias("a"), F.col("box").alias("box_a"))
    right = rows.select("frame", F.col("det").alias("b"), F.col("box").alias("box_b"))
    return left.join(right, "frame").where("a < b").select("frame", "a", "b", F.round(geo.iou("box_a", "box_b"), 6).alias("iou"))


_IOU = "greatest(0e0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) * greatest(0e0, least(k.y2, o.y2) - greatest(k.y1, o.y1))"


@query(f"""WITH RECURSIVE {DET}, o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, det) AS r FROM det),
st(frame, r, kept) AS (SELECT frame, r, [det] FROM o WHERE r = 1 UNION ALL
SELECT s.frame, o.r, CASE WHEN EXISTS (SELECT 1 FROM o k WHERE k.frame = s.frame AND list_contains(s.kept, k.det) AND
  ({_IOU}) > 4e-1 * greatest((k.x2 - k.x1) * (k.y2 - k.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - ({_IOU}), 1e-6)) THEN s.kept ELSE list_append(s.kept, o.det) END
FROM st s JOIN o ON o.frame = s.frame AND o.r = s.r + 1)
SELECT frame, unnest(arg_max(kept, r)) AS det FROM st GROUP BY frame""")
def nms(spark, sf_dir):
    rows = detections(spark, sf_dir).withColumn("order", -F.col("score"))
    kept = rows.groupBy("frame").agg(fold.ordered(["order", "det"], ["box"]).alias("rows")).select("frame", F.explode(fold.nms("rows", 0.4)).alias("k"))
    return kept.select("frame", F.col("k.det").alias("det"))


@query(f"""WITH {DET} SELECT frame, det, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, round(sqrt(greatest(x2 - x1, 1) * greatest(y2 - y1, 1)), 6) AS size,
x1 + 2 AS moved_x1, y2 - 1 AS moved_y2 FROM det""")
def box_geometry(spark, sf_dir):
    centre = geo.centre("box")
    moved = geo.moved("box", F.array(F.lit(2.0), F.lit(-1.0)))
    return detections(spark, sf_dir).select(
        "frame", "det", geo.area("box").alias("area"), centre[0].alias("cx"), centre[1].alias("cy"), F.round(geo.size("box"), 6).alias("size"), moved[0].alias("moved_x1"), moved[3].alias("moved_y2")
    )


@query(f"""WITH {DET}, p AS (SELECT a.frame, a.det AS track, b.det AS det, ((a.det * 7 + b.det * 3) % 20) / 20 AS identity,
greatest(0e0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0e0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s,
sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) / 100 AS dist,
sqrt(greatest(b.x2 - b.x1, 1) * greatest(b.y2 - b.y1, 1)) / sqrt(greatest(a.x2 - a.x1, 1) * greatest(a.y2 - a.y1, 1)) AS ratio FROM det a JOIN det b ON a.frame = b.frame AND a.det < b.det)
SELECT frame, track, det, round(6e-1 * identity + 18e-2 * (CASE WHEN i <= 0 THEN 0e0 ELSE i / greatest(s - i, 1e-6) END) + 14e-2 * exp(-dist * 8) + 8e-2 * exp(-abs(ln(greatest(ratio, 1e-3))) * 15e-1), 6) AS score FROM p""")
def match_scores(spark, sf_dir):
    rows = detections(spark, sf_dir)
    left = rows.select("frame", F.col("det").alias("track"), F.col("box").alias("t"))
    right = rows.select("frame", "det", F.col("box").alias("d"))
    a, b = geo.centre("t"), geo.centre("d")
    away = F.sqrt(F.pow(a[0] - b[0], 2) + F.pow(a[1] - b[1], 2)) / 100
    identity = ((F.col("track") * 7 + F.col("det") * 3) % 20) / 20
    value = geo.match_score(identity, geo.iou("t", "d"), away, geo.size("d") / geo.size("t"))
    return left.join(right, "frame").where("track < det").select("frame", "track", "det", F.round(value, 6).alias("score"))


_POINTS = "unnest(range(5)) AS i"


@query("""WITH p AS (SELECT vec_id, unnest(range(5)) AS i FROM embeddings),
k AS (SELECT vec_id, i, (vec_id * (i + 3)) % 50 AS bx, (vec_id * (i + 7)) % 60 AS by_, (vec_id * (i + 3)) % 50 + (vec_id + i) % 5 AS ax, (vec_id * (i + 7)) % 60 + (vec_id * 3 + i) % 4 AS ay, 20 + vec_id % 50 AS size FROM p),
m AS (SELECT *, avg(bx) OVER w AS mbx, avg(by_) OVER w AS mby, avg(ax) OVER w AS max_, avg(ay) OVER w AS may FROM k WINDOW w AS (PARTITION BY vec_id)),
n AS (SELECT *, sum(pow(bx - mbx, 2) + pow(by_ - mby, 2)) OVER (PARTITION BY vec_id) AS qb, sum(pow(ax - max_, 2) + pow(ay - may, 2)) OVER (PARTITION BY vec_id) AS qa FROM m),
s AS (SELECT *, CASE WHEN qb = 0 THEN 1 ELSE sqrt(qb) END AS sb, CASE WHEN qa = 0 THEN 1 ELSE sqrt(qa) END AS sa FROM n)
SELECT vec_id, round(avg(sqrt(pow(ax - bx, 2) + pow(ay - by_, 2))) / max(size), 5) AS landmark_delta,
round(avg(sqrt(pow((ax - max_) / sa - (bx - mbx) / sb, 2) + pow((ay - may) / sa - (by_ - mby) / sb, 2))), 5) AS expression_delta FROM s GROUP BY vec_id""")
def landmark_deltas(spark, sf_dir):
    i = F.col("vec_id")
    before = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(((i * (k + 3)) % 50).cast("double").alias("x"), ((i * (k + 7)) % 60).cast("double").alias("y")))
    after = F.transform(
        F.sequence(F.lit(0), F.lit(4)),
        lambda k: F.struct(((i * (k + 3)) % 50 + (i + k) % 5).cast("double").alias("x"), ((i * (k + 7)) % 60 + (i * 3 + k) % 4).cast("double").alias("y")),
    )
    rows = table(spark, sf_dir, "embeddings").select("vec_id", before.alias("b"), after.alias("a"), (20 + i % 50).cast("double").alias("size"))
    return rows.select("vec_id", F.round(geo.landmark_delta("b", "a", "size"), 5).alias("landmark_delta"), F.round(geo.expression_delta("b", "a"), 5).alias("expression_delta"))


@query("SELECT vec_id, CASE WHEN d > 90 THEN d - 180 WHEN d < -90 THEN d + 180 ELSE d END AS angle FROM (SELECT vec_id, CASE WHEN a > 180 THEN a - 360 ELSE a END AS d FROM (SELECT vec_id, (((vec_id * 37) % 720 - 360)::DOUBLE % 360 + 360) % 360 AS a FROM embeddings))")
def angle_unwrap(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", geo.unwrap(((F.col("vec_id") * 37) % 720 - 360).cast("double")).alias("angle"))


def _tracked(spark, sf_dir):
    """A clip of 100 frames for 200 vectors. Person 0, the larger, is away from frame 20 to 69; from 30 to 34 a stranger stands where person 1 is."""
    i = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 200").alias("clip"), F.expr("vec_id % 200 div 2").alias("frame"), (i % 2).cast("int").alias("det"))
    frame, det = F.col("frame"), F.col("det")
    person = F.when((det == 1) & frame.between(30, 34), 2).otherwise(det)
    x = F.when(det == 0, frame * 1.5).otherwise(160.0 - frame * 1.5)
    look = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.when(k == person, 1.0).otherwise(0.0))
    there = (det == 1) | (frame < 20) | (frame >= 70)
    return rows.where(there).withColumn("box", F.array(x, F.lit(10.0), x + 30 - det * 10, F.lit(40.0))).withColumn("score", F.lit(0.9)).withColumn("embedding", look)


#: Tracks by number: person 0, person 1, the stranger, and person 0 again, whose first track has ended after 45 misses.
@query("""WITH r AS (SELECT vec_id // 200 AS clip, vec_id % 200 // 2 AS frame, (vec_id % 2)::INT AS det FROM embeddings)
SELECT clip, frame, det, (CASE WHEN det = 1 THEN CASE WHEN frame BETWEEN 30 AND 34 THEN 3 ELSE 2 END WHEN frame < 20 THEN 1 ELSE 4 END)::INT AS track FROM r WHERE det = 1 OR frame < 20 OR frame >= 70""")
def track_assignment(spark, sf_dir):
    return track.assign(_tracked(spark, sf_dir), "clip", 200.0)


@query("""WITH r AS (SELECT DISTINCT vec_id // 200 AS clip, vec_id % 200 // 2 AS frame FROM embeddings WHERE vec_id % 2 = 1 OR vec_id % 200 < 40 OR vec_id % 200 >= 140)
SELECT clip, frame, CASE WHEN frame < 20 OR frame >= 70 THEN 0::INT END AS det,
CASE WHEN frame = 0 THEN 'locked' WHEN frame = 70 THEN 'reacquired' WHEN frame < 20 OR frame > 70 THEN 'followed' ELSE 'skipped' END AS event FROM r""")
def target_lock(spark, sf_dir):
    return track.follow(_tracked(spark, sf_dir), "clip", 200.0)


@query("""WITH r AS (SELECT DISTINCT vec_id // 200 AS clip, vec_id % 200 // 2 AS frame FROM embeddings WHERE vec_id % 2 = 1 OR vec_id % 200 < 40 OR vec_id % 200 >= 140)
SELECT clip, count(*) FILTER (WHERE frame < 20 OR frame >= 70) AS followed, count(*) FILTER (WHERE frame BETWEEN 20 AND 69) AS skipped,
count(*) FILTER (WHERE frame = 70) AS reacquired, 0::BIGINT AS switched FROM r GROUP BY clip""")
def lock_report(spark, sf_dir):
    return track.report(track.follow(_tracked(spark, sf_dir), "clip", 200.0), "clip")


@query(f"""WITH {DET}, p AS (SELECT frame, det, score - 2e-1 AS alike, greatest(0e0, 1e0 - least(1e0, sqrt(pow((x1 + x2) / 2 - 20, 2) + pow((y1 + y2) / 2 - 20, 2)) / 100)) AS near FROM det),
r AS (SELECT frame, det, round(alike + 35e-2 * near, 6) AS value, row_number() OVER (PARTITION BY frame ORDER BY round(alike + 35e-2 * near, 6) DESC, det) AS r FROM p)
SELECT frame, CASE WHEN value >= 15e-2 THEN det END AS det, value FROM r WHERE r = 1""")
def proximity_pick(spark, sf_dir):
    rows = detections(spark, sf_dir).withColumn("like", F.col("score") - 0.2)
    return sequence.nearest_alike(rows, ["frame"], "like", F.array(F.lit(20.0), F.lit(20.0)), 100.0).select("frame", "det", "value")


#: A clip a label, a frame a vector; every 37th id is a cut.
_VIEWS = """v AS (SELECT label AS clip, vec_id, embedding::DOUBLE[] AS e, vec_id % 37 = 0 AS cut, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings)"""


def _views(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), "vec_id", F.col("embedding").cast("array<double>").alias("look"), (F.col("vec_id") % 37 == 0).alias("cut"))


@query(f"""WITH RECURSIVE {_VIEWS}, st(clip, r, vec_id, s) AS (SELECT clip, r, vec_id, e FROM v WHERE r = 1 UNION ALL
SELECT v.clip, v.r, v.vec_id, CASE WHEN v.cut THEN v.e ELSE list_transform(list_zip(st.s, v.e), lambda z: 8e-1 * z[1] + (1e0 - 8e-1) * z[2]) END FROM st JOIN v ON v.clip = st.clip AND v.r = st.r + 1)
SELECT vec_id, (generate_subscripts(s, 1) - 1)::INT AS dim, round(unnest(s) / sqrt(list_inner_product(s, s)), 6) AS value FROM st""")
def ema_vector(spark, sf_dir):
    rows = walk.smoothed(_views(spark, sf_dir), ["clip"], ["vec_id"], "look", 0.80, cut="cut")
    return rows.select("vec_id", F.posexplode("smoothed").alias("dim", "value")).select("vec_id", "dim", F.round("value", 6).alias("value"))


@query(f"""WITH RECURSIVE {_VIEWS}, m AS (SELECT clip, vec_id, r, cut, [1 + e[1] / 10, e[2] / 10, 20 * e[3], e[4] / 10, 1 + e[5] / 10, 20 * e[6]] AS m, (40 + vec_id % 160)::DOUBLE AS face FROM v),
st(clip, r, vec_id, s) AS (SELECT clip, r, vec_id, m FROM m WHERE r = 1 UNION ALL
SELECT clip, r, vec_id, CASE WHEN cut THEN m ELSE list_transform(list_zip(s, m), lambda z: w * z[1] + (1e0 - w) * z[2]) END FROM (
  SELECT m.*, st.s, 6e-1 * exp(-(sqrt(pow(m.m[3] - st.s[3], 2) + pow(m.m[6] - st.s[6], 2)) / greatest(face, 1e0) * 100) / 6e0) AS w FROM st JOIN m ON m.clip = st.clip AND m.r = st.r + 1))
SELECT vec_id, (generate_subscripts(s, 1) - 1)::INT AS cell, round(unnest(s), 6) AS value FROM st""")
def adaptive_ema_matrix(spark, sf_dir):
    e = lambda i: F.col("look")[i - 1]
    matrix = F.array(1 + e(1) / 10, e(2) / 10, 20 * e(3), e(4) / 10, 1 + e(5) / 10, 20 * e(6))
    rows = _views(spark, sf_dir).withColumn("matrix", matrix).withColumn("face", (40 + F.col("vec_id") % 160).cast("double"))
    found = walk.smoothed_matrix(rows, ["clip"], ["vec_id"], "matrix", "face", cut="cut")
    return found.select("vec_id", F.posexplode("smoothed").alias("cell", "value")).select("vec_id", "cell", F.round("value", 6).alias("value"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query(f"""WITH RECURSIVE l AS (SELECT source AS clip, doc_id, lower(text) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
h AS (SELECT clip, doc_id, r, unnest(range(26)) AS k, (length(t) - length(replace(t, substr('{_LETTERS}', k::INT + 1, 1), '')))::DOUBLE AS n FROM l),
p AS (SELECT b.clip, b.r, max(b.doc_id) AS doc_id, corr(a.n, b.n) AS c, var_pop(a.n) * var_pop(b.n) = 0 AS flat, avg(abs(a.n - b.n)) AS away FROM h a JOIN h b ON b.clip = a.clip AND b.k = a.k AND b.r = a.r + 1 GROUP BY b.clip, b.r),
st(clip, r, doc_id, recent, is_cut) AS (SELECT clip, r, doc_id, []::DOUBLE[], false FROM l WHERE r = 1 UNION ALL
SELECT clip, r, doc_id, CASE WHEN cut THEN [away] ELSE list_append(recent, away)[-24:] END, cut FROM (
  SELECT p.*, st.recent, (NOT flat AND c < 9e-1) OR (len(st.recent) >= 3 AND away >= 8 AND away >= 3 * greatest(list_aggregate(st.recent, 'median'), 1e0)) AS cut FROM st JOIN p ON p.clip = st.clip AND p.r = st.r + 1))
SELECT clip, doc_id, is_cut FROM st""")
def scene_cut_histogram(spark, sf_dir):
    """A clip a source, a frame a document; its histogram is of letters."""
    t = F.lower("text")
    letters = F.array(*((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double") for c in _LETTERS))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("clip"), "doc_id", letters.alias("histogram"))
    return walk.scene_cuts(rows.withColumn("samples", F.col("histogram")), ["clip"], ["doc_id"], "histogram", "samples", least=0.9).select("clip", "doc_id", "is_cut")


def _single(spark, sf_dir):
    """A clip a label, a frame a vector, whose values shake the person's box; every 23rd frame has a stranger too, every 29th the person elsewhere, every 31st a cut."""
    i, e = F.col("vec_id"), F.col("embedding").cast("array<double>")
    x = 200 + 40 * e[0] + F.when(i % 29 == 0, 60.0).otherwise(0.0)
    y = 100 + 40 * e[1]
    rows = table(spark, sf_dir, "embeddings").withColumn("frame", i)
    rows = rows.select(
        F.col("label").alias("clip"), "frame", (i % 31 == 0).alias("cut"), x.alias("x"), y.alias("y"), F.explode(F.when(i % 23 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("det")
    )
    side = F.when(F.col("det") == 0, 60.0).otherwise(20.0)
    left = F.when(F.col("det") == 0, F.col("x")).otherwise(500.0)
    look = F.when(F.col("det") == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    return rows.select("clip", "frame", "cut", "det", F.array(left, F.col("y"), left + side, F.col("y") + side).alias("box"), F.lit(0.9).alias("score"), look.alias("embedding"))


#: The person's box, its speed (half of the last step, half of the speed before; none after a cut) and the run of skips, frame by frame.
@query("""WITH RECURSIVE f AS (SELECT label AS clip, vec_id AS frame, 200 + 40 * embedding[1]::DOUBLE + CASE WHEN vec_id % 29 = 0 THEN 60 ELSE 0 END AS x, 100 + 40 * embedding[2]::DOUBLE AS y, vec_id % 23 = 0 AS two, vec_id % 31 = 0 AS cut,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
st(clip, r, frame, x, y, vx, vy, run, verdict) AS (SELECT clip, r, frame, x, y, 0e0, 0e0, 0, CASE WHEN two THEN 'faces' ELSE 'unlocked' END FROM f WHERE r = 1 UNION ALL
SELECT clip, r, frame, x, y, (x - px) / 2 + vx / 2, (y - py) / 2 + vy / 2, CASE WHEN verdict = 'skipped' THEN run + 1 ELSE 0 END, verdict FROM (
  SELECT *, CASE WHEN two THEN 'faces' WHEN run >= 8 THEN 'forced' WHEN i / greatest(7200 - i, 1e-6) >= 55e-2 THEN 'skipped' ELSE 'refused' END AS verdict FROM (
    SELECT *, greatest(0, 60 - abs(px + vx - x)) * greatest(0, 60 - abs(py + vy - y)) AS i FROM (
      SELECT f.*, s.x AS px, s.y AS py, CASE WHEN f.cut THEN 0e0 ELSE s.vx END AS vx, CASE WHEN f.cut THEN 0e0 ELSE s.vy END AS vy, CASE WHEN f.cut THEN 8 ELSE s.run END AS run FROM st s JOIN f ON f.clip = s.clip AND f.r = s.r + 1))))
SELECT clip, frame, 0::INT AS det, CASE WHEN r = 1 THEN 'locked' ELSE 'followed' END AS event, verdict AS "check" FROM st""")
def fast_path(spark, sf_dir):
    return track.follow_fast(_single(spark, sf_dir), "clip", 1000.0)
