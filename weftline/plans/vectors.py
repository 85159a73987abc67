"""Queries on embeddings: centres, agreement, pose and redundancy."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import score, vec
from weftline.operators import greedy, observe, select, sequence
from weftline.plans.registry import query
from weftline.plans.stand_ins import OBS, observations

CENTRES = OBS + """,
s AS (SELECT label, generate_subscripts(e, 1) AS dim, unnest(e) AS x, quality FROM q),
c AS (SELECT label, dim, sum(x * quality) / greatest(sum(quality), 1e-6) AS v FROM s GROUP BY ALL),
n AS (SELECT label, greatest(sqrt(sum(v * v)), 1e-6) AS n FROM c GROUP BY label),
centre AS (SELECT label, list(v / n ORDER BY dim) AS centre FROM c JOIN n USING (label) GROUP BY label)"""
AGREE = CENTRES + """,
a AS (SELECT vec_id, q.label, e, quality, yaw, list_inner_product(e, centre) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(centre, centre))) AS agree FROM q JOIN centre USING (label))"""


@query(f"WITH {CENTRES} SELECT label, (dim - 1)::INT AS dim, round(v / n, 6) AS value FROM c JOIN n USING (label)")
def weighted_centroid(spark, sf_dir):
    centres = observe.weighted_centre(observations(spark, sf_dir), ["label"], score.quality())
    return centres.select("label", F.posexplode("centre").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {AGREE} SELECT vec_id, label, round(agree, 6) AS consensus, round(agree, 6) < 5e-2 AS is_outlier FROM a")
def consensus_scores(spark, sf_dir):
    rows = observe.consensus(observations(spark, sf_dir), ["label"], score.quality())
    return rows.select("vec_id", "label", F.round("consensus", 6).alias("consensus"), (F.round("consensus", 6) < 0.05).alias("is_outlier"))


@query(f"""WITH {AGREE}, g AS (SELECT label, count(*) AS n, max((agree >= 5e-2)::INT) AS any_in FROM a GROUP BY label),
k AS (SELECT a.*, (n < 3 OR any_in = 0 OR agree >= 5e-2) AS kept FROM a JOIN g USING (label)),
s2 AS (SELECT label, generate_subscripts(e, 1) AS dim, unnest(e) AS x, quality FROM k WHERE kept),
c2 AS (SELECT label, dim, sum(x * quality) / greatest(sum(quality), 1e-6) AS v FROM s2 GROUP BY ALL),
z AS (SELECT label, list(v ORDER BY dim) AS z FROM c2 GROUP BY label)
SELECT vec_id, label, kept, CASE WHEN kept THEN round(list_inner_product(e, z) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(z, z))), 5) END AS consensus
FROM k JOIN z USING (label)""")
def outlier_rejection(spark, sf_dir):
    rows = observe.reject_outliers(observations(spark, sf_dir), ["label"], score.quality())
    return rows.select("vec_id", "label", "kept", F.round("consensus", 5).alias("consensus"))


@query(f"""WITH {CENTRES} SELECT a.label AS a, b.label AS b, round(list_inner_product(a.centre, b.centre), 6) AS similarity,
round(list_inner_product(a.centre, b.centre), 6) < 25e-2 AS is_distinct FROM centre a JOIN centre b ON a.label < b.label""")
def cross_identity_check(spark, sf_dir):
    centres = observe.weighted_centre(observations(spark, sf_dir), ["label"], score.quality())
    pairs = observe.cross_check(centres, "label").withColumn("similarity", F.round("similarity", 6))
    return pairs.drop("distinct").withColumn("is_distinct", F.col("similarity") < 0.25)


@query(f"""WITH {CENTRES}, s2 AS (SELECT vec_id // 10 AS frame, vec_id, list_inner_product(e, centre) AS sim FROM q, centre WHERE centre.label = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY round(sim, 6) DESC, vec_id) AS r FROM s2)
SELECT frame, vec_id, round(sim, 6) AS similarity FROM r WHERE r = 1""")
def best_match_argmax(spark, sf_dir):
    rows = observations(spark, sf_dir)
    anchor = observe.weighted_centre(rows.where("label = 0"), ["label"], score.quality()).select("centre")
    # The anchor is one row.
    near = rows.join(F.broadcast(anchor), F.lit(True)).withColumn("similarity", F.round(vec.dot("embedding", "centre"), 6))
    near = near.withColumn("frame", F.expr("vec_id div 10"))
    return select.best_per(near, ["frame"], F.desc("similarity"), F.col("vec_id")).select("frame", "vec_id", "similarity")


@query(f"""WITH {OBS}, p AS (SELECT *, greatest(1e-3, least(1e0, face_px / 160) * least(greatest(detector_conf, 0e0), 1e0) * least(1e0, sharpness / 120)) AS b FROM q),
t AS (SELECT label, t.target, e, b, exp(-pow(yaw - t.target, 2) / (2e0 * 18e0 * 18e0)) * b AS w FROM p, (VALUES (-60e0), (-30e0), (0e0), (30e0), (60e0)) t(target)),
s AS (SELECT label, target, generate_subscripts(e, 1) AS dim, unnest(e) AS x, b, w FROM t)
SELECT label, target, (dim - 1)::INT AS dim, round(CASE WHEN sum(w) < 1e-8 THEN sum(x * b) / sum(b) ELSE sum(x * w) / sum(w) END, 6) AS value FROM s GROUP BY label, target, dim""")
def pose_conditioned_vector(spark, sf_dir):
    rows = observe.pose_conditioned(observations(spark, sf_dir), ["label"], [-60.0, -30.0, 0.0, 30.0, 60.0])
    return rows.withColumn("value", F.round("value", 6))


@query(f"""WITH {CENTRES}, u AS (SELECT label, dim, avg(x) AS v FROM s GROUP BY ALL), ul AS (SELECT label, list(v ORDER BY dim) AS u FROM u GROUP BY label)
SELECT label, round(1 - list_inner_product(centre, u) / (sqrt(list_inner_product(centre, centre)) * sqrt(list_inner_product(u, u))), 6) AS drift FROM centre JOIN ul USING (label)""")
def vector_drift(spark, sf_dir):
    rows = observations(spark, sf_dir)
    plain = observe.weighted_centre(rows, ["label"]).withColumnRenamed("centre", "plain")
    return observe.weighted_centre(rows, ["label"], score.quality()).join(plain, "label").select("label", F.round(vec.drift("centre", "plain"), 6).alias("drift"))


@query(f"""WITH {OBS} SELECT vec_id,
CASE WHEN face_px < 80 THEN 'face too small' WHEN detector_conf < 55e-2 THEN 'low detector confidence' WHEN sharpness < 40 THEN 'blurred' WHEN NOT exposure BETWEEN 25 AND 235 THEN 'exposure' END AS reason,
CASE WHEN face_px < 90 THEN 'face too small' WHEN detector_conf < 60e-2 THEN 'low detector confidence' WHEN sharpness < 55 THEN 'blurred' WHEN NOT exposure BETWEEN 25 AND 235 THEN 'exposure' END AS strict_reason
FROM obs""")
def defect_gate_reason(spark, sf_dir):
    return observations(spark, sf_dir).select("vec_id", score.gate().alias("reason"), score.gate(90.0, 0.60, 55.0).alias("strict_reason"))


_FACTORS = "f AS (SELECT *, least(1e0, face_px / 160) * least(greatest(detector_conf, 0e0), 1e0) * least(1e0, sharpness / 120) AS b, 4e-1 + 6e-1 * exp(-abs(yaw) / 45) AS p FROM q)"


@query(f"""WITH {OBS}, {_FACTORS}
SELECT vec_id, round(greatest(1e-3, b), 6) AS base, round(quality, 6) AS observation, round(greatest(1e-3, b * p), 6) AS photo,
round(greatest(1e-3, b * least(greatest(1e0 - abs(exposure - 128) / 118, 5e-2), 1e0) * least(greatest(1e0 - (clipped_high + clipped_low) * 3, 1e-1), 1e0) * (25e-2 + 75e-2 * visible_fraction) * p), 6) AS evidence FROM f""")
def quality_weights(spark, sf_dir):
    return observations(spark, sf_dir).select("vec_id", *(F.round(score.quality(k), 6).alias(k) for k in ("base", "observation", "photo", "evidence")))


_BIN = "CASE " + " ".join(f"WHEN yaw >= {lo} AND yaw < {hi} THEN '{n}'" for n, lo, hi in score.POSE_BINS) + " END"


@query(f"""WITH {OBS}, b(bin) AS (VALUES {", ".join(f"('{n}')" for n, _, _ in score.POSE_BINS)}), l AS (SELECT DISTINCT label FROM obs)
SELECT l.label, b.bin, count(o.vec_id) AS n FROM l CROSS JOIN b LEFT JOIN (SELECT vec_id, label, {_BIN} AS bin FROM obs) o ON o.label = l.label AND o.bin = b.bin GROUP BY ALL""")
def pose_histogram(spark, sf_dir):
    return observe.coverage(observations(spark, sf_dir), ["label"])


@query(f"""WITH {OBS} SELECT label, count(DISTINCT {_BIN}) AS bins_covered, count(*) FILTER (WHERE pitch > 12) AS looking_up, count(*) FILTER (WHERE pitch < -12) AS looking_down,
min(yaw) AS yaw_min, max(yaw) AS yaw_max FROM obs GROUP BY label""")
def pose_coverage(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("label").agg(
        F.count_distinct(score.binned("yaw")).alias("bins_covered"), F.count(F.when(F.col("pitch") > 12, 1)).alias("looking_up"),
        F.count(F.when(F.col("pitch") < -12, 1)).alias("looking_down"), F.min("yaw").alias("yaw_min"), F.max("yaw").alias("yaw_max"),
    )


@query(f"""WITH {OBS}, p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) AS similarity
FROM obs a JOIN obs b ON a.label = b.label AND a.vec_id < b.vec_id AND abs(a.yaw - b.yaw) <= 12)
SELECT label, a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 3e-1""")
def near_duplicate_pairs(spark, sf_dir):
    return observe.near_pairs(observations(spark, sf_dir), ["label"], 12.0, 0.30).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {OBS}, c AS (SELECT label, vec_id, floor(yaw / 12) AS cell FROM obs), n AS (SELECT label, (count(*) * (count(*) - 1) // 2)::BIGINT AS all_pairs FROM obs GROUP BY label)
SELECT n.label, (SELECT count(*) FROM c a JOIN c b ON a.label = b.label AND a.vec_id < b.vec_id AND abs(a.cell - b.cell) <= 1 WHERE a.label = n.label) AS compared, all_pairs FROM n""")
def pairs_compared(spark, sf_dir):
    """What `near_duplicate_pairs` compares, of all pairs of a label."""
    return greedy.comparisons(observations(spark, sf_dir), ["label"], 12.0, 0.30)


_RANKED = f"{OBS}, o AS (SELECT label, vec_id, yaw, e, sqrt(list_inner_product(e, e)) AS n, row_number() OVER (PARTITION BY label ORDER BY quality DESC, vec_id) AS r FROM q)"
_CLOSE = "list_inner_product(k.e, o.e) / (k.n * o.n) >= 3e-1"


@query(f"""WITH RECURSIVE {_RANKED}, st(label, r, kept) AS (SELECT label, r, [vec_id] FROM o WHERE r = 1 UNION ALL
SELECT s.label, o.r, CASE WHEN len(s.kept) >= 24 OR EXISTS (SELECT 1 FROM o k WHERE k.label = s.label AND list_contains(s.kept, k.vec_id) AND abs(k.yaw - o.yaw) <= 7 AND {_CLOSE}) THEN s.kept ELSE list_append(s.kept, o.vec_id) END
FROM st s JOIN o ON o.label = s.label AND o.r = s.r + 1), f AS (SELECT label, arg_max(kept, r) AS kept FROM st GROUP BY label)
SELECT label, (generate_subscripts(kept, 1) - 1)::INT AS rank, unnest(kept) AS vec_id FROM f""")
def greedy_dedup(spark, sf_dir):
    return observe.deduplicated(observations(spark, sf_dir), ["label"], score.quality(), 7.0, 0.30)


@query(f"""WITH RECURSIVE {_RANKED}, st(label, r, kept, vec_id, duplicate_of) AS (SELECT label, r, [vec_id], vec_id, NULL::BIGINT FROM o WHERE r = 1 UNION ALL
SELECT label, r, CASE WHEN d IS NULL THEN list_append(kept, vec_id) ELSE kept END, vec_id, d FROM (
  SELECT s.label, o.r, s.kept, o.vec_id, (SELECT arg_min(k.vec_id, k.r) FROM o k WHERE k.label = s.label AND list_contains(s.kept, k.vec_id) AND abs(k.yaw - o.yaw) <= 12 AND {_CLOSE}) AS d
  FROM st s JOIN o ON o.label = s.label AND o.r = s.r + 1))
SELECT label, vec_id, duplicate_of, CASE WHEN duplicate_of IS NULL THEN 1e0 ELSE 5e-1 END AS penalty FROM st""")
def mark_duplicates(spark, sf_dir):
    return observe.marked_duplicates(observations(spark, sf_dir), ["label"], score.quality(), 12.0, 0.30)


_BAND = "CASE " + " ".join(f"WHEN yaw >= {lo} AND yaw < {hi} THEN {i}" for i, (_, lo, hi) in enumerate(score.POSE_BANDS)) + f" ELSE {len(score.POSE_BANDS)} END"
_NAMES = "[" + ", ".join(f"'{n}'" for n, _, _ in score.POSE_BANDS) + "]"


def _pick(i: int) -> str:
    """The pick after i others: of the views that none of them makes redundant, the best of the first band without a pick, else the best."""
    return f"""c{i} AS (SELECT q.*, q.band < 5 AND NOT EXISTS (SELECT 1 FROM p{i - 1} k WHERE k.label = q.label AND k.band = q.band) AS free FROM v q
  WHERE NOT EXISTS (SELECT 1 FROM p{i - 1} k WHERE k.label = q.label AND (k.vec_id = q.vec_id OR (abs(k.yaw - q.yaw) <= 10 AND list_inner_product(k.e, q.e) / (k.n * q.n) >= 3e-1)))),
r{i} AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN free THEN band ELSE 5 END, free AND frame, -evidence, vec_id) AS r FROM c{i}),
p{i} AS (SELECT label, pick, vec_id, why, yaw, e, n, band FROM p{i - 1} UNION ALL SELECT label, {i}, vec_id, CASE WHEN free THEN {_NAMES}[band + 1] ELSE 'fill' END, yaw, e, n, band FROM r{i} WHERE r = 1)"""


@query(f"""WITH {OBS}, {_FACTORS}, v AS (SELECT f.label, f.vec_id, f.yaw, f.e, sqrt(list_inner_product(f.e, f.e)) AS n, {_BAND} AS band, vec_id % 7 <> 0 AS frame,
  greatest(1e-3, b * least(greatest(1e0 - abs(exposure - 128) / 118, 5e-2), 1e0) * least(greatest(1e0 - (clipped_high + clipped_low) * 3, 1e-1), 1e0) * (25e-2 + 75e-2 * visible_fraction) * p) AS evidence FROM f),
r0 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY frame, band <> 0, -evidence, vec_id) AS r FROM v), p0 AS (SELECT label, 0 AS pick, vec_id, 'anchor' AS why, yaw, e, n, band FROM r0 WHERE r = 1),
{", ".join(_pick(i) for i in range(1, 5))} SELECT label, pick::INT AS pick, vec_id, why FROM p4""")
def acquire_references(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("is_photo", F.col("vec_id") % 7 == 0)
    return observe.acquire(rows, "label", score.quality("evidence"), similarity=0.30)


@query(f"""WITH {OBS}, l AS (SELECT label, vec_id, list_inner_product(e, lag(e) OVER (PARTITION BY label ORDER BY vec_id)) AS s FROM obs)
SELECT label, count(*) FILTER (WHERE round(s, 6) < 5e-2) AS switches FROM l GROUP BY label""")
def switch_count(spark, sf_dir):
    rows = observations(spark, sf_dir)
    before = F.lag("embedding").over(sequence.over(["label"], ["vec_id"]))
    return sequence.switches(rows, ["label"], ["vec_id"], F.round(vec.dot("embedding", before), 6), 0.05)


@query(f"""WITH {AGREE} SELECT label, round(avg(agree) FILTER (WHERE abs(yaw) < 8), 5) AS frontal, round(avg(agree) FILTER (WHERE abs(yaw) >= 8 AND abs(yaw) < 20), 5) AS turned,
round(avg(agree) FILTER (WHERE abs(yaw) >= 20), 5) AS profile FROM a GROUP BY label""")
def pose_pivot(spark, sf_dir):
    from weftline.operators import report

    rows = observe.consensus(observations(spark, sf_dir), ["label"], score.quality())
    return report.pose_pivot(rows, "label", "yaw", "consensus").select("label", *(F.round(c, 5).alias(c) for c in ("frontal", "turned", "profile")))


@query(f"""WITH {AGREE}, j AS (SELECT agree AS v, (vec_id % 10) = label AS same FROM a)
SELECT round(avg(v) FILTER (WHERE same), 6) AS same_mean, round(min(v) FILTER (WHERE same), 6) AS same_min, round(avg(v) FILTER (WHERE NOT same), 6) AS other_mean, round(max(v) FILTER (WHERE NOT same), 6) AS other_max,
round((avg(v) FILTER (WHERE same) + avg(v) FILTER (WHERE NOT same)) / 2, 6) AS threshold,
round((avg(v) FILTER (WHERE same) - avg(v) FILTER (WHERE NOT same)) / sqrt(greatest((var_pop(v) FILTER (WHERE same) + var_pop(v) FILTER (WHERE NOT same)) / 2, 1e-12)), 5) AS d_prime,
min(v) FILTER (WHERE same) > max(v) FILTER (WHERE NOT same) AS clean_split FROM j""")
def calibration_dprime(spark, sf_dir):
    rows = observe.consensus(observations(spark, sf_dir), ["label"], score.quality())
    out = select.calibration(rows, "consensus", F.col("vec_id") % 10 == F.col("label"))
    return out.select(*(F.round(c, 5 if c == "d_prime" else 6).alias(c) if t == "double" else c for c, t in out.dtypes))


_REACH = "CASE " + " ".join(f"WHEN yaw >= {lo} AND yaw < {hi} THEN '{n}'" for n, lo, hi in score.REACH_BINS) + " END"


@query(f"""WITH {OBS}, b(bin) AS (VALUES {", ".join(f"('{n}')" for n, _, _ in score.REACH_BINS)}), l AS (SELECT DISTINCT label FROM obs)
SELECT l.label, b.bin, count(o.vec_id) AS n FROM l CROSS JOIN b LEFT JOIN (SELECT vec_id, label, {_REACH} AS bin FROM obs) o ON o.label = l.label AND o.bin = b.bin GROUP BY ALL""")
def pose_reach(spark, sf_dir):
    return observe.coverage(observations(spark, sf_dir), ["label"], score.REACH_BINS)


@query(f"""WITH {OBS}, p AS (SELECT *, greatest(1e-3, least(1e0, face_px / 160) * least(greatest(detector_conf, 0e0), 1e0) * least(1e0, sharpness / 120)) AS b FROM q),
t AS (SELECT label, t.target, e, b, exp(-pow(yaw - t.target, 2) / (2e0 * 18e0 * 18e0)) * b AS w FROM p, (VALUES (-60e0), (-30e0), (0e0), (30e0), (60e0)) t(target)),
s AS (SELECT label, target, generate_subscripts(e, 1) AS dim, unnest(e) AS x, b, w FROM t),
v AS (SELECT label, target, dim, CASE WHEN sum(w) < 1e-8 THEN sum(x * b) / sum(b) ELSE sum(x * w) / sum(w) END AS m, sum(x * b) / greatest(sum(b), 1e-6) AS a FROM s GROUP BY ALL),
u AS (SELECT label, target, dim, 55e-2 * a / sqrt(sum(a * a) OVER g) + (1e0 - 55e-2) * m / sqrt(sum(m * m) OVER g) AS x FROM v WINDOW g AS (PARTITION BY label, target))
SELECT label, target, (dim - 1)::INT AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label, target)), 6) AS value FROM u""")
def anchored_vector(spark, sf_dir):
    rows = observe.anchored(observations(spark, sf_dir), ["label"], [-60.0, -30.0, 0.0, 30.0, 60.0])
    return rows.select("label", "target", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round("value", 6))


#: Labels from 5 on have no photos.
@query(f"""WITH {OBS}, m AS (SELECT *, label < 5 AND vec_id % 7 = 0 AS photo FROM q), h AS (SELECT label, bool_or(photo) AS has FROM m GROUP BY label),
s AS (SELECT m.label, generate_subscripts(e, 1) AS dim, unnest(e) AS x, quality FROM m JOIN h USING (label) WHERE photo OR NOT has), c AS (SELECT label, dim, sum(x * quality) / greatest(sum(quality), 1e-6) AS v FROM s GROUP BY ALL),
centre AS (SELECT label, list(v ORDER BY dim) AS c FROM c GROUP BY label),
a AS (SELECT m.label, vec_id, has, list_inner_product(e, c) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(c, c))) AS s FROM m JOIN h USING (label) JOIN centre USING (label) WHERE NOT photo)
SELECT label, vec_id, CASE WHEN has THEN 'photos' ELSE 'own' END AS anchor, round(s, 6) AS consensus, s >= 5e-2 AS kept FROM a""")
def same_person_two_passes(spark, sf_dir):
    rows = observe.same_person(observations(spark, sf_dir), ["label"], (F.col("label") < 5) & (F.col("vec_id") % 7 == 0), score.quality(), 0.05)
    return rows.withColumn("consensus", F.round("consensus", 6))
