"""Queries on frame metrics: aggregates, scores, choice and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import score
from weftline.operators import report, select, sequence
from weftline.plans.registry import query
from weftline.plans.stand_ins import FM, frame_metrics, series, table

_MEANS = ", ".join(f"round(avg({c}) FILTER (WHERE error IS NULL), 5) AS {n}" for c, n in select.MEANS.items())
_AGG = FM + f""",
g AS (SELECT candidate, {_MEANS}, round(min(identity) FILTER (WHERE error IS NULL), 5) AS identity_min,
  count(*) FILTER (WHERE error IS NULL AND identity_stability < 81e-2) AS identity_switches, count(*) FILTER (WHERE error IS NULL) AS frames_measured,
  count(*) FILTER (WHERE error IS NOT NULL) AS frames_failed FROM fm GROUP BY candidate)"""


def _norm_sql(metric: str, lo: float, hi: float, low_is_good: bool) -> str:
    x = f"least(greatest(({metric} - {lo!r}::DOUBLE) / {max(hi - lo, 1e-6)!r}::DOUBLE, 0e0), 1e0)"
    return f"(CASE WHEN {metric} IS NULL THEN 0e0 ELSE {'1e0 - ' + x if low_is_good else x} END)"


def _score_sql() -> str:
    parts: dict[str, list[str]] = {"identity_switches": ["(CASE WHEN coalesce(identity_switches, 0) = 0 THEN 1e0 ELSE 0e0 END)"]}
    for term, metric, lo, hi, low, share in score.TERMS:
        parts.setdefault(term, []).append(f"{_norm_sql(metric, lo, hi, low)} * {share!r}::DOUBLE")
    return ", ".join(f"round(({' + '.join(parts[t])}) * {w!r}::DOUBLE, 5) AS part_{t}" for t, w in score.WEIGHTS.items())


_SCORED = _AGG + f", p AS (SELECT *, {_score_sql()} FROM g), sc AS (SELECT *, round({' + '.join('part_' + t for t in score.WEIGHTS)}, 5) AS score FROM p)"
_GUARD = _SCORED + """, bare AS (SELECT identity_mean AS bare_identity FROM sc WHERE candidate LIKE 'A%' OR candidate LIKE 'N%' ORDER BY score DESC, candidate LIMIT 1),
gd AS (SELECT sc.*, bare_identity, (candidate LIKE 'A%' OR candidate LIKE 'N%') OR coalesce(bare_identity - identity_mean <= 4e-2, true) AS eligible FROM sc LEFT JOIN bare ON true)"""


def _aggregates(spark, sf_dir):
    return select.aggregate(frame_metrics(spark, sf_dir), switch_below=0.81)


def _guarded(spark, sf_dir):
    bare = F.col("candidate").startswith("A") | F.col("candidate").startswith("N")
    return select.guarded(select.scored(_aggregates(spark, sf_dir)), bare)


_ODD = """v AS (SELECT l_returnflag || l_linestatus AS candidate, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_quantity = 49 THEN 'NaN'::DOUBLE WHEN l_quantity = 48 THEN 'Infinity'::DOUBLE ELSE 3e-1 + (l_partkey % 65) / 100 END AS x FROM lineitem),
w AS (SELECT candidate, CASE WHEN isfinite(x) THEN x END AS x FROM v)"""


@query(f"WITH {_ODD} SELECT candidate, round(avg(x), 5) AS identity_mean, round(min(x), 5) AS identity_min, round(max(x), 5) AS identity_max, round(stddev_pop(x), 5) AS identity_std, count(x) AS identity_n FROM w GROUP BY candidate")
def summarise(spark, sf_dir):
    qty = F.col("l_quantity")
    value = F.when(F.col("l_linenumber") == 7, None).when(qty == 49, float("nan")).when(qty == 48, float("inf")).otherwise(0.3 + (F.col("l_partkey") % 65) / 100)
    return table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("candidate")).agg(*select.summary(value, "identity"))


@query(f"WITH {_AGG} SELECT * FROM g")
def candidate_aggregate(spark, sf_dir):
    return _aggregates(spark, sf_dir)


@query(f"WITH {_SCORED} SELECT candidate, {', '.join('part_' + t for t in score.WEIGHTS)}, score FROM sc")
def composite_score(spark, sf_dir):
    return select.scored(_aggregates(spark, sf_dir)).select("candidate", *(f"part_{t}" for t in score.WEIGHTS), "score")


@query(f"WITH {_GUARD} SELECT candidate, score, identity_mean, bare_identity, eligible FROM gd")
def identity_guard(spark, sf_dir):
    return _guarded(spark, sf_dir).select("candidate", "score", "identity_mean", "bare_identity", "eligible")


@query(f"WITH {_GUARD} SELECT candidate, score, eligible FROM gd WHERE score >= 0 ORDER BY eligible DESC, score DESC, candidate LIMIT 1")
def winner(spark, sf_dir):
    return select.winner(_guarded(spark, sf_dir)).select("candidate", "score", "eligible")


@query(f"""WITH {_SCORED}, v AS (SELECT candidate, substr(candidate, 1, 1) AS swapper, CASE WHEN candidate LIKE '%O' THEN 'enhancer' WHEN candidate LIKE 'R%' THEN 'mask' END AS variant, score FROM sc),
lead AS (SELECT swapper AS lead FROM v WHERE variant IS NULL ORDER BY score DESC, candidate LIMIT 1),
two AS (SELECT v.*, CASE WHEN variant IS NULL THEN 1 WHEN variant = 'enhancer' AND swapper = lead THEN 2 END AS stage FROM v, lead),
leader AS (SELECT swapper AS leader FROM two WHERE stage IS NOT NULL ORDER BY score DESC, candidate LIMIT 1)
SELECT candidate, swapper, variant, score, coalesce(stage, CASE WHEN variant = 'mask' AND swapper = leader THEN 3 END)::INT AS stage FROM two, leader""")
def staged_selection(spark, sf_dir):
    variant = F.when(F.col("candidate").endswith("O"), "enhancer").when(F.col("candidate").startswith("R"), "mask")
    rows = select.scored(_aggregates(spark, sf_dir)).select("candidate", F.substring("candidate", 1, 1).alias("swapper"), variant.alias("variant"), "score")
    return select.staged(rows).select("candidate", "swapper", "variant", "score", "stage")


_PICKS = " UNION ALL ".join(f"(SELECT frame, {i} AS reason FROM fm ORDER BY {t} {'DESC' if most else 'ASC'}, frame LIMIT 2)" for i, (t, most) in enumerate(select.TRAITS))


@query(f"""WITH {FM}, h AS ({_PICKS} UNION ALL (SELECT frame, 7 AS reason FROM fm ORDER BY frame LIMIT 28)), m AS (SELECT frame, min(reason)::INT AS reason FROM h GROUP BY frame)
SELECT frame, reason FROM m ORDER BY reason = 7, frame LIMIT 14""")
def stratified_sample(spark, sf_dir):
    return select.stratified_sample(frame_metrics(spark, sf_dir))


@query(f"""WITH {FM}, r AS (SELECT candidate, frame, identity, row_number() OVER (PARTITION BY candidate ORDER BY identity NULLS LAST, frame) AS r FROM fm) SELECT candidate, frame, round(identity, 5) AS identity FROM r WHERE r <= 15""")
def worst_frames(spark, sf_dir):
    order = Window.partitionBy("candidate").orderBy(F.asc_nulls_last("identity"), "frame")
    ranked = frame_metrics(spark, sf_dir).withColumn("r", F.row_number().over(order))
    return ranked.where("r <= 15").select("candidate", "frame", F.round("identity", 5).alias("identity"))


_P = ", ".join(f"round(quantile_cont(value, {q!r}), 4) AS p{round(100 * q)}" for q in report.PERCENTILES)


@query(f"SELECT event_type, {_P} FROM events GROUP BY event_type")
def percentile_profile(spark, sf_dir):
    rows = report.percentiles(table(spark, sf_dir, "events"), ["event_type"], "value")
    return rows.select("event_type", *(F.round(c, 4).alias(c) for c in rows.columns[1:]))


@query(f"""WITH {FM}, s AS (SELECT category, identity - 25e-2 AS sim FROM fm), n AS (SELECT category, count(*) FILTER (WHERE sim >= 15e-2) AS counted, count(*) FILTER (WHERE sim < 15e-2) AS left_out FROM s GROUP BY category),
p AS (SELECT category, {_P.replace("(value,", "(sim,")} FROM s WHERE sim >= 15e-2 GROUP BY category) SELECT * FROM n LEFT JOIN p USING (category)""")
def identity_profile(spark, sf_dir):
    rows = frame_metrics(spark, sf_dir).select("category", (F.col("identity") - 0.25).alias("sim"))
    out = report.identity_profile(rows, ["category"], "sim")
    return out.select(*(F.round(c, 4).alias(c) if t == "double" else c for c, t in out.dtypes))


_CONDITIONS = ["blur", "face_size", "brightness", "yaw", "ms"]
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS condition, identity AS o, {c} AS v FROM fm WHERE identity IS NOT NULL" for c in _CONDITIONS)


@query(f"""WITH {FM}, l AS ({_LONG}), s AS (SELECT condition, round(avg(v) FILTER (WHERE o < 45e-2), 5) AS bad_mean, round(avg(v) FILTER (WHERE o >= 45e-2), 5) AS good_mean,
round(CASE WHEN count(*) > 3 AND stddev_pop(v) > 1e-9 AND stddev_pop(o) > 1e-9 THEN corr(v, o) ELSE 0 END, 6) AS corr FROM l GROUP BY condition)
SELECT *, row_number() OVER (ORDER BY abs(corr) DESC, condition)::INT AS rank FROM s""")
def condition_correlation(spark, sf_dir):
    rows = report.condition_correlation(frame_metrics(spark, sf_dir), "identity", _CONDITIONS, F.col("identity") < 0.45)
    return rows.withColumn("bad_mean", F.round("bad_mean", 5)).withColumn("good_mean", F.round("good_mean", 5))


@query(f"WITH {FM} SELECT category, count(*) FILTER (WHERE identity < 45e-2) AS failed, count(*) AS n, round(count(*) FILTER (WHERE identity < 45e-2) / count(*), 6) AS rate FROM fm GROUP BY category")
def failure_rate(spark, sf_dir):
    return report.failure_rate(frame_metrics(spark, sf_dir), ["category"], F.col("identity") < 0.45).withColumn("rate", F.round("rate", 6))


@query(f"WITH {FM} SELECT candidate, category, round(avg(identity), 5) AS mean, round(min(identity), 5) AS worst, count(identity) AS n FROM fm GROUP BY GROUPING SETS ((candidate, category), (candidate))")
def tournament_grouping_sets(spark, sf_dir):
    rows = report.tournament(frame_metrics(spark, sf_dir), "candidate", "category", "identity")
    return rows.withColumn("mean", F.round("mean", 5)).withColumn("worst", F.round("worst", 5))


@query("""WITH p AS (SELECT event_type AS stage, event_type = 'error' AS nested, sum(value) AS total, count(*) AS calls FROM events GROUP BY ALL), w AS (SELECT sum(total) AS wall FROM p WHERE NOT nested)
SELECT stage, round(total, 4) AS total, calls, CASE WHEN NOT nested THEN round(total / wall, 6) END AS share FROM p, w""")
def stage_breakdown(spark, sf_dir):
    rows = report.stage_breakdown(table(spark, sf_dir, "events").withColumnRenamed("event_type", "stage"), "stage", F.col("value"), F.col("stage") == "error")
    return rows.select("stage", F.round("total", 4).alias("total"), "calls", F.round("share", 6).alias("share"))


_METRICS = {"identity_mean": True, "seam_mean": False, "sharpness_mean": True, "mask_jitter_mean": False, "ms_per_frame": False, "frames_failed": False, "identity_min": True}
_CELLS = " UNION ALL ".join(f"SELECT candidate, '{m}' AS metric, round({'' if up else '-'}{m}::DOUBLE, 6) AS v FROM g" for m, up in _METRICS.items())


@query(f"""WITH {_AGG}, c AS ({_CELLS}), t AS (SELECT metric, max(v) AS top FROM c GROUP BY metric HAVING count(v) = (SELECT count(*) FROM g)),
b AS (SELECT candidate, metric FROM c JOIN t USING (metric) WHERE v = top), n AS (SELECT metric, count(*) AS n FROM b GROUP BY metric)
SELECT g.candidate, count(*) FILTER (WHERE n.n = 1) AS wins, count(*) FILTER (WHERE n.n > 1) AS ties FROM g LEFT JOIN b USING (candidate) LEFT JOIN n USING (metric) GROUP BY g.candidate""")
def win_tally(spark, sf_dir):
    rows = _aggregates(spark, sf_dir).withColumn("frames_failed", F.col("frames_failed").cast("double"))
    return report.win_tally(rows, _METRICS)


@query("""WITH j AS (SELECT l_orderkey, l_linenumber, abs(l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey)) AS jump FROM lineitem),
s AS (SELECT avg(jump) FILTER (WHERE l_linenumber = 1) AS bm, max(jump) FILTER (WHERE l_linenumber = 1) AS bx, avg(jump) FILTER (WHERE l_linenumber <> 1) AS em, max(jump) FILTER (WHERE l_linenumber <> 1) AS ex, quantile_cont(jump, 0.99) FILTER (WHERE l_linenumber <> 1) AS p FROM j)
SELECT round(bm, 3) AS boundary_mean, round(bx, 3) AS boundary_max, round(em, 3) AS elsewhere_mean, round(ex, 3) AS elsewhere_max, round(p, 3) AS elsewhere_p99, bx <= p AS seamless FROM s""")
def boundary_vs_elsewhere(spark, sf_dir):
    rows = sequence.deltas(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], "l_extendedprice")
    out = report.boundary_jump(rows, "delta", F.col("l_linenumber") == 1)
    return out.select(*(F.round(c, 3).alias(c) for c in out.columns[:-1]), "seamless")


@query(f"""WITH {FM}, m AS (SELECT candidate, avg(identity) AS mean FROM fm GROUP BY candidate), e AS (SELECT min(mean) FILTER (WHERE candidate = 'NO') AS low, min(mean) FILTER (WHERE candidate = 'RF') AS high FROM m)
SELECT candidate, round(mean, 5) AS mean, round(mean - low, 5) + 0e0 AS delta, CASE WHEN abs(high - low) > 1e-9 THEN round((mean - low) / (high - low) * 100, 2) + 0e0 END AS recovered_pct FROM m, e WHERE low IS NOT NULL AND high IS NOT NULL""")
def delta_vs_control(spark, sf_dir):
    rows = report.against_control(frame_metrics(spark, sf_dir), "candidate", "identity", "NO", "RF")
    return rows.select("candidate", F.round("mean", 5).alias("mean"), F.round("delta", 5).alias("delta"), F.round("recovered_pct", 2).alias("recovered_pct"))


@query(f"""WITH {FM}, p AS (SELECT candidate, category, avg((identity >= 5e-1)::INT::DOUBLE) AS recall, count(*) FILTER (WHERE identity >= 5e-1) AS hits, count(*) AS n FROM fm WHERE identity IS NOT NULL GROUP BY ALL)
SELECT candidate, round(avg(recall), 6) AS clip_mean, round(sum(hits) / sum(n), 6) AS pooled, count(*) AS clips FROM p GROUP BY candidate""")
def detector_recall(spark, sf_dir):
    rows = report.recall_by_clip(frame_metrics(spark, sf_dir).where("identity is not null"), "candidate", "category", F.col("identity") >= 0.5)
    return rows.select("candidate", F.round("clip_mean", 6).alias("clip_mean"), F.round("pooled", 6).alias("pooled"), "clips")


@query("""WITH d AS (SELECT vec_id, 1e-2 + (vec_id * 7) % 40 / 1000 AS o, 1e-2 + (vec_id * 11) % 40 / 1000 AS n FROM embeddings)
SELECT count(*) FILTER (WHERE n < o * 85e-2) AS better, count(*) FILTER (WHERE n > o * 115e-2) AS worse, count(*) FILTER (WHERE n >= o * 85e-2 AND n <= o * 115e-2) AS equivalent,
round(avg(o), 6) AS old_mean, round(avg(n), 6) AS new_mean, round(max(o), 6) AS old_worst, round(max(n), 6) AS new_worst FROM d""")
def drift_summary(spark, sf_dir):
    i = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select((0.01 + (i * 7) % 40 / 1000).alias("o"), (0.01 + (i * 11) % 40 / 1000).alias("n"))
    out = report.drift_verdicts(rows, "o", "n")
    return out.select("better", "worse", "equivalent", *(F.round(c, 6).alias(c) for c in out.columns[3:]))


@query("""SELECT p_brand AS category, CASE WHEN min(o.ok) IS NULL THEN 'MISSING' WHEN min(o.ok) = 1 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT DISTINCT p_brand FROM part) p LEFT JOIN (SELECT p_brand AS b, (l_quantity < 50)::INT AS ok FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 5 = 0) o ON b = p_brand GROUP BY p_brand""")
def acceptance_matrix(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "category")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_quantity") < 50).alias("passed"))
    return report.matrix_status(part, lines.join(part.where("p_size % 5 = 0"), lines.l_partkey == part.p_partkey), "category", "passed")


@query("""SELECT round(max(value), 4) AS value_peak, round(avg(value), 4) AS value_mean, round(max(value) - avg(value) FILTER (WHERE event_type = 'view'), 4) AS value_attributable FROM events""")
def resource_usage(spark, sf_dir):
    out = report.resources(table(spark, sf_dir, "events"), ["value"], F.col("event_type") == "view")
    return out.select(*(F.round(c, 4).alias(c) for c in out.columns))


@query("""WITH s AS (SELECT l_suppkey AS region, sum(l_quantity) AS m, sum(l_quantity * l_discount) AS mx, sum(l_quantity * l_discount * l_discount) AS mxx FROM lineitem GROUP BY l_suppkey)
SELECT region, CASE WHEN m >= 16 THEN round(mx / m, 6) END AS mean, CASE WHEN m >= 16 THEN round(sqrt(greatest(mxx / m - (mx / m) * (mx / m), 0)), 6) END AS std FROM s""")
def masked_colour_stats(spark, sf_dir):
    rows = report.weighted_stats(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "region"), ["region"], "l_discount", "l_quantity")
    return rows.select("region", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_REGIONS = list(report.REGION_IMPORTANCE.items())
_VIS = ", ".join(f"('{r}', {w!r}::DOUBLE, {i})" for i, (r, w) in enumerate(_REGIONS))


@query(f"""WITH r(region, w, i) AS (VALUES {_VIS}), o AS (SELECT vec_id, (vec_id * 37) % 161 - 80 AS yaw FROM embeddings),
v AS (SELECT vec_id, region, w, ((vec_id * (i + 3)) % 101) / 100 AS v FROM o, r WHERE NOT (yaw > 22 AND region IN ('left_cheek', 'left_eye')) AND NOT (yaw < -22 AND region IN ('right_cheek', 'right_eye')))
SELECT vec_id, round(sum(w * v) / sum(w), 6) AS visible, coalesce(string_agg(region, ',' ORDER BY region) FILTER (WHERE v < 45e-2), '') AS occluded FROM v GROUP BY vec_id""")
def visible_fraction(spark, sf_dir):
    i = F.col("vec_id")
    cells = [x for k, (r, _) in enumerate(_REGIONS) for x in (F.lit(r), ((i * (k + 3)) % 101) / 100)]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", ((i * 37) % 161 - 80).cast("double").alias("yaw"), F.create_map(*cells).alias("visibility"))
    out = report.visible_fraction(rows, "visibility", "yaw")
    return out.select("vec_id", F.round("visible", 6).alias("visible"), F.array_join("occluded", ",").alias("occluded"))


@query("""WITH s AS (SELECT l_orderkey AS job, l_quantity::BIGINT AS frames, l_partkey % 5 AS cuts, l_discount AS jitter FROM lineitem)
SELECT job, sum(frames)::BIGINT AS frames, sum(cuts)::BIGINT AS cuts, round(sum(jitter * frames) / sum(frames), 9) AS jitter FROM s GROUP BY job""")
def segment_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_quantity").cast("long").alias("frames"), (F.col("l_partkey") % 5).alias("cuts"), F.col("l_discount").alias("jitter"))
    return report.rolled_up(rows, ["job"], ["cuts"], ["jitter"], "frames").withColumn("jitter", F.round("jitter", 9))


@query("""WITH l AS (SELECT user_id AS clip, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d, value FROM events)
SELECT clip, round(avg(d), 5) AS jitter, round(quantile_cont(value, 0.05), 5) AS p5, count(d) AS n FROM l GROUP BY clip""")
def region_jitter(spark, sf_dir):
    rows = sequence.deltas(series(spark, sf_dir), ["clip"], ["ts", "event_id"], "value")
    return rows.groupBy("clip").agg(F.round(F.avg("delta"), 5).alias("jitter"), F.round(F.percentile("value", F.lit(0.05)), 5).alias("p5"), F.count("delta").alias("n"))


@query("""WITH p AS (SELECT event_type AS stage, event_type = 'error' AS nested, sum(value) AS total, count(*) AS calls FROM events GROUP BY ALL), w AS (SELECT 15e-1 * sum(value) AS wall, count(*) AS frames FROM events),
r AS (SELECT stage, total, calls FROM p UNION ALL SELECT 'unattributed', max(wall) - (SELECT sum(total) FROM p WHERE NOT nested), 0 FROM w)
SELECT stage, round(total, 3) AS total, calls, round(total * 1000 / frames, 2) AS ms_per_frame, round(total * 100 / wall, 1) AS pct_wall FROM r, w""")
def stage_attribution(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stages = events.groupBy(F.col("event_type").alias("stage"), (F.col("event_type") == "error").alias("nested")).agg(F.sum("value").alias("total"), F.count("*").alias("calls"))
    return report.attributed(stages, events.agg((1.5 * F.sum("value")).alias("wall"), F.count("*").alias("frames")))


_PAIR = {"identity": True, "seam": False, "texture_retention": True, "mask_jitter": False, "flow_flicker": False}
_PAIRS = " UNION ALL ".join(f"SELECT a.category, '{m}' AS metric, a.{m} AS a, b.{m} AS b, {str(up).upper()} AS up FROM g a JOIN g b ON a.category = b.category AND a.candidate = 'NO' AND b.candidate = 'RF'" for m, up in _PAIR.items())
_PAIRED = f"""g AS (SELECT candidate, category, {", ".join(f"round(avg({m}), 4) AS {m}" for m in _PAIR)} FROM fm WHERE error IS NULL GROUP BY ALL),
p AS (SELECT category, metric, a, b, CASE WHEN abs(a - b) < 1e-9 THEN 'tie' WHEN (b > a) = up THEN 'RF' ELSE 'NO' END AS win FROM ({_PAIRS}) WHERE a IS NOT NULL AND b IS NOT NULL)"""


def _paired(spark, sf_dir):
    rows = frame_metrics(spark, sf_dir).where("error is null").groupBy("candidate", "category").agg(*(F.round(F.avg(m), 4).alias(m) for m in _PAIR))
    return report.pairwise(rows, "category", "candidate", "NO", "RF", _PAIR)


@query(f"WITH {FM}, {_PAIRED} SELECT * FROM p")
def pairwise_wins(spark, sf_dir):
    return _paired(spark, sf_dir)


@query(f"WITH {FM}, {_PAIRED} SELECT count(*) FILTER (WHERE win = 'RF') AS better, count(*) FILTER (WHERE win = 'NO') AS worse, count(*) FILTER (WHERE win = 'tie') AS same, count(*) FILTER (WHERE win = 'NO') <= count(*) FILTER (WHERE win = 'RF') AS passed FROM p")
def pairwise_verdict(spark, sf_dir):
    return report.no_worse(_paired(spark, sf_dir), "NO", "RF")


@query("""WITH l AS (SELECT label, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b, CASE WHEN vec_id % 9 > 0 THEN abs(embedding[1]::DOUBLE - embedding[2]::DOUBLE) END AS d FROM embeddings)
SELECT label, round(avg(1 - list_inner_product(e, b) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(b, b)))), 6) AS identity_jitter, round(avg(d), 6) AS drift, count(*) AS n FROM l GROUP BY label""")
def identity_jitter(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").withColumn("d", F.when(F.col("vec_id") % 9 > 0, F.abs(e[0] - e[1])).otherwise(float("nan")))
    found = sequence.identity_jitter(rows, ["label"], ["vec_id"], "embedding", F.col("d"))
    return found.select("label", F.round("identity_jitter", 6).alias("identity_jitter"), F.round("drift", 6).alias("drift"), "n")
