"""Queries on renders: the library's columns, joined segments, and candidates that a stage makes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import score
from weftline.operators import control, ordinal, report, select
from weftline.plans.registry import query
from weftline.plans.stand_ins import DET, FM, detections, frame_metrics, table
from weftline.sources import files

#: A record an order, of a kind by its key: cut off, empty, without a result, of an old engine, with numbers as text, and whole.
_RECORD = """CASE o_orderkey % 7 WHEN 0 THEN '{"result": {' WHEN 1 THEN '{}' WHEN 2 THEN '{"quality": "fast", "engine": "v0", "result": null}'
WHEN 3 THEN '{"quality": "draft", "result": {"frames": ' || CAST(o_orderkey AS STRING) || ', "encoder": "x264"}}'
WHEN 4 THEN '{"face_mode": "all", "result": {"engine": "v2", "frames": "many", "config": {"swapper": "s' || CAST(o_orderkey % 5 AS STRING) || '", "enhancer": null, "color_match": "?"}, "tracking": []}}'
ELSE '{"quality": "quality", "face_mode": "reference", "result": {"engine": "v2", "mask_sources": ["model","' || o_orderstatus || '"], "frames": ' || CAST(o_custkey AS STRING) ||
', "encoder": "nvenc", "config": {"swapper": "s' || CAST(o_orderkey % 5 AS STRING) || '", "enhancer": "gpen", "enhancer_blend": 0.' || CAST(1 + o_custkey % 9 AS STRING) || ', "mask": "full", "color_match": ' || CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END ||
'}, "tracking": {"identity_switches": ' || CAST(o_custkey % 4 AS STRING) || '}, "benchmark_winner": "w", "benchmark_score": 0.5, "benchmark_candidates": 12, "timings": {"total_s": ' || CAST(o_orderkey % 100 AS STRING) || '.25}}}' END"""


def _paths() -> str:
    kinds = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "boolean": "BOOLEAN"}
    return ", ".join(f"TRY_CAST(j->>'{path}' AS {kinds[kind]}) AS {name}" for name, path, kind in control.LIBRARY)


@query(f"""WITH r AS (SELECT o_orderkey AS job, {_RECORD.replace("STRING", "VARCHAR")} AS record FROM orders), p AS (SELECT job, CASE WHEN json_valid(record) THEN record::JSON END AS j FROM r)
SELECT job, coalesce(j->>'$.result.engine', j->>'$.engine', 'v1') AS engine, CAST(j->'$.result.mask_sources' AS VARCHAR) AS mask_sources, {_paths()} FROM p""")
def library_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.expr(_RECORD).alias("record"))
    return control.library_columns(rows, "record").drop("record")


#: A segment an order; a part's number shifts some frames, so that segments overlap, leave gaps and repeat frames.
@query("""WITH f AS (SELECT l_orderkey AS segment, (l_linenumber - l_partkey % 23 // 22)::BIGINT AS frame, l_orderkey * 7 + l_linenumber - l_suppkey % 5 // 4 AS source FROM lineitem),
n AS (SELECT *, row_number() OVER (ORDER BY segment, frame, source) - 1 AS ordinal FROM f), l AS (SELECT *, lag(segment) OVER w AS s, lag(frame) OVER w AS p, lag(source) OVER w AS b FROM n WINDOW w AS (ORDER BY ordinal))
SELECT segment, frame, source, ordinal, CASE WHEN segment = s AND frame = p THEN 'repeat' WHEN source <= b THEN 'overlap' WHEN source > b + 1 THEN 'gap' END AS fault FROM l""")
def joined_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("segment"), F.expr("cast(l_linenumber - l_partkey % 23 div 22 AS bigint)").alias("frame"), F.expr("l_orderkey * 7 + l_linenumber - l_suppkey % 5 div 4").alias("s")
    )
    return ordinal.joined(rows, "segment", "frame", F.col("s"))


_CANDIDATES = """c AS (SELECT p_brand AS brand, p_partkey AS part, 'p' || p_partkey AS label, ['model', 'parsing', 'full'][(p_partkey % 3)::INT + 1] AS mask, p_size % 2 = 0 AS color_match, (p_partkey * 37 % 1000) / 1000 AS score FROM part),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY score DESC, label) AS r FROM c) WHERE r = 1)"""


@query(f"""WITH {_CANDIDATES}, o(k, name, m, off) AS (VALUES (0, 'mask:model', 'model', false), (1, 'mask:parsing', 'parsing', false), (2, 'mask:full', 'full', false), (3, 'no colour match', NULL, true)),
v AS (SELECT brand, part, label || ' / ' || name AS label, coalesce(m, mask) AS mask, CASE WHEN off THEN false ELSE color_match END AS color_match, score AS old, k FROM w JOIN o ON CASE WHEN off THEN color_match ELSE mask <> m END),
f AS (SELECT v.* FROM v ANTI JOIN (SELECT brand, label || ' / mask:full' AS label FROM c WHERE part % 4 = 0) d USING (brand, label)),
q AS (SELECT l_partkey AS part, l_linenumber % 4 AS k, avg(l_discount) * 10 AS score FROM lineitem GROUP BY ALL)
SELECT brand, label, mask, color_match, round(coalesce(q.score, -1e0), 6) AS score, q.score IS NULL AS failed, coalesce(q.score, -1e0) > old AS better FROM f LEFT JOIN q ON q.part = f.part AND q.k = f.k""")
def refined_candidates(spark, sf_dir):
    """The refining stage for each brand's best part: its candidates are in no table, their measures are of the part's lines."""
    part = table(spark, sf_dir, "part")
    masks = F.array(*map(F.lit, select.MASKS))
    rows = part.select(
        F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part"), F.concat(F.lit("p"), "p_partkey").alias("label"), masks[(F.col("p_partkey") % 3).cast("int")].alias("mask"),
        (F.col("p_size") % 2 == 0).alias("color_match"), ((F.col("p_partkey") * 37 % 1000) / 1000).alias("score"),
    )
    best = select.best_per(rows, ["brand"], F.desc("score"), F.asc("label"))
    done = rows.where("part % 4 = 0").select("brand", F.concat("label", F.lit(" / mask:full")).alias("label"))

    def measure(candidates: DataFrame) -> DataFrame:
        lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), (F.col("l_linenumber") % 4).alias("k")).agg((F.avg("l_discount") * 10).alias("score"))
        k = F.when(F.col("label").endswith("no colour match"), 3).otherwise(F.array_position(masks, F.col("mask")).cast("int") - 1)
        return candidates.withColumn("k", k).join(lines, ["part", "k"], "left").drop("k")

    found = select.refined(best, done, ["brand"], measure)
    return found.select("brand", "label", "mask", "color_match", F.round("score", 6).alias("score"), "failed", "better")


@query(f"""WITH {FM}, m AS (SELECT candidate, frame % 40 AS category, avg(identity) AS mean, count(identity) AS n FROM fm WHERE identity < 32e-2 GROUP BY ALL),
c AS (SELECT DISTINCT candidate FROM m), g AS (SELECT DISTINCT category FROM m)
SELECT candidate, category, round(mean, 6) AS mean, coalesce(n, 0) AS n, mean IS NULL AS missing FROM c CROSS JOIN g LEFT JOIN m USING (candidate, category)""")
def tournament_matrix(spark, sf_dir):
    rows = frame_metrics(spark, sf_dir).where("identity < 0.32").withColumn("category", F.col("frame") % 40)
    return report.matrix(rows, "candidate", "category", "identity").withColumn("mean", F.round("mean", 6))


@query("""WITH f AS (SELECT l_orderkey AS request, 'p' || l_linenumber || '-' || l_partkey AS name, l_linenumber AS place, l_quantity > 8 AS readable, l_tax > 1e-2 AS face FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY place, name, readable) AS r, bool_or(face) OVER (PARTITION BY request, name) AS seen FROM f)
SELECT request, name, CASE WHEN r > 5 THEN 'not read: more than 5 photos' WHEN NOT readable THEN 'unreadable or unsupported' WHEN NOT seen THEN 'no face found' END AS problem FROM r""")
def source_problems(spark, sf_dir):
    """A request an order, a photo a line."""
    name = F.concat(F.lit("p"), "l_linenumber", F.lit("-"), "l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), name.alias("name"), F.col("l_linenumber").alias("place"), (F.col("l_quantity") > 8).alias("readable"), "l_tax")
    return files.source_problems(rows, rows.where("l_tax > 0.01"), ["request"], "place")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN round(value, 2) WHEN event_id % 5 = 2 THEN 1e0 END AS at FROM events""")
def source_times(spark, sf_dir):
    i = F.col("event_id")
    name = F.concat(F.lit("clip"), F.when(i % 5 == 0, F.concat(F.lit("@"), F.round("value", 2).cast("string"))).when(i % 5 == 1, "@soon").when(i % 5 == 2, "@a@1").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", score.source_time(name).alias("at"))


@query("""WITH c AS (SELECT o_orderkey AS job, (o_orderkey % 60)::DOUBLE AS requested, o_custkey % 400 AS frames, (o_custkey % 31)::DOUBLE AS fps, (o_orderkey % 90)::DOUBLE AS last FROM orders)
SELECT job, CASE WHEN requested > 0 THEN round(CASE WHEN frames > 0 AND fps > 0 THEN greatest(requested, frames / fps) ELSE requested END + 5e-2, 6) END AS audio_seconds, CASE WHEN requested > 0 AND last <= requested THEN 'range is empty' END AS error FROM c""")
def audio_lengths(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    requested = (key % 60).cast("double")
    seconds = score.audio_seconds(requested, cust % 400, (cust % 31).cast("double"))
    return table(spark, sf_dir, "orders").select(key.alias("job"), seconds.alias("audio_seconds"), score.range_error(requested, (key % 90).cast("double")).alias("error"))


@query(f"""WITH {DET}, d AS (SELECT frame % 7 AS clip, frame, det, det // 1000000000 % 2 AS detector, x1, y1, x2, y2, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, score, (x2 - x1) * (y2 - y1) AS area FROM det),
ref AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY area DESC, det) AS r FROM d) WHERE r = 1),
f AS (SELECT * FROM d WHERE score > 3e-1),
e AS (SELECT f.clip, f.detector, f.frame, f.det, sqrt(pow(f.cx - r.cx, 2) + pow(f.cy - r.cy, 2)) AS away,
  (sqrt(pow(f.x1 - r.x1, 2) + pow(f.y1 - r.y1, 2)) + sqrt(pow(f.x2 - r.x2, 2) + pow(f.y1 - r.y1, 2)) + sqrt(pow(f.cx - r.cx, 2) + pow(f.cy - r.cy, 2))) / 3 AS err FROM f JOIN ref r USING (frame)),
p AS (SELECT clip, detector, frame, count(*) AS boxes, arg_min(err, (away, det)) AS err FROM e GROUP BY ALL),
t AS (SELECT clip, detector, frame, avg(score) * 40 AS ms FROM d GROUP BY ALL)
SELECT clip, detector::INT AS detector, count(*) AS frames, count(boxes) AS frames_with_face, coalesce(sum(boxes), 0)::BIGINT AS boxes_total, round(avg(err), 2) AS landmark_err_px, round(avg(ms), 1) AS ms, round(count(boxes) / count(*), 3) AS recall
FROM t LEFT JOIN p USING (clip, detector, frame) GROUP BY clip, detector""")
def detector_report(spark, sf_dir):
    """Two detectors, by line number; the face that is there is a frame's largest box."""
    box = F.col("box")
    middle = F.array((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)
    rows = detections(spark, sf_dir).select(
        (F.col("frame") % 7).alias("clip"), "frame", "det", F.expr("cast(det div 1000000000 % 2 AS int)").alias("detector"), "score", middle.alias("centre"),
        F.array(F.array(box[0], box[1]), F.array(box[2], box[1]), middle).alias("points"), ((box[2] - box[0]) * (box[3] - box[1])).alias("area"),
    )
    reference = select.best_per(rows, ["frame"], F.desc("area"), F.asc("det"))
    tries = rows.groupBy("clip", "detector", "frame").agg((F.avg("score") * 40).alias("ms"))
    return report.detector_rows(tries, rows.where("score > 0.3"), reference)


@query("""WITH w AS (SELECT p_partkey AS name, CASE WHEN p_size % 7 > 0 THEN p_size::BIGINT END AS size, CASE WHEN p_size % 5 > 0 THEN p_brand END AS digest FROM part),
f AS (SELECT l_partkey AS name, max(l_quantity)::BIGINT AS size, 'Brand#' || min(l_suppkey) % 60 AS digest FROM lineitem GROUP BY ALL)
SELECT w.name, w.size, w.digest, CASE WHEN f.name IS NULL THEN 'missing' WHEN f.size <> w.size THEN 'size is ' || f.size || ', not ' || w.size WHEN f.digest <> w.digest THEN 'digest differs' END AS error FROM w LEFT JOIN f USING (name)""")
def ensured_batch(spark, sf_dir):
    size = F.col("p_size")
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.when(size % 7 > 0, size.cast("long")).alias("size"), F.when(size % 5 > 0, F.col("p_brand")).alias("digest"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("name"))
    found = lines.agg(F.max("l_quantity").cast("long").alias("size"), F.concat(F.lit("Brand#"), F.min("l_suppkey") % 60).alias("digest"))
    return files.ensured(wanted, found, "name", "size", "digest")
