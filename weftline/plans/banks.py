"""Queries on presets, reference banks, raw detector tensors and restarts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import geo, score, vec
from weftline.operators import control, observe, report
from weftline.plans.registry import query
from weftline.plans.stand_ins import OBS, observations, table

_BINNED = lambda bins: "CASE " + " ".join(f"WHEN yaw >= {lo} AND yaw < {hi} THEN '{n}'" for n, lo, hi in bins) + " END"


@query("""WITH q AS (SELECT o_orderkey AS job, (['max', 'quality', 'balanced', 'fast', 'auto', 'other'])[o_orderkey % 6 + 1] AS quality, CASE WHEN o_custkey % 4 = 0 THEN 'ghost_1' END AS winner FROM orders),
e AS (SELECT *, quality = 'auto' AND winner IS NULL AS bad FROM q)
SELECT job, CASE WHEN bad THEN NULL ELSE coalesce(winner, CASE WHEN quality = 'fast' THEN 'hyperswap_1a_256' ELSE 'alphaface_256' END) END AS swapper, CASE WHEN NOT bad THEN 'model' END AS mask,
CASE WHEN NOT bad THEN quality <> 'fast' END AS color_match, CASE WHEN bad THEN 'auto needs the winner of a benchmark' END AS error FROM e""")
def preset_pipelines(spark, sf_dir):
    names = F.array(*map(F.lit, ("max", "quality", "balanced", "fast", "auto", "other")))
    winner = F.when(F.col("o_custkey") % 4 == 0, "ghost_1")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), score.preset(F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")), winner).alias("p"))
    return rows.select("job", "p.swapper", "p.mask", "p.color_match", "p.error")


@query(f"""WITH {OBS}, b AS (SELECT label, vec_id, {_BINNED(score.POSE_BINS)} AS bin, list_position([{", ".join(f"'{n}'" for n, _, _ in score.POSE_BINS)}], {_BINNED(score.POSE_BINS)}) AS spot FROM obs WHERE vec_id % 3 = 0),
s AS (SELECT label, count(*) FILTER (WHERE vec_id % 7 = 0) AS photos, count(*) FILTER (WHERE vec_id % 7 > 0 AND label % 2 = 0) AS refs, list_sort(list(DISTINCT spot) FILTER (WHERE spot <= 3)) AS ats FROM b GROUP BY label)
SELECT label, photos || ' photos analyzed' || CASE WHEN refs > 0 THEN ', ' || refs || ' video references selected' ELSE '' END || ' | coverage: ' ||
coalesce(nullif(array_to_string(list_transform(ats, lambda i: replace(([{", ".join(f"'{n}'" for n, _, _ in score.POSE_BINS)}])[i], '_', ' ')), ', '), ''), 'none') AS line FROM s""")
def bank_summary(spark, sf_dir):
    rows = observations(spark, sf_dir).where("vec_id % 3 = 0").withColumn("bin", score.binned("yaw"))
    names = F.array(*(F.lit(n) for n, _, _ in score.POSE_BINS[:3]))
    banks = rows.groupBy("label").agg(
        F.count(F.when(F.col("vec_id") % 7 == 0, 1)).alias("photos"), F.count(F.when((F.col("vec_id") % 7 > 0) & (F.col("label") % 2 == 0), 1)).alias("refs"), F.collect_set("bin").alias("bins")
    )
    return banks.select("label", score.summary_line(F.col("photos"), F.col("refs"), F.filter(names, lambda n: F.array_contains("bins", n))).alias("line"))


@query("""SELECT p_partkey AS crop, round(least(least(1, greatest(0, 1 - (p_size - 6) / 22)), greatest(least(1, greatest(0, p_partkey % 90 / 45)), 35e-2),
least(1, greatest(0, least(p_partkey % 256 - 18, 246 - p_partkey % 256) / 28))), 6) AS visible FROM part""")
def region_visibility(spark, sf_dir):
    key = F.col("p_partkey")
    value = score.visibility(F.col("p_size").cast("double"), (key % 90).cast("double"), (key % 256).cast("double"))
    return table(spark, sf_dir, "part").select(key.alias("crop"), F.round(value, 6).alias("visible"))


@query("SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id % 7 > 0, vec_id)::INT AS place FROM embeddings")
def reference_list(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    both = observe.in_order(rows.where("vec_id % 7 = 0"), rows.where("vec_id % 7 > 0"), ["vec_id"])
    return both.select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy("place")).alias("place"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, (['raw', 'unit', 'converted'])[vec_id % 3 + 1] AS kind FROM embeddings)
SELECT vec_id, kind, round(CASE kind WHEN 'raw' THEN list_inner_product(e, e) WHEN 'unit' THEN 1e0 END, 6) AS power FROM e""")
def shaped_embeddings(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("raw"), F.lit("unit"), F.lit("converted")), (F.col("vec_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", kind.alias("kind"), F.col("embedding").cast("array<double>").alias("e"))
    shaped = rows.withColumn("s", vec.shaped("e", "kind"))
    return shaped.select("vec_id", "kind", F.round(vec.dot("s", "s"), 6).alias("power"))


@query("""WITH p AS (SELECT l_orderkey AS job, l_linenumber AS idx, 'f' || l_orderkey % 3 AS fp, l_quantity::BIGINT AS frames, l_suppkey % 5 AS bytes, l_suppkey % 5 + (l_partkey % 4 = 0)::INT AS size, l_partkey % 6 = 0 AS stale FROM lineitem),
u AS (SELECT job, idx, min(fp) AS fp, min(frames) AS frames, min(bytes) AS bytes, min(size) AS size, bool_or(stale) AS stale FROM p GROUP BY ALL), d AS (SELECT *, bytes > 0 AND size = bytes AND NOT stale AS done FROM u)
SELECT job, count(*) FILTER (WHERE done) AS segments_done, coalesce(sum(frames) FILTER (WHERE done), 0)::BIGINT AS frames_done, count(*) FILTER (WHERE NOT done) AS segments_left FROM d GROUP BY job""")
def restart_points(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("idx")).agg(
        F.min(F.col("l_quantity").cast("long")).alias("frames"), F.min(F.col("l_suppkey") % 5).alias("bytes"),
        F.min(F.col("l_suppkey") % 5 + F.when(F.col("l_partkey") % 4 == 0, 1).otherwise(0)).alias("size"), F.bool_or(F.col("l_partkey") % 6 == 0).alias("stale"),
    ).withColumn("fp", F.concat(F.lit("f"), F.col("job") % 3))
    manifest = rows.select("job", "idx", F.when(F.col("stale"), "old").otherwise(F.col("fp")).alias("fp"), "bytes", "frames")
    files = rows.select("job", "idx", F.col("size").alias("bytes"))
    return control.restart(rows.select("job", "idx", "fp"), manifest, ["job", "idx"], files, "job", "fp")


@query("""WITH a AS (SELECT p_partkey AS anchor, (p_partkey // 2) % 40 * 16e0 AS cx, (p_partkey // 2) // 40 * 16e0 AS cy, p_size AS s FROM part)
SELECT anchor, cx - s AS x1, cy - s * 2 AS y1, cx + s * 3 AS x2, cy + s * 4 AS y2, cx + s AS px, cy - s AS py FROM a""")
def decoded_anchors(spark, sf_dir):
    s = F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select("p_partkey", geo.anchor_centre(F.col("p_partkey"), 40, 16, 2).alias("c"), F.array(s, s * 2, s * 3, s * 4).alias("d"), F.array(s, -s).alias("o"))
    rows = rows.select("p_partkey", geo.decoded_box(F.col("c"), "d").alias("box"), geo.decoded_points(F.col("c"), "o")[0].alias("p"))
    return rows.select(F.col("p_partkey").alias("anchor"), *(F.col("box")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query("""WITH m AS (SELECT p_partkey AS patch, 5e-1 + p_size / 100 AS a, (p_size % 7 - 3) / 100 AS b, (p_partkey % 1500 - 200)::DOUBLE AS tx, (p_partkey % 900 - 150)::DOUBLE AS ty FROM part),
c AS (SELECT patch, unnest([tx, a * 128 + tx, a * 128 - b * 128 + tx, -b * 128 + tx]) AS x, unnest([ty, b * 128 + ty, b * 128 + a * 128 + ty, a * 128 + ty]) AS y FROM m),
r AS (SELECT patch, greatest(0, floor(min(x)) - 1)::INT AS x0, greatest(0, floor(min(y)) - 1)::INT AS y0, least(1280, ceil(max(x)) + 1)::INT AS x1, least(720, ceil(max(y)) + 1)::INT AS y1 FROM c GROUP BY patch)
SELECT * FROM r WHERE x1 > x0 AND y1 > y0""")
def roi_bounds(spark, sf_dir):
    a, b, key = 0.5 + F.col("p_size") / 100, (F.col("p_size") % 7 - 3) / 100, F.col("p_partkey")
    affine = F.array(a, -b, (key % 1500 - 200).cast("double"), b, a, (key % 900 - 150).cast("double"))
    corners = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (128.0, 0.0), (128.0, 128.0), (0.0, 128.0))))
    rows = table(spark, sf_dir, "part").select(key.alias("patch"), geo.region_of_interest(geo.mapped(corners, affine), 1280, 720).alias("box")).where("box is not null")
    return rows.select("patch", *(F.col("box")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


@query(f"""WITH {OBS} SELECT label, count(*) AS n_selected, count(*) FILTER (WHERE vec_id % 7 = 0) AS from_photo, count(*) FILTER (WHERE vec_id % 7 > 0) AS from_video,
array_to_string(list_sort(list(DISTINCT {_BINNED(score.POSE_BANDS)}) FILTER (WHERE {_BINNED(score.POSE_BANDS)} IS NOT NULL)), ',') AS bands FROM obs WHERE vec_id % 5 = 0 GROUP BY label""")
def selection_by_origin(spark, sf_dir):
    rows = observe.by_origin(observations(spark, sf_dir).where("vec_id % 5 = 0"), "label", F.col("vec_id") % 7 == 0, "yaw")
    return rows.withColumn("bands", F.array_join("bands", ","))


_SCHEMES = ((8, 20), (10, 30), (8, 30))


@query(f"WITH {OBS} " + " UNION ALL ".join(f"""SELECT {i} AS scheme, label, round(avg(face_px) FILTER (WHERE abs(yaw) < {a}), 6) AS frontal,
round(avg(face_px) FILTER (WHERE abs(yaw) >= {a} AND abs(yaw) < {b}), 6) AS turned, round(avg(face_px) FILTER (WHERE abs(yaw) >= {b}), 6) AS profile FROM obs GROUP BY label""" for i, (a, b) in enumerate(_SCHEMES)))
def pose_schemes(spark, sf_dir):
    from functools import reduce

    rows = observations(spark, sf_dir)
    parts = (report.pose_pivot(rows, "label", "yaw", "face_px", edges).select(F.lit(i).alias("scheme"), "label", *(F.round(c, 6).alias(c) for c in ("frontal", "turned", "profile"))) for i, edges in enumerate(_SCHEMES))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("""SELECT o_orderkey AS job, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 10 ELSE 1 END::BIGINT AS blend, CASE WHEN o_custkey % 3 = 0 THEN 7 ELSE 2 END::BIGINT AS mask, coalesce(CASE WHEN o_custkey % 3 = 0 THEN 5 END, 0)::BIGINT AS extra FROM orders""")
def merged_options(spark, sf_dir):
    cust = F.col("o_custkey")
    base = F.create_map(F.lit("blend"), F.lit(1).cast("long"), F.lit("mask"), F.lit(2).cast("long"))
    none = F.create_map().cast("map<string,bigint>")
    one = F.when(cust % 2 == 0, F.create_map(F.lit("blend"), (cust % 10).cast("long"))).otherwise(none)
    two = F.when(cust % 3 == 0, F.create_map(F.lit("mask"), F.lit(7).cast("long"), F.lit("extra"), F.lit(5).cast("long"))).otherwise(none)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), control.merged(control.merged(base, one), two).alias("m"))
    return rows.select("job", F.col("m")["blend"].alias("blend"), F.col("m")["mask"].alias("mask"), F.coalesce(F.col("m")["extra"], F.lit(0).cast("long")).alias("extra"))


@query("""WITH d AS (SELECT page_id, sha256(html) AS whole, substr(sha256(concat_ws('|', url, length(html)::VARCHAR)), 1, 32) AS key FROM pages) SELECT * FROM d""")
def file_digests(spark, sf_dir):
    """The digest of a whole file, and a composite key of its name and length."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.sha2("html", 256).alias("whole"), F.substring(F.sha2(F.concat_ws("|", "url", F.length("html").cast("string")), 256), 1, 32).alias("key"))
