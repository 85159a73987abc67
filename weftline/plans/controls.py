"""Queries of the control plane and of sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import score
from weftline.operators import control
from weftline.plans.registry import query
from weftline.plans.stand_ins import table
from weftline.sources import files, sampling

_WINDOWS = "w AS (SELECT o_orderkey AS job, (o_custkey % 30)::DOUBLE AS s, (o_custkey % 30 + o_orderkey % 700)::DOUBLE AS e FROM orders)"
_PLAN = _WINDOWS + """, n AS (SELECT *, ceil((e - s - 1e-6) / 90) AS n FROM w WHERE e > s), c AS (SELECT *, CASE WHEN n > 1 AND (e - s) - (n - 1) * 90 < 30 THEN n - 1 ELSE n END::BIGINT AS c FROM n),
i AS (SELECT *, unnest(range(c)) AS idx FROM c), plan AS (SELECT job, idx, s + idx * 90 AS seg_start, CASE WHEN idx = c - 1 THEN e ELSE s + (idx + 1) * 90 END AS seg_end FROM i)"""


def _windows(spark, sf_dir):
    key = F.col("o_custkey") % 30
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), key.cast("double").alias("start_s"), (key + F.col("o_orderkey") % 700).cast("double").alias("end_s"))


@query(f"WITH {_PLAN} SELECT job, idx, seg_start, seg_end FROM plan")
def segment_plan(spark, sf_dir):
    return control.segment_plan(_windows(spark, sf_dir), "job")


@query(f"""WITH {_PLAN}, m AS (SELECT DISTINCT l_orderkey AS job, (l_linenumber - 1)::BIGINT AS idx FROM lineitem WHERE l_quantity > 5)
SELECT job, idx FROM plan ANTI JOIN (SELECT job, idx FROM m WHERE (job + idx) % 9 > 0) USING (job, idx)""")
def resume_set(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), (F.col("l_linenumber") - 1).cast("long").alias("idx"), "l_quantity")
    manifest = lines.where("l_quantity > 5").select("job", "idx", F.lit(100).alias("bytes"))
    found = lines.select("job", "idx", F.when((F.col("job") + F.col("idx")) % 9 == 0, 50).otherwise(100).alias("bytes"))  # a crash left some half-written
    return control.resume(control.segment_plan(_windows(spark, sf_dir), "job"), manifest, ["job", "idx"], found).select("job", "idx")


@query("""WITH r AS (SELECT l_orderkey AS upload, (l_linenumber * 2)::BIGINT AS chunk FROM lineitem), n AS (SELECT upload, max(chunk) AS n FROM r GROUP BY upload), e AS (SELECT upload, unnest(range(n)) AS chunk FROM n)
SELECT upload, chunk FROM e ANTI JOIN r USING (upload, chunk)""")
def missing_chunks(spark, sf_dir):
    got = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("upload"), (F.col("l_linenumber") * 2).cast("long").alias("chunk"))
    return control.missing_indices(got, "upload", "chunk", F.max("chunk"))


@query("SELECT o_orderkey AS job, o_orderdate AS finished FROM orders SEMI JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def library_listing(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("finished"))
    kept = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("job"))
    return done.join(kept, "job", "left_semi")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) SELECT o_custkey AS owner, o_orderkey AS job, o_orderstatus AS status FROM r WHERE r = 1""")
def latest_job_state(spark, sf_dir):
    rows = control.latest(table(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return rows.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status"))


@query("SELECT o_orderkey AS job, o_orderdate AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def newest_jobs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("created")).orderBy(F.desc("created"), F.desc("job")).limit(50)


@query("SELECT o_orderkey AS job, CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'interrupted' WHEN o_orderkey % 4 = 2 THEN 'done' ELSE 'error' END AS status FROM orders")
def crash_recovery(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "error"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return control.recovered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), status.alias("status")))


_STATUS = ("queued", "running", "done", "error", "cancelled")


@query("""WITH s AS (SELECT l_orderkey AS job, (l_linenumber::BIGINT * 1000 + l_suppkey % 1000) * 1000000 + l_partkey AS step, ['queued','running','done','error','cancelled'][(CASE WHEN l_linenumber = 1 AND l_orderkey % 10 > 0 THEN 0 ELSE (l_linenumber + l_partkey) % 5 END + 1)::INT] AS status FROM lineitem),
b AS (SELECT *, lag(status) OVER (PARTITION BY job ORDER BY step) AS before FROM s)
SELECT job, step, before, status FROM b WHERE NOT (CASE WHEN before IS NULL THEN status = 'queued' ELSE (before = 'queued' AND status IN ('running', 'cancelled', 'interrupted')) OR (before = 'running' AND status IN ('done', 'error', 'cancelled', 'interrupted')) END)""")
def bad_transitions(spark, sf_dir):
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    at = F.when((line == 1) & (F.col("l_orderkey") % 10 > 0), 0).otherwise((line + part) % 5)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), ((F.col("l_linenumber").cast("long") * 1000 + F.col("l_suppkey") % 1000) * 1_000_000 + F.col("l_partkey")).alias("step"), F.element_at(F.array(*map(F.lit, _STATUS)), (at + 1).cast("int")).alias("status"))
    return control.bad_transitions(rows, ["job"], ["step"]).select("job", "step", "before", "status")


def _progress_sql() -> str:
    out, before = "", 0.0
    for i, (_, w) in enumerate(score.STAGE_WEIGHTS):
        out += f" WHEN i = {i} THEN least(999e-1, ({before!r}::DOUBLE + {w!r}::DOUBLE * (pct / 100)) * 100)"
        before += w
    return out


@query(f"WITH e AS (SELECT event_id, event_id % 11 AS i, (event_id * 7 % 101)::DOUBLE AS pct FROM events) SELECT event_id, round(CASE{_progress_sql()} ELSE pct END, 5) AS progress FROM e")
def stage_progress(spark, sf_dir):
    names = [n for n, _ in score.STAGE_WEIGHTS] + ["waiting"]
    stage = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 11 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.round(score.overall_progress(stage, (F.col("event_id") * 7 % 101).cast("double")), 5).alias("progress"))


@query("SELECT doc_id, substr(sha256(length(text)::VARCHAR || '|' || substr(text, 1, 1024) || '|' || CASE WHEN length(text) > 1024 THEN right(text, 1024) ELSE '' END), 1, 32) AS fingerprint FROM documents")
def content_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", control.content_fingerprint(F.col("text"), 1024).alias("fingerprint"))


@query("SELECT l_orderkey AS job, substr(sha256(string_agg(l_partkey::VARCHAR, '|' ORDER BY l_partkey::VARCHAR)), 1, 24) AS fingerprint FROM lineitem GROUP BY l_orderkey")
def settings_fingerprint(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_partkey").cast("string").alias("item"))
    return control.settings_fingerprint(rows, ["job"], "item")


_HUMAN = "CASE WHEN s < 90 THEN s || 's' WHEN s < 5400 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END"


@query(f"""WITH c AS (SELECT o_orderkey AS job, (o_orderkey % 4000)::DOUBLE AS dur, 24 + o_custkey % 37 AS fps, (o_custkey % 11)::DOUBLE AS st, (CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5000 ELSE 0 END)::DOUBLE AS en FROM orders),
x AS (SELECT *, greatest(0e0, CASE WHEN en > 0 THEN least(en, dur) ELSE dur END - st) AS span FROM c), y AS (SELECT *, round_even(span * fps, 0)::BIGINT AS frames, (round_even(span * fps, 0) * 22e1 / 1e3)::DOUBLE AS secs FROM x),
z AS (SELECT *, floor(secs)::BIGINT AS s, floor(span * 35e5 * 2)::BIGINT AS bytes, ceil((span - 1e-6) / 90) AS n FROM y)
SELECT job, span, frames, round(secs, 3) AS seconds, {_HUMAN} AS human, bytes, 5000000000 > bytes AS disk_ok, (CASE WHEN span <= 180 THEN 1 WHEN span - (n - 1) * 90 < 30 THEN n - 1 ELSE n END)::BIGINT AS segments FROM z""")
def cost_estimate(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    clips = table(spark, sf_dir, "orders").select(
        key.alias("job"), (key % 4000).cast("double").alias("duration"), (24 + cust % 37).cast("double").alias("fps"), (cust % 11).cast("double").alias("start_s"),
        F.when(key % 3 == 0, key % 5000).otherwise(0).cast("double").alias("end_s"), F.lit(5_000_000_000).alias("free_bytes"),
    )
    return control.estimate(clips).select("job", "span", "frames", F.round("seconds", 3).alias("seconds"), "human", "bytes", "disk_ok", "segments")


@query("SELECT DISTINCT p_brand FROM part WHERE p_size > 25 INTERSECT SELECT unnest(string_split(b, '/')) FROM (SELECT min(p_brand) || '/' || max(p_brand) AS b FROM part WHERE p_size < 5 GROUP BY p_type)")
def registry_conflicts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    out = part.where("p_size < 5").groupBy("p_type").agg(F.concat_ws("/", F.min("p_brand"), F.max("p_brand")).alias("p_brand"))
    return control.conflicts(part.where("p_size > 25"), out, "p_brand")


@query("SELECT p_partkey AS model, '{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}' AS record FROM part WHERE p_type LIKE '%STEEL%' OR lower(p_type) LIKE '%brass%' OR p_size % 2 = 0")
def registry_export(spark, sf_dir):
    kept = F.col("p_type").contains("STEEL") | F.lower("p_type").contains("brass") | (F.col("p_size") % 2 == 0)
    return table(spark, sf_dir, "part").where(kept).select(F.col("p_partkey").alias("model"), F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("record"))


@query("SELECT p_partkey AS model, coalesce('h' || l, '?') AS digest FROM part LEFT JOIN (SELECT l_partkey, min(l_orderkey) AS l FROM lineitem WHERE l_quantity > 30 GROUP BY l_partkey) ON l_partkey = p_partkey")
def registry_digests(spark, sf_dir):
    hashes = table(spark, sf_dir, "lineitem").where("l_quantity > 30").groupBy(F.col("l_partkey").alias("model")).agg(F.concat(F.lit("h"), F.min("l_orderkey").cast("string")).alias("d"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model")).join(hashes, "model", "left").select("model", F.coalesce("d", F.lit("?")).alias("digest"))


@query("SELECT o_orderkey AS request, o_custkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 3) AS hit FROM orders")
def cache_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("cache_key"))
    cache = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cache_key"), F.col("l_linenumber").alias("version"))
    return control.cached(asked, cache, "cache_key", 3).select("request", "hit")


@query("SELECT l_orderkey AS run, (l_linenumber::BIGINT * 1000 + l_suppkey % 1000) * 1000000 + l_partkey AS step, (lead(l_suppkey % 3) OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber::BIGINT * 1000 + l_suppkey % 1000) * 1000000 + l_partkey)) IS DISTINCT FROM l_suppkey % 3 AS evict FROM lineitem")
def session_evictions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), ((F.col("l_linenumber").cast("long") * 1000 + F.col("l_suppkey") % 1000) * 1_000_000 + F.col("l_partkey")).alias("step"), (F.col("l_suppkey") % 3).alias("model"))
    return control.evictions(rows, ["step"], "model", ["run"]).select("run", "step", "evict")


@query("""WITH l AS (SELECT user_id AS worker, max(ts) AS last FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT worker, (floor(epoch(now)) - floor(epoch(last)))::BIGINT AS age_s, floor(epoch(now)) - floor(epoch(last)) <= 18000 AS alive FROM l, n""")
def heartbeat_liveness(spark, sf_dir):
    beats = table(spark, sf_dir, "events").withColumnRenamed("user_id", "worker")
    return control.liveness(beats, ["worker"], "ts", beats.agg(F.max("ts").alias("now")), 18000.0)


@query("SELECT p_partkey AS upload, right(regexp_replace(p_name || ' / ' || p_type || '.mp4', '[^A-Za-z0-9._-]', '_', 'g'), 80) AS name FROM part")
def safe_names(spark, sf_dir):
    raw = F.concat_ws("", "p_name", F.lit(" / "), "p_type", F.lit(".mp4"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("upload"), score.safe_name(raw).alias("name"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def chunk_reassembly(spark, sf_dir):
    return files.reassembled(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("SELECT event_id, coalesce(TRY_CAST(props->>'k' AS BIGINT), 0) AS k FROM events")
def options_json(spark, sf_dir):
    options = F.from_json("props", "k long", {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(options["k"], F.lit(0).cast("long")).alias("k"))


@query("""SELECT l_orderkey AS clip, l_linenumber AS face, round(CASE WHEN l_quantity * 9 < 64 THEN 7e-1 * 35e-2 WHEN l_quantity * 9 < 128 THEN 7e-1 * 65e-2 WHEN l_quantity * 9 > 400 THEN least(1e0, 7e-1 * 115e-2) ELSE 7e-1 END, 6) AS blend FROM lineitem""")
def adaptive_blend(spark, sf_dir):
    value = score.adaptive_blend(F.lit(0.7), F.col("l_quantity") * 9)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").alias("face"), F.round(value, 6).alias("blend"))


_CLIPS = "c AS (SELECT o_orderkey AS clip, o_orderkey % 997 AS total, (24 + o_custkey % 37)::DOUBLE AS fps FROM orders)"


def _clips(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip"), (F.col("o_orderkey") % 997).alias("total"), (24 + F.col("o_custkey") % 37).cast("double").alias("fps"))


@query(f"WITH {_CLIPS}, k AS (SELECT *, least(60, total) AS k FROM c WHERE total > 0), i AS (SELECT *, unnest(range(k)) AS i FROM k) SELECT DISTINCT clip, round_even(i * (total - 1) / greatest(k - 1, 1), 0)::BIGINT AS frame FROM i")
def even_sample(spark, sf_dir):
    return sampling.even_indices(_clips(spark, sf_dir), "clip", "total", 60)


@query(f"WITH {_CLIPS}, k AS (SELECT *, least(14, total) AS k FROM c WHERE total > 0), i AS (SELECT *, unnest(range(k)) AS i FROM k) SELECT DISTINCT clip, floor(i * (total - 1) / greatest(k - 1, 1))::BIGINT AS frame FROM i")
def even_sample_truncated(spark, sf_dir):
    return sampling.even_indices(_clips(spark, sf_dir), "clip", "total", 14, truncate=True)


@query(f"WITH {_CLIPS}, s AS (SELECT *, greatest(1, round_even(fps / 4, 0))::BIGINT AS step FROM c WHERE total > 0) SELECT clip, unnest(range(0, least(total - 1, 89 * step) + 1, step)) AS frame FROM s")
def stride_sample(spark, sf_dir):
    return sampling.stride_indices(_clips(spark, sf_dir), "clip", "total", "fps", 4.0, 90)


@query(f"WITH {_CLIPS}, s AS (SELECT *, (CASE WHEN total <= 80 THEN 1 ELSE greatest(1, total // 60) END)::BIGINT AS step FROM c WHERE total > 0) SELECT clip, unnest(range(0, total, step)) AS frame FROM s")
def conditional_stride(spark, sf_dir):
    return sampling.conditional_indices(_clips(spark, sf_dir), "clip", "total")


@query(f"""WITH {_CLIPS}, s AS (SELECT *, greatest(1, round_even(fps / 24, 0))::BIGINT AS step FROM c WHERE total > 0), i AS (SELECT clip, unnest(range(0, least(total - 1, 9 * step) + 1, step)) AS frame FROM s)
SELECT l_orderkey AS clip, l_linenumber::BIGINT AS frame, l_quantity AS value FROM lineitem SEMI JOIN i ON i.clip = l_orderkey AND i.frame = l_linenumber""")
def indexed_sample(spark, sf_dir):
    wanted = sampling.stride_indices(_clips(spark, sf_dir), "clip", "total", "fps", 24.0, 10)
    frames = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").cast("long").alias("frame"), F.col("l_quantity").alias("value"))
    return sampling.read_indices(frames, wanted, ["clip", "frame"])


@query("""WITH r AS (SELECT p_partkey AS clip, 24 + p_size AS num, p_size % 3 AS den, 24 + p_size % 7 AS nom, p_retailprice % 100 AS dur, (p_partkey % 4) * 90 AS rot FROM part),
f AS (SELECT *, CASE WHEN den = 0 THEN 0e0 ELSE num / den END AS avg FROM r), g AS (SELECT *, CASE WHEN avg > 0 THEN avg WHEN nom > 0 THEN nom ELSE 25 END AS fps FROM f)
SELECT clip, round(fps, 6) AS fps, avg > 0 AND nom > 0 AND abs(avg - nom) / greatest(nom, 1e-6) > 1e-2 AS is_vfr, round_even(fps * dur, 0)::BIGINT AS total_frames, CASE WHEN rot % 180 = 90 THEN 720 ELSE 1280 END AS shown_width FROM g""")
def probe_facts(spark, sf_dir):
    size = F.col("p_size")
    raw = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("clip"), F.concat_ws("/", (24 + size).cast("string"), (size % 3).cast("string")).alias("avg_rate"), F.concat((24 + size % 7).cast("string"), F.lit("/1")).alias("nominal_rate"),
        F.lit(None).cast("double").alias("stream_s"), (F.col("p_retailprice") % 100).alias("format_s"), F.lit(0).cast("long").alias("nb_frames"),
        F.lit(1280).alias("width"), F.lit(720).alias("height"), ((F.col("p_partkey") % 4) * 90).cast("int").alias("rotation"),
    )
    return files.probe(raw).select("clip", F.round("fps", 6).alias("fps"), "is_vfr", "total_frames", "shown_width")
