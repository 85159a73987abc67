"""The control plane as tables: segments, manifests, jobs, fingerprints, costs and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import score

#: Seconds of a segment, and from which on a clip is segmented; bytes of output a second.
SEGMENT_S, SEGMENTED_FROM_S, BYTES_PER_S = 90.0, 180.0, 3.5e6


def segment_plan(windows: DataFrame, key: str, segment_s: float = SEGMENT_S) -> DataFrame:
    """key, idx, seg_start, seg_end of windows (start_s, end_s); a last stub under a third of a segment joins the one before."""
    span = F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.0))
    n = F.ceil((span - 1e-6) / segment_s)
    stub = span - (n - 1) * segment_s
    count = F.when((n > 1) & (stub < segment_s / 3), n - 1).otherwise(n).cast("long")
    planned = windows.withColumn("count", count).where("count > 0").select(key, "start_s", "end_s", "count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("idx"))
    return planned.select(
        key, "idx", (F.col("start_s") + F.col("idx") * segment_s).alias("seg_start"),
        F.when(F.col("idx") == F.col("count") - 1, F.col("end_s")).otherwise(F.col("start_s") + (F.col("idx") + 1) * segment_s).alias("seg_end"),
    )


def resume(planned: DataFrame, manifest: DataFrame, key: list[str], files: DataFrame) -> DataFrame:
    """Planned segments still to do: done are those in the manifest whose file has the recorded size, not 0."""
    done = manifest.join(files.withColumnRenamed("bytes", "size"), key).where("bytes > 0 and size = bytes")
    return planned.join(done.select(*key), key, "left_anti")


def missing_indices(received: DataFrame, key: str, index: str, expected: Column) -> DataFrame:
    """key, index of those from 0 to expected - 1 that were not received."""
    wanted = received.groupBy(key).agg(expected.alias("n")).where("n > 0").select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias(index))
    return wanted.join(received.select(key, F.col(index).cast("long").alias(index)), [key, index], "left_anti")


def latest(events: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The newest row of each key: an append-only log read as an updatable table."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def recovered(jobs: DataFrame, status: str = "status") -> DataFrame:
    """Jobs after a crash: those running or queued are interrupted."""
    return jobs.withColumn(status, F.when(F.col(status).isin("running", "queued"), "interrupted").otherwise(F.col(status)))


#: States that may follow each state of a job.
TRANSITIONS = {
    "queued": ("running", "cancelled", "interrupted"), "running": ("done", "error", "cancelled", "interrupted"),
}


def bad_transitions(events: DataFrame, key: list[str], order: list[str], status: str = "status") -> DataFrame:
    """Rows whose status may not follow the one before; a job starts as queued."""
    before = F.lag(status).over(Window.partitionBy(*key).orderBy(*order))
    allowed = F.lit(False)
    for a, bs in TRANSITIONS.items():
        allowed = allowed | ((F.col("before") == a) & F.col(status).isin(*bs))
    allowed = F.when(F.col("before").isNull(), F.col(status) == "queued").otherwise(allowed)
    return events.withColumn("before", before).where(~allowed)


def content_fingerprint(text: Column, sample: int, digits: int = 32) -> Column:
    """Hash of size, head and, beyond one sample, tail; null content has none."""
    n = F.length(text)
    tail = F.when(n > sample, F.right(text, F.lit(sample))).otherwise("")
    return F.substring(F.sha2(F.concat(n.cast("string"), F.lit("|"), F.substring(text, 1, sample), F.lit("|"), tail), 256), 1, digits)


def settings_fingerprint(rows: DataFrame, key: list[str], item: str, digits: int = 24) -> DataFrame:
    """key..., fingerprint of a key's items, whatever their order."""
    return rows.groupBy(*key).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), "|"), 256), 1, digits).alias("fingerprint"))


def estimate(clips: DataFrame, ms_per_frame: float = 220.0) -> DataFrame:
    """Adds span, frames, seconds, human, bytes, disk_ok and segments for clips (duration, fps, start_s, end_s, free_bytes)."""
    end = F.when(F.coalesce(F.col("end_s"), F.lit(0.0)) > 0, F.least("end_s", "duration")).otherwise(F.col("duration"))
    span = F.greatest(F.lit(0.0), end - F.greatest(F.lit(0.0), F.coalesce(F.col("start_s"), F.lit(0.0))))
    out = clips.withColumn("span", span).withColumn("frames", F.bround(F.col("span") * F.col("fps")).cast("long"))
    out = out.withColumn("seconds", F.col("frames") * ms_per_frame / 1000.0).withColumn("human", score.human_duration(F.col("seconds")))
    out = out.withColumn("bytes", F.floor(F.col("span") * BYTES_PER_S * 2).cast("long")).withColumn("disk_ok", F.col("free_bytes") > F.col("bytes"))
    n = F.ceil((F.col("span") - 1e-6) / SEGMENT_S)
    stub = F.col("span") - (n - 1) * SEGMENT_S
    return out.withColumn("segments", F.when(F.col("span") <= SEGMENTED_FROM_S, 1).when(stub < SEGMENT_S / 3, n - 1).otherwise(n).cast("long"))


def conflicts(registered: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Names that stand in both; an excluded name with alternatives ("a/b/c") counts for each."""
    parts = excluded.select(F.explode(F.split(key, "/")).alias(key))
    return registered.select(key).intersect(parts)


def cached(requests: DataFrame, cache: DataFrame, key: str, version: int) -> DataFrame:
    """Adds hit: the cache holds the request's key at this version; another version is a miss."""
    valid = cache.where(F.col("version") == version).select(key).distinct().withColumn("hit", F.lit(True))
    return requests.join(valid, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def evictions(rows: DataFrame, order: list[str], resource: str, key: list[str]) -> DataFrame:
    """Adds evict: the next row uses another resource, or there is none."""
    return rows.withColumn("evict", ~F.col(resource).eqNullSafe(F.lead(resource).over(Window.partitionBy(*key).orderBy(*order))))


def liveness(beats: DataFrame, key: list[str], ts: str, now: Column | DataFrame, stale_s: float = 180.0) -> DataFrame:
    """key..., age_s, alive by each key's last heartbeat; now is a column, or a table of one row with a column of that name."""
    last = beats.groupBy(*key).agg(F.max(ts).alias("last"))
    if isinstance(now, DataFrame):
        last, now = last.join(F.broadcast(now.select("now")), F.lit(True)), F.col("now")  # one row
    age = F.unix_timestamp(now) - F.unix_timestamp("last")
    return last.select(*key, age.alias("age_s"), (age <= stale_s).alias("alive"))


def looked_up(requests: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Requests joined with the registry; a key that the registry lacks fails the query and names it."""
    known = registry.withColumn("_known", F.lit(True))
    checked = F.when(F.col("_known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("not registered: "), F.col(key).cast("string"))))
    return requests.join(known, key, "left").withColumn(key, checked).drop("_known")


def restart(planned: DataFrame, manifest: DataFrame, key: list[str], files: DataFrame, job: str, fingerprint: str) -> DataFrame:
    """job, segments_done, frames_done, segments_left: where each job goes on. Manifest rows of another fingerprint count for nothing.

    Both tables carry the fingerprint; the manifest has bytes and frames, files have bytes.
    """
    own = manifest.join(planned.select(*key, fingerprint), [*key, fingerprint]).join(files.withColumnRenamed("bytes", "size"), key).where("bytes > 0 and size = bytes")
    state = planned.join(own.select(*key, F.col("frames").alias("done_frames")), key, "left")
    done = F.col("done_frames").isNotNull()
    return state.groupBy(job).agg(F.count(F.when(done, 1)).alias("segments_done"), F.coalesce(F.sum("done_frames"), F.lit(0)).alias("frames_done"), F.count(F.when(~done, 1)).alias("segments_left"))


def merged(base: Column, override: Column) -> Column:
    """A map with another's values where it has them; keys stay distinct whatever the session's policy."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(override, k))
    return F.map_concat(kept, override)


#: Column of a library entry, its path in the stored render record, its type.
LIBRARY = (
    ("quality", "$.quality", "string"), ("face_mode", "$.face_mode", "string"), ("swapper", "$.result.config.swapper", "string"), ("enhancer", "$.result.config.enhancer", "string"),
    ("enhancer_blend", "$.result.config.enhancer_blend", "double"), ("mask_mode", "$.result.config.mask", "string"), ("color_match", "$.result.config.color_match", "boolean"),
    ("encoder", "$.result.encoder", "string"), ("frames", "$.result.frames", "bigint"), ("identity_switches", "$.result.tracking.identity_switches", "bigint"),
    ("benchmark_winner", "$.result.benchmark_winner", "string"), ("benchmark_score", "$.result.benchmark_score", "double"),
    ("benchmark_candidates", "$.result.benchmark_candidates", "bigint"), ("render_seconds", "$.result.timings.total_s", "double"),
)


def library_columns(rows: DataFrame, record: str) -> DataFrame:
    """Adds the flat columns of a nested render record, a JSON text whose fields come and go: engine, mask_sources (JSON) and `LIBRARY`.

    The record is parsed once into a variant. One that is malformed counts as empty, and what
    is absent, null or of another kind than asked for is null; the engine is `v1` then.
    """
    name = "_record"
    while name in rows.columns:
        name += "_"
    parsed = rows.withColumn(name, F.try_parse_json(record))
    get = lambda path, kind: F.try_variant_get(name, path, kind)
    engine = F.coalesce(get("$.result.engine", "string"), get("$.engine", "string"), F.lit("v1"))
    sources = F.to_json(get("$.result.mask_sources", "variant"))
    return parsed.select(*rows.columns, engine.alias("engine"), sources.alias("mask_sources"), *(get(path, kind).alias(column) for column, path, kind in LIBRARY))


def in_group(spark, group: str, action, description: str = ""):
    """action() with its Spark jobs under one group, so that `cancel_group` from any thread ends them."""
    context = spark.sparkContext
    context.setJobGroup(group, description or group, interruptOnCancel=True)
    try:
        return action()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def cancel_group(spark, group: str) -> None:
    spark.sparkContext.cancelJobGroup(group)


def is_active(spark, group: str) -> bool:
    """Whether a job of the group is running."""
    tracker = spark.sparkContext.statusTracker()
    return any((info := tracker.getJobInfo(j)) is not None and info.status == "RUNNING" for j in tracker.getJobIdsForGroup(group))

