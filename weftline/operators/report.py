"""Reports over measured frames: percentiles, correlations, tallies and shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.scratch import cut

#: Percentiles of a profile.
PERCENTILES = (0.01, 0.05, 0.10, 0.25, 0.50)


#: Buckets of a range in one pass of `percentiles`; keys with ranges still open up to which these are broadcast.
BUCKETS, OPEN_KEYS, LINEAR, SPLITS = 1_024, 20_000, 3, 64


def percentiles(rows: DataFrame, key: list[str], value: str, at=PERCENTILES, nan_last: bool = False) -> DataFrame:
    """key..., p1, p5, ...: exact, with linear interpolation; null and NaN values don't count, a key of no others is null throughout.

    With `nan_last` NaN values count, each as more than any number.

    By counting: the first pass counts each key's values in `BUCKETS` equal ranges,
    on the map side first, and each further one only those in the ranges that
    hold a wanted rank, until these hold one value each. Ranges that `LINEAR` passes leave
    open hold values of very different sizes; they are parted at `SPLITS` of their own
    values from then on, each of which is a range by itself, so that every pass makes them
    shorter. Whatever a key's size or number of distinct values, its state is the counts of these ranges.
    """
    x = F.col(value).cast("double")
    v = F.when(~F.isnan(x), x)
    known = rows.select(*key, v.alias("v")).where("v is not null")
    sizes = cut(rows.groupBy(*key).agg(F.count(x if nan_last else v).alias("n"), F.count(v).alias("numbers"), F.min(v).alias("lo"), F.max(v).alias("hi")))
    places = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(q) * (F.col("n") - 1)).alias("place")) for i, q in enumerate(at)))).alias("p")
    placed = sizes.where("n > 0").select(*key, "lo", "hi", "numbers", places).select(*key, "lo", "hi", "numbers", "p.i", "p.place")
    rank = F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank")
    wanted = placed.select(*key, "lo", "hi", "numbers", F.lit(0).cast("long").alias("before"), rank).where("rank < numbers").drop("numbers").distinct()
    found = []
    while True:
        wanted = cut(wanted)
        found.append(wanted.where("lo = hi").select(*key, "rank", F.col("lo").alias("value")))
        wanted = wanted.where("lo < hi")
        if wanted.isEmpty():
            break
        ranges = wanted.select(*key, "lo", "hi", "before").distinct()
        ranges = F.broadcast(ranges) if ranges.count() <= OPEN_KEYS else ranges
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
        inside = known.alias("a").join(ranges.alias("b"), [*same, F.col("v").between(F.col("lo"), F.col("hi"))]).select(*(F.col(f"b.{c}").alias(c) for c in key), "lo", "hi", "before", "v")
        if len(found) <= LINEAR:
            # Half of each, so that the width of the whole range of doubles is finite.
            bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS))
        else:
            shares = F.array(*(F.lit(i / SPLITS) for i in range(SPLITS + 1)))
            splits = cut(inside.groupBy(*key, "lo", "hi", "before").agg(F.array_distinct(F.percentile_approx("v", shares, 2_000)).alias("splits")))
            splits = F.broadcast(splits) if splits.count() <= OPEN_KEYS // SPLITS else splits
            a, b = inside.alias("a"), splits.alias("b")
            same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*key, "lo", "hi", "before")]
            inside = a.join(b, same).select(*(F.col(f"a.{c}").alias(c) for c in (*key, "lo", "hi", "before", "v")), "splits")
            bucket = 2 * F.size(F.filter("splits", lambda s: s < F.col("v"))) + F.array_contains("splits", F.col("v")).cast("int")
        counts = inside.groupBy(*key, "lo", "hi", "before", bucket.alias("bucket")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        order = Window.partitionBy(*key, "lo", "hi", "before").orderBy("bucket")  # the counts of one range: BUCKETS rows
        counts = counts.withColumn("end", F.col("before") + F.sum("c").over(order)).withColumn("start", F.col("end") - F.col("c"))
        a, b = wanted.alias("a"), counts.alias("b")
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
        hit = a.join(b, [*same, F.col("a.lo") == F.col("b.lo"), F.col("a.hi") == F.col("b.hi"), F.col("a.before") == F.col("b.before")]).where("rank >= start and rank < end")
        wanted = hit.select(*(F.col(f"a.{c}").alias(c) for c in key), F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("start").alias("before"), "rank")
    values = reduce(DataFrame.unionByName, found).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("values"))
    s, v = sizes.alias("s"), values.alias("v")
    out = s.join(v, [F.col(f"s.{c}").eqNullSafe(F.col(f"v.{c}")) for c in key], "left")

    def between(q: float) -> Column:
        place = F.lit(q) * (F.col("n") - 1)
        low, high = (F.when(f(place) >= F.col("numbers"), F.lit(float("nan"))).otherwise(F.try_element_at("values", f(place).cast("long"))) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    return out.select(*(F.col(f"s.{c}").alias(c) for c in key), *(between(q).alias(f"p{round(100 * q)}") for q in at))


#: Fixed value: a face under this similarity to the person is a bystander's, no failure of theirs.
BYSTANDER = 0.15


def identity_profile(rows: DataFrame, key: list[str], similarity: str, bystander: float = BYSTANDER, at=PERCENTILES) -> DataFrame:
    """`percentiles` of the similarities to the person, bystanders left out, with counted and left_out, the numbers of rows."""
    other = F.col(similarity) < bystander
    numbers = rows.groupBy(*key).agg(F.count(F.when(~other, 1)).alias("counted"), F.count(F.when(other, 1)).alias("left_out"))
    return numbers.join(percentiles(rows.where(~other), key, similarity, at), key, "left")


def condition_correlation(rows: DataFrame, outcome: str, conditions: list[str], bad: Column) -> DataFrame:
    """condition, bad_mean, good_mean, corr, rank: conditions by how strongly they go with the outcome."""
    long = rows.select(F.col(outcome).alias("o"), bad.alias("bad"), F.explode(F.array(*(F.struct(F.lit(c).alias("condition"), F.col(c).cast("double").alias("v")) for c in conditions))).alias("x"))
    stats = long.select("o", "bad", "x.*").where("o is not null and v is not null").groupBy("condition").agg(
        F.avg(F.when(F.col("bad"), F.col("v"))).alias("bad_mean"), F.avg(F.when(~F.col("bad"), F.col("v"))).alias("good_mean"),
        F.covar_pop("v", "o").alias("cov"), F.count("*").alias("n"), F.stddev_pop("v").alias("sv"), F.stddev_pop("o").alias("so"),
    )
    usable = (F.col("n") > 3) & (F.col("sv") > 1e-9) & (F.col("so") > 1e-9)
    known = stats.withColumn("corr", F.round(F.when(usable, F.col("cov") / (F.col("sv") * F.col("so"))).otherwise(0.0), 6))
    # One row a condition: the single partition of this window is as small as the list of conditions.
    return known.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("corr")), "condition"))).select("condition", "bad_mean", "good_mean", "corr", "rank")


def failure_rate(rows: DataFrame, key: list[str], bad: Column) -> DataFrame:
    return rows.groupBy(*key).agg(F.sum(F.when(bad, 1).otherwise(0)).alias("failed"), F.count("*").alias("n")).withColumn("rate", F.col("failed") / F.col("n"))


def tournament(rows: DataFrame, config: str, category: str, value: str) -> DataFrame:
    """config, category (null: pooled), mean, worst, n."""
    sets = rows.groupingSets([[config, category], [config]], config, category)
    return sets.agg(F.avg(value).alias("mean"), F.min(value).alias("worst"), F.count(value).alias("n"))


def matrix(rows: DataFrame, config: str, category: str, value: str) -> DataFrame:
    """config, category, mean, n, missing: a cell for every configuration and category that occur, without a value where nothing was measured."""
    measured = rows.groupBy(config, category).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    measured = cut(measured)
    columns = measured.agg(F.collect_set(category).alias("all"))  # one row of the categories
    cells = measured.select(config).distinct().join(F.broadcast(columns), F.lit(True)).select(config, F.explode("all").alias(category))
    found = cells.join(measured, [config, category], "left")
    return found.select(config, category, "mean", F.coalesce("n", F.lit(0)).alias("n"), F.col("mean").isNull().alias("missing"))


def detector_rows(frames: DataFrame, found: DataFrame, reference: DataFrame) -> DataFrame:
    """clip, detector, frames, frames_with_face, recall, boxes_total, landmark_err_px, ms: how each detector does on each clip.

    frames: clip, detector, frame and ms of each try; found: clip, detector, frame, det, centre and points of each box;
    reference: clip, frame, centre and points of the face that is there. The landmark error is the mean distance of
    the points of the box nearest to it; null where a detector never found one in such a frame.
    """
    apart = lambda a, b: F.sqrt(F.pow(a[0] - b[0], 2) + F.pow(a[1] - b[1], 2))
    key = ["clip", "detector", "frame"]
    boxes = found.join(reference.select("clip", "frame", F.col("centre").alias("_c"), F.col("points").alias("_p")), ["clip", "frame"], "left")
    error = F.zip_with("points", "_p", apart)
    error = F.aggregate(error, F.lit(0.0), lambda s, x: s + x) / F.size("points")
    per = boxes.groupBy(*key).agg(F.count("*").alias("boxes"), F.min(F.struct(apart(F.col("centre"), F.col("_c")).alias("away"), "det", error.alias("error"))).alias("near"))
    tries = frames.join(per, key, "left")
    out = tries.groupBy("clip", "detector").agg(
        F.count("*").alias("frames"), F.count("boxes").alias("frames_with_face"), F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes_total"),
        F.round(F.avg("near.error"), 2).alias("landmark_err_px"), F.round(F.avg("ms"), 1).alias("ms"),
    )
    return out.withColumn("recall", F.round(F.col("frames_with_face") / F.col("frames"), 3))


def pose_pivot(rows: DataFrame, key: str, yaw: str, value: str, edges: tuple[float, float] = (8.0, 20.0)) -> DataFrame:
    """key, frontal, turned, profile: mean values by absolute yaw."""
    a = F.abs(F.col(yaw))
    bucket = F.when(a < edges[0], "frontal").when(a < edges[1], "turned").otherwise("profile")
    return rows.groupBy(key).pivot("bucket", ["frontal", "turned", "profile"]).agg(F.avg(value)) if "bucket" in rows.columns else pose_pivot(rows.withColumn("bucket", bucket), key, yaw, value, edges)


def stage_breakdown(rows: DataFrame, stage: str, seconds: Column, nested: Column) -> DataFrame:
    """stage, total, calls, share: nested stages are left out of the shares' total and have none."""
    per = rows.groupBy(stage, nested.alias("nested")).agg(F.sum(seconds).alias("total"), F.count("*").alias("calls"))
    wall = per.where("not nested").agg(F.sum("total").alias("wall"))
    return per.join(F.broadcast(wall), F.lit(True), "left").select(stage, "total", "calls", F.when(~F.col("nested"), F.col("total") / F.col("wall")).alias("share"))


#: Fixed value: metrics closer than this are the same.
SAME = 1e-9


def attributed(stages: DataFrame, whole: DataFrame) -> DataFrame:
    """stage, total, calls, ms_per_frame, pct_wall of each stage, and of `unattributed`, the wall time that no stage outside another accounts for.

    stages: stage, total (seconds), calls, nested; whole: one row of wall (seconds) and frames, of which either may be 0 and then has no share.
    """
    known = stages.agg(F.coalesce(F.sum(F.when(~F.col("nested"), F.col("total"))), F.lit(0.0)).alias("_known"))
    rest = whole.join(F.broadcast(known), F.lit(True)).select(F.lit("unattributed").alias("stage"), (F.col("wall") - F.col("_known")).alias("total"), F.lit(0).cast("long").alias("calls"))
    rows = stages.select("stage", "total", "calls").unionByName(rest).join(F.broadcast(whole), F.lit(True))
    ms, share = F.try_divide(F.col("total") * 1000.0, F.col("frames")), F.try_divide(F.col("total") * 100.0, F.col("wall"))
    return rows.select("stage", F.round("total", 3).alias("total"), "calls", F.round(ms, 2).alias("ms_per_frame"), F.round(share, 1).alias("pct_wall"))


def pairwise(rows: DataFrame, clip: str, engine: str, first: str, second: str, metrics: dict[str, bool]) -> DataFrame:
    """clip, metric, a, b, win (`first`, `second` or `tie`): two engines clip by clip (metric: more is better).

    Values closer than `SAME` tie; a clip or a metric that either lacks has no row.
    """
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(up).alias("up"), F.col(m).cast("double").alias("v")) for m, up in metrics.items()))
    long = rows.where(F.col(engine).isin(first, second)).select(clip, engine, F.explode(cells).alias("x")).select(clip, engine, "x.*")
    both = long.groupBy(clip, "metric", "up").agg(F.max(F.when(F.col(engine) == first, F.col("v"))).alias("a"), F.max(F.when(F.col(engine) == second, F.col("v"))).alias("b"))
    win = F.when(F.abs(F.col("a") - F.col("b")) < SAME, "tie").when((F.col("b") > F.col("a")) == F.col("up"), second).otherwise(first)
    return both.where("a is not null and b is not null").select(clip, "metric", "a", "b", win.alias("win"))


def no_worse(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """better, worse, same, passed: how often the second engine beats the first, and whether it is worse no more often than better."""
    count = lambda who: F.count(F.when(F.col("win") == who, 1))
    return pairs.agg(count(second).alias("better"), count(first).alias("worse"), count("tie").alias("same")).withColumn("passed", F.col("worse") <= F.col("better"))


def win_tally(aggregates: DataFrame, metrics: dict[str, bool], digits: int = 6) -> DataFrame:
    """candidate, wins, ties over metrics (name: more is better); a metric that any candidate lacks is skipped, equal values tie."""
    aggregates = cut(aggregates)  # a row a candidate, of which seven places below read
    n = aggregates.agg(F.count("*").alias("candidates"))
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.round(F.col(m) if up else -F.col(m), digits).alias("v")) for m, up in metrics.items()))
    long = aggregates.select("candidate", F.explode(cells).alias("x")).select("candidate", "x.*")
    tops = long.groupBy("metric").agg(F.max("v").alias("top"), F.count("v").alias("known")).join(F.broadcast(n), F.lit(True)).where("known = candidates")
    best = long.join(F.broadcast(tops), "metric").where("v = top")
    shared = best.groupBy("metric").agg(F.count("*").alias("winners"))
    tally = best.join(shared, "metric").groupBy("candidate").agg(F.sum(F.when(F.col("winners") == 1, 1).otherwise(0)).alias("wins"), F.sum(F.when(F.col("winners") > 1, 1).otherwise(0)).alias("ties"))
    return aggregates.select("candidate").join(tally, "candidate", "left").select("candidate", F.coalesce("wins", F.lit(0)).alias("wins"), F.coalesce("ties", F.lit(0)).alias("ties"))


def boundary_jump(rows: DataFrame, jump: str, at_boundary: Column) -> DataFrame:
    """Mean and maximum of jumps at boundaries and elsewhere, the 99th percentile elsewhere, and whether the largest boundary jump is within it.

    The jumps are written once; `percentiles` counts them, so no task holds all their distinct values.
    """
    b, e = F.when(at_boundary, F.col(jump)), F.when(~at_boundary, F.col(jump))
    known = cut(rows.select(F.lit(0).alias("_all"), b.cast("double").alias("b"), e.cast("double").alias("e")).where("b is not null or e is not null"))
    stats = known.agg(F.avg("b").alias("boundary_mean"), F.max("b").alias("boundary_max"), F.avg("e").alias("elsewhere_mean"), F.max("e").alias("elsewhere_max"))
    p99 = percentiles(known, ["_all"], "e", (0.99,), nan_last=True).select(F.col("p99").alias("elsewhere_p99"))
    return stats.join(F.broadcast(p99), F.lit(True), "left").withColumn("seamless", F.col("boundary_max") <= F.col("elsewhere_p99"))  # one row each


def against_control(rows: DataFrame, key: str, value: str, control: str, best: str) -> DataFrame:
    """key, mean, delta from the control, and how much of the gap from control to best it closes, in percent."""
    means = rows.groupBy(key).agg(F.avg(value).alias("mean"))
    one = lambda k, name: means.where(F.col(key) == k).select(F.col("mean").alias(name))
    ends = one(control, "low").join(F.broadcast(one(best, "high")), F.lit(True))
    joined = means.join(F.broadcast(ends), F.lit(True))
    gap = F.col("high") - F.col("low")
    return joined.select(key, "mean", (F.col("mean") - F.col("low")).alias("delta"), F.when(F.abs(gap) > 1e-9, (F.col("mean") - F.col("low")) / gap * 100).alias("recovered_pct"))


def recall_by_clip(rows: DataFrame, detector: str, clip: str, hit: Column) -> DataFrame:
    """detector, clip_mean (mean of the clips' recalls), pooled (recall of all frames), clips."""
    per = rows.groupBy(detector, clip).agg(F.avg(hit.cast("double")).alias("recall"), F.sum(hit.cast("long")).alias("hits"), F.count("*").alias("n"))
    return per.groupBy(detector).agg(F.avg("recall").alias("clip_mean"), (F.sum("hits") / F.sum("n")).alias("pooled"), F.count("*").alias("clips"))


def drift_verdicts(rows: DataFrame, old: str, new: str, low: float = 0.85, high: float = 1.15) -> DataFrame:
    better, worse = F.col(new) < F.col(old) * low, F.col(new) > F.col(old) * high
    return rows.agg(
        F.sum(better.cast("long")).alias("better"), F.sum(worse.cast("long")).alias("worse"), F.sum((~better & ~worse).cast("long")).alias("equivalent"),
        F.avg(old).alias("old_mean"), F.avg(new).alias("new_mean"), F.max(old).alias("old_worst"), F.max(new).alias("new_worst"),
    )


def matrix_status(expected: DataFrame, results: DataFrame, key: str, passed: str) -> DataFrame:
    """key, status of every expected row: PASS, FAIL (any failure) or MISSING."""
    per = results.groupBy(key).agg(F.min(F.col(passed).cast("int")).alias("ok"))
    return expected.select(key).distinct().join(per, key, "left").select(key, F.when(F.col("ok").isNull(), "MISSING").when(F.col("ok") == 1, "PASS").otherwise("FAIL").alias("status"))


def resources(rows: DataFrame, values: list[str], idle: Column) -> DataFrame:
    """Peak, mean and attributable peak (above the idle rows' mean) of each value."""
    out = []
    for v in values:
        out += [F.max(v).alias(f"{v}_peak"), F.avg(v).alias(f"{v}_mean"), (F.max(v) - F.avg(F.when(idle, F.col(v)))).alias(f"{v}_attributable")]
    return rows.agg(*out)


def weighted_stats(rows: DataFrame, key: list[str], value: str, mass: str, least: float = 16.0) -> DataFrame:
    """key..., mean, std of a value weighted by mass; null where the mass is under `least`."""
    s = rows.groupBy(*key).agg(F.sum(mass).alias("m"), F.sum(F.col(mass) * F.col(value)).alias("mx"), F.sum(F.col(mass) * F.col(value) * F.col(value)).alias("mxx"))
    mean = F.col("mx") / F.col("m")
    enough = F.col("m") >= least
    return s.select(*key, F.when(enough, mean).alias("mean"), F.when(enough, F.sqrt(F.greatest(F.col("mxx") / F.col("m") - mean * mean, F.lit(0.0)))).alias("std"))


#: Regions of a face and how much each matters.
REGION_IMPORTANCE = {"left_eye": 1.0, "right_eye": 1.0, "nose": 0.9, "mouth": 0.8, "left_cheek": 0.5, "right_cheek": 0.5, "forehead": 0.4, "chin": 0.4}


def visible_fraction(rows: DataFrame, visibility: str, yaw: str, importance: dict[str, float] | None = None, hidden_from: float = 22.0, occluded_below: float = 0.45) -> DataFrame:
    """Adds visible (importance-weighted) and occluded (sorted names); regions that the pose hides don't count."""
    importance = importance or REGION_IMPORTANCE
    weights = F.create_map(*(F.lit(x) for kv in importance.items() for x in kv))
    side = lambda name: F.array(F.lit(f"{name}_cheek"), F.lit(f"{name}_eye"))
    hidden = F.when(F.col(yaw) > hidden_from, side("left")).when(F.col(yaw) < -hidden_from, side("right")).otherwise(F.array().cast("array<string>"))
    seen = F.map_filter(visibility, lambda k, v: ~F.array_contains(hidden, k))
    entries = F.map_entries(seen)
    total = F.aggregate(entries, F.lit(0.0), lambda s, e: s + F.coalesce(weights[e["key"]], F.lit(0.0)))
    part = F.aggregate(entries, F.lit(0.0), lambda s, e: s + F.coalesce(weights[e["key"]], F.lit(0.0)) * e["value"])
    return rows.withColumn("visible", part / F.when(total == 0, 1.0).otherwise(total)).withColumn(
        "occluded", F.array_sort(F.map_keys(F.map_filter(seen, lambda k, v: v < occluded_below)))
    )


def rolled_up(segments: DataFrame, key: list[str], counters: list[str], means: list[str], frames: str) -> DataFrame:
    """Counters summed over segments, means weighted by frames (a sum of means would grow with the number of segments)."""
    return segments.groupBy(*key).agg(
        F.sum(frames).alias(frames), *(F.sum(c).alias(c) for c in counters), *((F.sum(F.col(m) * F.col(frames)) / F.sum(F.when(F.col(m).isNotNull(), F.col(frames)))).alias(m) for m in means)
    )
