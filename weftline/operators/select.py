"""Candidates: aggregates of frame metrics, scores, guards, samples and staged choice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import score

#: Frame metric and name of its mean in an aggregate.
MEANS = {
    "identity": "identity_mean", "identity_stability": "identity_stability_mean", "expression_delta": "expression_delta_mean",
    "landmark_delta": "landmark_delta_mean", "seam": "seam_mean", "color_discontinuity": "color_discontinuity_mean", "sharpness": "sharpness_mean",
    "texture_retention": "texture_retention_mean", "mask_jitter": "mask_jitter_mean", "flow_flicker": "flow_flicker_mean", "ms": "ms_per_frame",
}


def summary(value: Column, name: str, digits: int = 5) -> list[Column]:
    """Mean, min, max, population deviation and number of the finite values."""
    v = score.finite(value)
    return [
        F.bround(F.avg(v), digits).alias(f"{name}_mean"), F.bround(F.min(v), digits).alias(f"{name}_min"), F.bround(F.max(v), digits).alias(f"{name}_max"),
        F.bround(F.stddev_pop(v), digits).alias(f"{name}_std"), F.count(v).alias(f"{name}_n"),
    ]


def aggregate(frames: DataFrame, switch_below: float = 0.45) -> DataFrame:
    """One row a candidate: means over frames without error, the worst identity, switches, frames measured and failed."""
    ok = F.col("error").isNull()
    measured = lambda c: score.finite(F.when(ok, F.col(c)))
    return frames.groupBy("candidate").agg(
        *(F.round(F.avg(measured(c)), 5).alias(name) for c, name in MEANS.items()),
        F.round(F.min(measured("identity")), 5).alias("identity_min"),
        F.sum(F.when(ok & (F.col("identity_stability") < switch_below), 1).otherwise(0)).alias("identity_switches"),
        F.sum(ok.cast("long")).alias("frames_measured"), F.sum((~ok).cast("long")).alias("frames_failed"),
    )


def scored(aggregates: DataFrame) -> DataFrame:
    parts = score.contributions()
    return aggregates.select("*", *(c.alias(f"part_{k}") for k, c in parts.items())).withColumn("score", F.round(reduce(lambda a, b: a + b, (F.col(f"part_{k}") for k in parts)), 5))


def guarded(candidates: DataFrame, is_bare: Column, max_loss: float = 0.04) -> DataFrame:
    """Adds eligible: bare candidates are, others unless they lose more identity than `max_loss` to the best bare one; unknown passes."""
    # All candidates are one small window: what they were aggregated from is read once.
    whole = Window.orderBy(F.when(is_bare, 0).otherwise(1), F.desc("score"), "candidate").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = candidates.withColumn("bare_identity", F.first(F.when(is_bare, F.col("identity_mean"))).over(whole))
    return known.withColumn("eligible", is_bare | F.coalesce(F.col("bare_identity") - F.col("identity_mean") <= max_loss, F.lit(True)))


def winner(candidates: DataFrame) -> DataFrame:
    """The best eligible candidate, or the best of all if none is; candidates that failed have a negative score."""
    return candidates.where("score >= 0").orderBy(F.desc("eligible"), F.desc("score"), "candidate").limit(1)


#: Traits of a hard frame, and whether the most of it is hard.
TRAITS = (("yaw", True), ("blur", False), ("face_size", True), ("face_size", False), ("brightness", False), ("brightness", True), ("n_faces", True))


def stratified_sample(frames: DataFrame, each: int = 2, want: int = 14) -> DataFrame:
    """The `each` hardest frames of every trait, filled in frame order to `want`; columns frame, reason.

    One pass over the frames: each batch gives its own `each` hardest of every trait and its
    first frames, and what all batches give is ranked once more.
    """
    fill = len(TRAITS)
    wanted = [*((t, most, each) for t, most in TRAITS), ("frame", False, want + each * len(TRAITS))]

    def hardest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.column("frame")
            for reason, (trait, most, n) in enumerate(wanted):
                value = pc.cast(batch.column(trait), pa.float64())
                order = pc.sort_indices(pa.table({"v": value, "f": frame}), [("v", "descending" if most else "ascending"), ("f", "ascending")], null_placement="at_end" if most else "at_start").slice(0, n)
                v = value.take(order)
                yield pa.RecordBatch.from_arrays([frame.take(order), pa.array([reason] * len(order), pa.int32()), pc.negate(v) if most else v], names=["frame", "reason", "hard"])

    columns = list(dict.fromkeys(["frame", *(t for t, _ in TRAITS)]))
    found = frames.select(*(F.col(c).cast("long" if c == "frame" else "double") for c in columns)).mapInArrow(hardest, "frame long, reason int, hard double")
    nulls = F.when(F.col("reason").isin([i for i, (_, most) in enumerate(TRAITS) if most]), F.col("hard").isNull().cast("int")).otherwise(-F.col("hard").isNull().cast("int"))
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("reason").orderBy(nulls, "hard", "frame")))
    kept = ranked.where((F.col("r") <= each) | ((F.col("reason") == fill) & (F.col("r") <= want + each * len(TRAITS))))
    both = kept.groupBy("frame").agg(F.min("reason").alias("reason"))
    return both.orderBy(F.col("reason") == fill, "frame").limit(want)


def staged(candidates: DataFrame) -> DataFrame:
    """Adds stage: 1 for bare candidates, 2 for variants of the best bare swapper, 3 for variants of the leader after that.

    Columns: candidate, swapper, variant (null, `enhancer` or `mask`), score. Other variants get no stage: they would not be measured.
    """
    def best(among: Column) -> Column:
        whole = Window.orderBy(F.when(among, 0).otherwise(1), F.desc("score"), "candidate").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.first(F.when(among, F.col("swapper"))).over(whole)

    bare = F.col("variant").isNull()
    second = candidates.withColumn("lead", best(bare)).withColumn("stage", F.when(bare, 1).when((F.col("variant") == "enhancer") & (F.col("swapper") == F.col("lead")), 2))
    return second.withColumn("leader", best(F.col("stage").isNotNull())).withColumn(
        "stage", F.coalesce("stage", F.when((F.col("variant") == "mask") & (F.col("swapper") == F.col("leader")), 3))
    ).drop("lead", "leader")


#: Mask modes, and the score of a candidate that failed.
MASKS, FAILED = ("model", "parsing", "full"), -1.0


def variants(winners: DataFrame, measured: DataFrame, key: list[str], masks=MASKS) -> DataFrame:
    """The candidates of the refining stage: each winner (key..., label, mask, color_match and other settings) under other masks, and without colour matching if it has it.

    They are made here and stand in no table; those whose label is measured already are left out.
    """
    change = lambda name, mask, colour: F.struct(F.lit(name).alias("name"), F.lit(mask).alias("mask"), F.lit(colour).alias("color_match"))
    changes = [F.when(~F.col("mask").eqNullSafe(m), change(f"mask:{m}", m, None)) for m in masks]
    changes.append(F.when(F.coalesce("color_match", F.lit(True)), change("no colour match", None, False)))
    made = winners.withColumn("_change", F.explode(F.array_compact(F.array(*changes))))
    made = made.withColumn("label", F.concat("label", F.lit(" / "), "_change.name"))
    made = made.withColumn("mask", F.coalesce("_change.mask", "mask")).withColumn("color_match", F.coalesce("_change.color_match", "color_match")).drop("_change")
    return made.join(measured.select(*key, "label").distinct(), [*key, "label"], "left_anti")


def refined(winners: DataFrame, measured: DataFrame, key: list[str], measure: Callable[[DataFrame], DataFrame], masks=MASKS) -> DataFrame:
    """`variants` with score, failed and better (than their winner). measure adds score to candidates, null for what couldn't be measured, which scores `FAILED`."""
    before = winners.select(*key, F.col("score").alias("_before"))
    found = measure(variants(winners.drop("score"), measured, key, masks)).join(before, key)
    found = found.withColumn("failed", F.col("score").isNull()).withColumn("score", F.coalesce("score", F.lit(FAILED)))
    return found.withColumn("better", F.col("score") > F.col("_before")).drop("_before")


def calibration(rows: DataFrame, value: str, same: Column) -> DataFrame:
    """Means and extremes of both classes, the threshold between the means, d-prime, and whether the classes part cleanly."""
    a, b = F.when(same, F.col(value)), F.when(~same, F.col(value))
    stats = rows.agg(
        F.avg(a).alias("same_mean"), F.min(a).alias("same_min"), F.avg(b).alias("other_mean"), F.max(b).alias("other_max"),
        F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"),
    )
    return stats.select(
        "same_mean", "same_min", "other_mean", "other_max", ((F.col("same_mean") + F.col("other_mean")) / 2).alias("threshold"),
        ((F.col("same_mean") - F.col("other_mean")) / F.sqrt(F.greatest((F.col("va") + F.col("vb")) / 2, F.lit(1e-12)))).alias("d_prime"),
        (F.col("same_min") > F.col("other_max")).alias("clean_split"),
    )


def best_per(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; the caller's order must end in an ordinal for ties."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def ladder(threshold: float, second: bool = True, fast: bool = False) -> list[tuple[int, float]]:
    """(detector, threshold) in the order in which a frame is tried: as asked, more sensitively, then the same with a second detector."""
    retry = lambda d, t: [(d, t)] if fast else [(d, t), (d, max(0.25, 0.6 * t))]
    return retry(1, threshold) + (retry(2, max(0.25, 0.7 * threshold)) if second else [])


def tiered(rows: DataFrame, key: str, value: str, detector: str, steps: list[tuple[int, float]]) -> DataFrame:
    """Rows over (not at) the threshold of the first step that any row of their key and the step's detector passes, with its number as tier; a key that passes none has no row."""
    passes = lambda d, t: (F.col(detector) == d) & (F.col(value) > t)
    first = F.coalesce(*(F.when(passes(*step), i) for i, step in enumerate(steps, 1)))
    tiers = rows.groupBy(key).agg(F.min(first).alias("tier")).where("tier is not null")
    kept = reduce(lambda a, b: a | b, ((F.col("tier") == i) & passes(*step) for i, step in enumerate(steps, 1)))
    return rows.join(tiers, key).where(kept)
