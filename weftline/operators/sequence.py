"""Ordered series: differences, runs, shots, smoothing and cuts, per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import fold, geo


def over(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


def deltas(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Adds delta, the absolute difference from the row before; null on a key's first row."""
    return rows.withColumn("delta", F.abs(F.col(value) - F.lag(value).over(over(key, order))))


def shots(rows: DataFrame, key: list[str], order: list[str], cut: str) -> DataFrame:
    """Adds shot: the number of cuts so far, the row's own included."""
    return rows.withColumn("shot", F.sum(F.col(cut).cast("long")).over(over(key, order).rowsBetween(Window.unboundedPreceding, 0)))


def runs(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Adds repeated: whether the value equals the one before."""
    return rows.withColumn("repeated", F.coalesce(F.col(value) == F.lag(value).over(over(key, order)), F.lit(False)))


def _folded(rows: DataFrame, key: list[str], order: list[str], fields: list[str], what, name: str) -> DataFrame:
    """key..., order..., fields..., name: a fold over each key's ordered rows."""
    lists = rows.groupBy(*key).agg(fold.ordered(order, fields).alias("rows"))
    zipped = F.arrays_zip(F.col("rows").alias("row"), what.alias("value"))
    names = list(dict.fromkeys([*order, *fields]))
    return lists.select(*key, F.explode(zipped).alias("z")).select(*key, *(F.col(f"z.row.{c}").alias(c) for c in names), F.col("z.value").alias(name))


def ema(rows: DataFrame, key: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """Smoothed series; key should hold the shot, at which smoothing restarts."""
    return _folded(rows, key, order, [value], fold.ema("rows", value, alpha), "smoothed")


def adaptive_ema(rows: DataFrame, key: list[str], order: list[str], value: str, alpha: float = 0.6, scale: float = 6.0) -> DataFrame:
    return _folded(rows, key, order, [value], fold.adaptive_ema("rows", value, alpha, scale), "smoothed")


def spikes(rows: DataFrame, key: list[str], order: list[str], value: str, floor: float = 8.0, ratio: float = 3.0, window: int = 24, warmup: int = 3) -> DataFrame:
    """Adds baseline and spike by a plain window: as `scene_cuts`, but history doesn't restart at a cut."""
    back = over(key, order).rowsBetween(-window, -1)
    return (
        rows.withColumn("baseline", F.expr(f"percentile({value}, 0.5)").over(back))
        .withColumn("spike", (F.count(value).over(back) >= warmup) & (F.col(value) >= floor) & (F.col(value) >= ratio * F.greatest("baseline", F.lit(1.0))))
    )


def switches(rows: DataFrame, key: list[str], order: list[str], similarity: Column, below: float) -> DataFrame:
    """key, switches: consecutive rows whose similarity is below the limit."""
    return rows.withColumn("s", similarity).groupBy(*key).agg(F.sum(F.when(F.col("s") < below, 1).otherwise(0)).alias("switches"))


def steps(rows: DataFrame, key: list[str], order: list[str], time: Column) -> DataFrame:
    """key, shortest, longest, usual, kinds of the steps between neighbouring times; the usual one is the most frequent, the least of equals."""
    step = rows.withColumn("t", time).withColumn("step", F.col("t") - F.lag("t").over(over(key, order))).where("step is not null")
    counts = step.groupBy(*key, "step").count()
    return counts.groupBy(*key).agg(
        F.min("step").alias("shortest"), F.max("step").alias("longest"), F.max_by("step", F.struct("count", -F.col("step"))).alias("usual"), F.count("*").alias("kinds")
    )


def nearest_alike(rows: DataFrame, key: list[str], similarity: str, where: Column | None, diagonal: float, share: float = 0.35, floor: float = 0.15) -> DataFrame:
    """One row a key, with value: the detection (det, box) most like the person, `share` of its nearness to where they were last seen added.

    det is null where even the best stays under the floor: everyone there is someone else. Without a place only similarity
    counts; rows without a similarity are left out, and if the column is absent, no person is known yet, the largest box is taken.
    """
    if similarity not in rows.columns:
        first = Window.partitionBy(*key).orderBy(F.desc(geo.area("box")), "det")
        return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").withColumn("value", F.lit(None).cast("double")).drop("_r")
    near = F.lit(0.0)
    if where is not None and diagonal > 0:
        middle = geo.centre("box")
        near = 1.0 - F.least(F.lit(1.0), F.sqrt(F.pow(middle[0] - where[0], 2) + F.pow(middle[1] - where[1], 2)) / diagonal)
    best = Window.partitionBy(*key).orderBy(F.desc("value"), "det")
    ranked = rows.where(F.col(similarity).isNotNull()).withColumn("value", F.round(F.col(similarity) + share * near, 6)).withColumn("_r", F.row_number().over(best))
    return ranked.where("_r = 1").withColumn("det", F.when(F.col("value") >= floor, F.col("det"))).drop("_r")


def identity_jitter(rows: DataFrame, key: list[str], order: list[str], embedding: str, drift: Column) -> DataFrame:
    """key..., identity_jitter (mean of 1 - cosine of neighbouring frames, null for one frame), drift (mean of what is finite), n."""
    from weftline.functions import score, vec

    before = F.lag(embedding).over(over(key, order))
    step = rows.select(*key, (1.0 - vec.cosine(embedding, before)).alias("step"), score.finite(drift).alias("drift"))
    return step.groupBy(*key).agg(F.avg("step").alias("identity_jitter"), F.avg("drift").alias("drift"), F.count("*").alias("n"))
