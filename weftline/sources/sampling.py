"""Which frames of a clip to read: index sets as tables, for semi-joins against a frame table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def even_indices(clips: DataFrame, key: str, total: str, want: int, truncate: bool = False) -> DataFrame:
    """key, frame: `want` evenly spaced indices of 0 .. total - 1, rounded (half to even) without repeats, or truncated. One row a clip.

    Indices repeat only within their own clip, so they are made distinct before they are rows: nothing is shuffled.
    """
    n = F.col(total)
    k = F.least(F.lit(want), n)
    at = lambda i: i * (n - 1) / F.greatest(k - 1, F.lit(1))
    index = lambda i: (F.floor(at(i)) if truncate else F.bround(at(i))).cast("long")
    return clips.where(n > 0).select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), index))).alias("frame"))


def stride_step(fps: Column, per_second: float) -> Column:
    return F.greatest(F.lit(1), F.bround(fps / per_second)).cast("long")


def stride_indices(clips: DataFrame, key: str, total: str, fps: str, per_second: float, most: int) -> DataFrame:
    """key, frame: every step-th index, the first `most` of them: long clips are only read at their start."""
    step = stride_step(F.col(fps), per_second)
    last = F.least((F.col(total) - 1).cast("long"), (most - 1) * step)
    return clips.where(F.col(total) > 0).select(key, F.explode(F.sequence(F.lit(0).cast("long"), last, step)).alias("frame"))


def conditional_indices(clips: DataFrame, key: str, total: str, all_up_to: int = 80, want: int = 60) -> DataFrame:
    """key, frame: all of a short clip, else one in total // want."""
    n = F.col(total).cast("long")
    step = F.when(n <= all_up_to, F.lit(1).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(n / want)))
    return clips.where(n > 0).select(key, F.explode(F.sequence(F.lit(0).cast("long"), n - 1, step)).alias("frame"))


def read_indices(frames: DataFrame, indices: DataFrame, key: list[str]) -> DataFrame:
    """The frames with a wanted index."""
    return frames.join(indices, key, "left_semi")
