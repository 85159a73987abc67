"""Scores, weights, gates and other scalar rules as JVM-side expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.vec import _col

#: The share of each term in the composite score.
WEIGHTS = {
    "identity": 0.30,
    "identity_worst": 0.14,
    "temporal": 0.18,
    "expression": 0.13,
    "blending": 0.13,
    "detail": 0.08,
    "identity_switches": 0.02,
    "speed": 0.02,
}
#: Term, metric, low end, high end, whether low is good, share within the term.
TERMS = (
    ("identity", "identity_mean", 0.30, 0.95, False, 1.0),
    ("identity_worst", "identity_min", 0.25, 0.93, False, 1.0),
    ("temporal", "identity_stability_mean", 0.80, 0.99, False, 0.5),
    ("temporal", "flow_flicker_mean", 2.0, 14.0, True, 0.3),
    ("temporal", "mask_jitter_mean", 0.01, 0.12, True, 0.2),
    ("expression", "expression_delta_mean", 0.010, 0.022, True, 1.0),
    ("blending", "seam_mean", 0.55, 1.45, True, 0.6),
    ("blending", "color_discontinuity_mean", 2.0, 22.0, True, 0.4),
    ("detail", "sharpness_mean", 60.0, 420.0, False, 0.5),
    ("detail", "texture_retention_mean", 0.45, 1.25, False, 0.5),
    ("speed", "ms_per_frame", 60.0, 1400.0, True, 1.0),
)
#: Pose bins of yaw, half-open.
POSE_BINS = (
    ("left_60+", -200.0, -52.0), ("left_45", -52.0, -37.0), ("left_30", -37.0, -22.0), ("left_15", -22.0, -8.0),
    ("frontal", -8.0, 8.0), ("right_15", 8.0, 22.0), ("right_30", 22.0, 37.0), ("right_45", 37.0, 52.0), ("right_60+", 52.0, 200.0),
)
#: Coarser bands, in the order in which they are filled.
POSE_BANDS = (
    ("frontal", -10.0, 10.0), ("left_mild", -28.0, -10.0), ("right_mild", 10.0, 28.0), ("left_strong", -80.0, -28.0), ("right_strong", 28.0, 80.0),
)
#: The five bins over which an identity's reach is told.
REACH_BINS = (("left_strong", -90.0, -28.0), ("left_mild", -28.0, -10.0), ("frontal", -10.0, 10.0), ("right_mild", 10.0, 28.0), ("right_strong", 28.0, 90.0))
#: Share of each stage of a job in its progress.
STAGE_WEIGHTS = (
    ("preparing", 0.02), ("analysing video", 0.02), ("benchmarking swap models", 0.05), ("testing restoration", 0.03), ("testing masks", 0.01),
    ("selecting best pipeline", 0.01), ("detecting", 0.01), ("processing", 0.80), ("encoding", 0.03), ("restoring audio", 0.02),
)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def clip_norm(value: Column | str, lo: float, hi: float, low_is_good: bool = False) -> Column:
    """Position of a value in [lo, hi] as 0..1; a missing value is 0 whichever end is good."""
    x = clip((_col(value) - lo) / max(hi - lo, 1e-6), 0.0, 1.0)
    x = 1.0 - x if low_is_good else x
    return F.when(_col(value).isNull(), 0.0).otherwise(x)


def contributions(has_min: bool = True) -> dict[str, Column]:
    """Each term's part of the composite score, over columns named as in `TERMS` and identity_switches.

    Where an input has no identity_min column at all, the mean stands in for
    it; a null identity_min counts as 0.
    """
    parts: dict[str, Column] = {}
    for term, metric, lo, hi, low_is_good, share in TERMS:
        metric = "identity_mean" if metric == "identity_min" and not has_min else metric
        x = clip_norm(metric, lo, hi, low_is_good) * share
        parts[term] = parts[term] + x if term in parts else x
    parts["identity_switches"] = F.when(F.coalesce(F.col("identity_switches"), F.lit(0)) == 0, 1.0).otherwise(0.0)
    return {k: F.round(parts[k] * w, 5) for k, w in WEIGHTS.items()}


def composite(has_min: bool = True) -> Column:
    return F.round(reduce(lambda a, b: a + b, contributions(has_min).values()), 5)


def finite(x: Column | str) -> Column:
    """The value, or null if it is NaN or infinite."""
    x = _col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def gate(size: float = 80.0, confidence: float = 0.55, sharpness: float = 40.0, dark: float = 25.0, bright: float = 235.0) -> Column:
    """The first reason to reject an observation, or null; columns face_px, detector_conf, sharpness, exposure."""
    return (
        F.when(F.col("face_px") < size, "face too small")
        .when(F.col("detector_conf") < confidence, "low detector confidence")
        .when(F.col("sharpness") < sharpness, "blurred")
        .when(~F.col("exposure").between(dark, bright), "exposure")
    )


def pose_factor(yaw: Column | str) -> Column:
    return 0.4 + 0.6 * F.exp(-F.abs(_col(yaw)) / 45.0)


def _common() -> Column:
    return F.least(F.lit(1.0), F.col("face_px") / 160.0) * clip(F.col("detector_conf"), 0.0, 1.0)


def _sharp() -> Column:
    return F.least(F.lit(1.0), F.col("sharpness") / 120.0)


def _exposed(mid: float, span: float) -> Column:
    return clip(1.0 - F.abs(F.col("exposure") - mid) / span, 0.05, 1.0)


def quality(kind: str = "observation") -> Column:
    """Usefulness of an observation, 0.001 at least.

    `base` knows size, confidence and sharpness; `observation` adds exposure;
    `photo` adds pose to base; `evidence` adds exposure, clipping, visibility
    (columns clipped_high, clipped_low, visible_fraction) and pose.
    """
    x = _common() * _sharp()
    if kind == "observation":
        x = x * _exposed(130.0, 110.0)
    elif kind == "photo":
        x = x * pose_factor("yaw")
    elif kind == "evidence":
        clipped = clip(1.0 - (F.col("clipped_high") + F.col("clipped_low")) * 3.0, 0.1, 1.0)
        x = x * _exposed(128.0, 118.0) * clipped * (0.25 + 0.75 * clip(F.col("visible_fraction"), 0.0, 1.0)) * pose_factor("yaw")
    elif kind != "base":
        raise ValueError(kind)
    return F.greatest(F.lit(1e-3), x)


def binned(value: Column | str, bins=POSE_BINS) -> Column:
    """Name of the first half-open bin that holds the value, or null."""
    v = _col(value)
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(bins):
        out = F.when((v >= lo) & (v < hi), name).otherwise(out)
    return out


def pose_kernel(distance: Column, sigma: float = 18.0) -> Column:
    return F.exp(-F.pow(distance, 2) / (2.0 * sigma * sigma))


def adaptive_blend(blend: Column, face_px: Column) -> Column:
    """Restoration blend by face size: less on small faces, a little more on large ones."""
    return F.when(face_px < 64, blend * 0.35).when(face_px < 128, blend * 0.65).when(face_px > 400, F.least(F.lit(1.0), blend * 1.15)).otherwise(blend)


def human_duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    part = lambda n: F.floor(n).cast("string")
    return (
        F.when(s < 90, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 5400, F.concat(part(s / 60), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(part(s / 3600), F.lit("h "), part((s % 3600) / 60), F.lit("m")))
    )


def overall_progress(stage: Column, percent: Column) -> Column:
    """A stage's percentage on the bar of the whole job, 99.9 at most; an unknown stage passes through."""
    out, before = percent, 0.0
    for name, weight in STAGE_WEIGHTS:
        out = F.when(stage == name, F.least(F.lit(99.9), (before + weight * (percent / 100.0)) * 100.0)).otherwise(out)
        before += weight
    return out


def safe_name(name: Column) -> Column:
    """A file name with other characters than word characters, dot and dash replaced, its last 80 characters."""
    return F.right(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), F.lit(80))


def rational(text: Column, default: Column) -> Column:
    """The value of "num/den"; the default where it can't be read or the denominator is 0."""
    parts = F.split(text, "/")
    return F.coalesce(F.try_divide(F.try_element_at(parts, F.lit(1)).try_cast("double"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("1")).try_cast("double")), default)


def detector_size(width: Column, height: Column) -> Column:
    """Input size of a detector for a frame, by its longest side."""
    longest = F.greatest(width, height)
    return F.when(longest >= 2160, 1280).when(longest >= 1440, 1024).when(longest >= 1080, 960).otherwise(640)


def resolved_range(duration: Column, start: Column, end: Column) -> tuple[Column, Column, Column]:
    """Start, end and whether they cut the clip: missing or 0 ends are the clip's, bounds stay within it."""
    first = F.greatest(F.lit(0.0), F.coalesce(start, F.lit(0.0)))
    last = F.when(F.coalesce(end, F.lit(0.0)) > 0, F.least(end, duration)).otherwise(duration)
    span = F.greatest(F.lit(0.0), last - first)
    return first, last, (first > 0) | ((span > 0) & (duration > 0) & (span < duration - 1e-3))


def remaining_seconds(frames: Column, total: Column, fps: Column) -> Column:
    return (total - frames) / F.greatest(fps, F.lit(1e-6))


def config_label(swapper: Column, enhancer: Column, blend: Column, mask: Column, color_match: Column, boost: Column) -> Column:
    """One line for a candidate's settings."""
    sharpened = F.when(enhancer.isNull(), "no-enhance").otherwise(F.concat(enhancer, F.lit("@"), F.floor(blend * 100).cast("string"), F.lit("%")))
    return F.concat_ws(
        " / ", swapper, sharpened, F.concat(F.lit("mask:"), mask), F.when(~color_match, "no-colour-match"), F.when(boost > 0, F.concat(F.lit("boost:"), boost.cast("string")))
    )


#: Parts of messages that mean the card is out of memory.
OUT_OF_MEMORY = ("out of memory", "cudnn_status_alloc_failed", "cublas")


def error_class(message: Column) -> Column:
    text = F.lower(message)
    memory = F.lit(False)
    for part in OUT_OF_MEMORY:
        memory = memory | text.contains(part)
    return F.when(message.isNull(), None).when(memory, "insufficient memory").otherwise("failed")


def source_kind(name: Column) -> Column:
    """`video` for names with a time ("clip@12.5"), else `photo`."""
    return F.when(name.contains("@"), "video").otherwise("photo")


def source_time(name: Column) -> Column:
    """Seconds behind the `@` of a video source's name ("clip@12.5"); null for a photo, and for what is no number."""
    return F.regexp_extract(name, "@([^@]*)$", 1).try_cast("double")


def range_error(first: Column, last: Column) -> Column:
    """What is wrong with a resolved range, or null: one that begins within a clip must end after it."""
    return F.when((first > 0) & (last <= first), "range is empty")


def audio_seconds(requested: Column, frames: Column, fps: Column, margin: float = 0.05) -> Column:
    """How much sound goes with a rendered part: its real length where that is longer than what was asked for, and a margin; null (all of it) without a request."""
    rendered = F.when((frames > 0) & (fps > 0), frames / fps)
    return F.when(requested > 0, F.round(F.greatest(requested, rendered) + margin, 6))


#: Limits of a colour gain and shift, and the strength of each on lightness and on the two colour axes.
GAIN_LIMITS, SHIFT_LIMIT, LIGHT_STRENGTH, COLOUR_STRENGTH = (0.6, 1.6), 28.0, 1.0, 0.65


def colour_correction(own_mean: Column, own_std: Column, want_mean: Column, want_std: Column, strength: float) -> tuple[Column, Column]:
    """Gain and shift that bring one channel's statistics to another's."""
    gain = clip(want_std / F.greatest(own_std, F.lit(1e-3)), *GAIN_LIMITS)
    return 1.0 + (gain - 1.0) * strength, clip(want_mean - own_mean * gain, -SHIFT_LIMIT, SHIFT_LIMIT) * strength


def letterboxed(width: Column, height: Column, size: Column) -> tuple[Column, Column, Column]:
    """Scale, width and height of a frame that fits a square, sides of 1 at least."""
    scale = F.least(size / width, size / height)
    side = lambda x: F.greatest(F.lit(1), F.bround(x * scale).cast("long"))
    return scale, side(width), side(height)


def visibility(chroma_distance: Column, texture: Column, luminance: Column) -> Column:
    """How surely a region shows skin, by its weakest sign: colour near the face's, texture, and light neither crushed nor blown."""
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    light = F.least(luminance - 18.0, F.lit(246.0) - luminance)
    return F.least(unit(1.0 - (chroma_distance - 6.0) / 22.0), F.greatest(unit(texture / 45.0), F.lit(0.35)), unit(light / 28.0))


#: Pipelines by the name of a preset: swapper, mask, colour match, whether parsing and occlusion are used.
PRESETS = {
    **dict.fromkeys(("max", "quality", "balanced"), ("alphaface_256", "model", True, True, True)), "fast": ("hyperswap_1a_256", "model", False, False, False),
}
AUTO_NEEDS_BENCHMARK = "auto needs the winner of a benchmark"


def preset(quality: Column, winner: Column | None = None) -> Column:
    """struct(swapper, enhancer, mask, color_match, use_parsing, use_occlusion, error): a given winner, else what the preset names; unknown names are `max`.

    `auto` without a winner gives no pipeline but an error: a default would pass for a benchmark's result.
    """
    none = F.lit(None).cast("string")
    field = lambda i: F.coalesce(*(F.when(quality == name, F.lit(v[i])) for name, v in PRESETS.items()), F.lit(PRESETS["max"][i]))
    auto = (quality == "auto") & (winner.isNull() if winner is not None else F.lit(True))
    ok = lambda c: F.when(~F.coalesce(auto, F.lit(False)), c)
    swapper = F.coalesce(winner, field(0)) if winner is not None else field(0)
    return F.struct(
        ok(swapper).alias("swapper"), none.alias("enhancer"), ok(field(1)).alias("mask"), ok(field(2)).alias("color_match"), ok(field(3)).alias("use_parsing"), ok(field(4)).alias("use_occlusion"),
        F.when(auto, AUTO_NEEDS_BENCHMARK).alias("error"),
    )


def summary_line(photos: Column, video_refs: Column, bins: Column) -> Column:
    """What a reference bank holds, in one line: photos, video references if any, and the pose bins covered."""
    first = F.concat(photos.cast("string"), F.lit(" photos analyzed"))
    second = F.when(video_refs > 0, F.concat(video_refs.cast("string"), F.lit(" video references selected")))
    names = F.array_join(F.transform(bins, lambda b: F.replace(b, F.lit("_"), F.lit(" "))), ", ")
    return F.concat(F.concat_ws(", ", first, second), F.lit(" | coverage: "), F.when(names == "", "none").otherwise(names))

