"""Boxes (x1, y1, x2, y2), landmark arrays and angles as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.vec import _col


def area(box: Column | str) -> Column:
    b = _col(box)
    return (b[2] - b[0]) * (b[3] - b[1])


def centre(box: Column | str) -> Column:
    b = _col(box)
    return F.array((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)


def size(box: Column | str) -> Column:
    """Geometric mean of the sides, each 1 at least."""
    b = _col(box)
    return F.sqrt(F.greatest(b[2] - b[0], F.lit(1.0)) * F.greatest(b[3] - b[1], F.lit(1.0)))


def iou(p: Column | str, q: Column | str) -> Column:
    """Intersection over union; 0 without overlap."""
    a, b = _col(p), _col(q)
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    both = side(0, 2) * side(1, 3)
    return F.when(both <= 0, 0.0).otherwise(both / F.greatest(area(a) + area(b) - both, F.lit(1e-6)))


def moved(box: Column | str, velocity: Column | str) -> Column:
    """The box where constant velocity takes it."""
    b, v = _col(box), _col(velocity)
    return F.array(b[0] + v[0], b[1] + v[1], b[2] + v[0], b[3] + v[1])


#: Shares of identity, overlap, motion and scale in a match, and the decay of the last two.
MATCH_SHARES = (0.60, 0.18, 0.14, 0.08)
MOTION_DECAY, SCALE_DECAY = 8.0, 1.5


def match_score(identity: Column, overlap: Column, distance: Column, ratio: Column) -> Column:
    """How well a detection fits a track; distance is relative to the frame's diagonal, ratio compares sizes."""
    w = MATCH_SHARES
    motion = F.exp(-distance * MOTION_DECAY)
    scale = F.exp(-F.abs(F.log(F.greatest(ratio, F.lit(1e-3)))) * SCALE_DECAY)
    return w[0] * F.coalesce(identity, F.lit(0.0)) + w[1] * overlap + w[2] * motion + w[3] * scale


def _mean_distance(a: Column, b: Column) -> Column:
    apart = F.zip_with(a, b, lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2)))
    return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x) / F.size(apart)


def landmark_delta(before: Column | str, after: Column | str, face_size: Column | str) -> Column:
    """Mean movement of points over the face's size (1 at least); 0 where the numbers of points differ."""
    a, b = _col(before), _col(after)
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(_mean_distance(a, b) / F.greatest(_col(face_size), F.lit(1.0)))


def shape(points: Column | str) -> Column:
    """Points less their mean, over the root of their summed squares (1 if that is 0)."""
    p = _col(points)
    mean = lambda f: F.aggregate(p, F.lit(0.0), lambda s, x: s + x[f]) / F.size(p)
    mx, my = mean("x"), mean("y")
    square = F.aggregate(p, F.lit(0.0), lambda s, q: s + F.pow(q["x"] - mx, 2) + F.pow(q["y"] - my, 2))
    scale = F.when(square == 0, 1.0).otherwise(F.sqrt(square))
    return F.transform(p, lambda q: F.struct(((q["x"] - mx) / scale).alias("x"), ((q["y"] - my) / scale).alias("y")))


def expression_delta(before: Column | str, after: Column | str) -> Column:
    """Mean movement of points after position and scale are removed."""
    return _mean_distance(shape(before), shape(after))


def unwrap(angle: Column | str) -> Column:
    """Signed deviation from upright in degrees: an angle near 180 is one near 0 seen from the other side."""
    a = F.pmod(_col(angle), F.lit(360.0))
    d = F.when(a > 180, a - 360).otherwise(a)
    return F.when(d > 90, d - 180).when(d < -90, d + 180).otherwise(d) + 0.0  # no negative zero


def pose_proxy(points: Column | str) -> tuple[Column, Column]:
    """(yaw, roll) in degrees from landmarks whose first three are left eye, right eye and nose."""
    p = _col(points)
    dx, dy = p[1]["x"] - p[0]["x"], p[1]["y"] - p[0]["y"]
    apart = F.sqrt(dx * dx + dy * dy)
    yaw = (p[2]["x"] - (p[0]["x"] + p[1]["x"]) / 2) / F.when(apart == 0, 1.0).otherwise(apart) * 90.0
    return yaw, F.degrees(F.atan2(dy, dx))


def mouth_shape(points: Column | str) -> tuple[Column, Column, Column]:
    """Width, opening and skew against the eyes from left eye, right eye, nose and both mouth corners; lengths relative to the eyes' distance."""
    p = _col(points)
    far = lambda ax, ay, bx, by: F.sqrt(F.pow(bx - ax, 2) + F.pow(by - ay, 2))
    eyes = far(p[0]["x"], p[0]["y"], p[1]["x"], p[1]["y"])
    eyes = F.when(eyes == 0, 1.0).otherwise(eyes)
    tilt = lambda a, b: F.degrees(F.atan2(p[b]["y"] - p[a]["y"], p[b]["x"] - p[a]["x"]))
    opening = far(p[2]["x"], p[2]["y"], (p[3]["x"] + p[4]["x"]) / 2, (p[3]["y"] + p[4]["y"]) / 2)
    return far(p[3]["x"], p[3]["y"], p[4]["x"], p[4]["y"]) / eyes, opening / eyes, F.abs(tilt(0, 1) - tilt(3, 4))


def landmark_motion(before: Column | str, after: Column | str) -> Column:
    """Mean movement of points relative to the eyes' distance afterwards; 0 without a frame before."""
    p = _col(after)
    eyes = F.sqrt(F.pow(p[1]["x"] - p[0]["x"], 2) + F.pow(p[1]["y"] - p[0]["y"], 2))
    return F.coalesce(_mean_distance(_col(before), p) / F.when(eyes == 0, 1.0).otherwise(eyes), F.lit(0.0))


def region_of_interest(corners: Column | str, width: Column | int, height: Column | int) -> Column:
    """Box (x0, y0, x1, y1) of whole pixels around mapped corners (an array of x, y), a pixel wider on each side and clipped to the frame; null outside it."""
    p = _col(corners)
    side = lambda axis, pick: pick(F.transform(p, lambda c: c[axis]))
    lo = lambda axis: F.greatest(F.lit(0), F.floor(side(axis, F.array_min)) - 1).cast("int")
    hi = lambda axis, end: F.least(F.lit(end) if isinstance(end, int) else end, F.ceil(side(axis, F.array_max)) + 1).cast("int")
    box = F.array(lo("x"), lo("y"), hi("x", width), hi("y", height))
    return F.when((box[2] > box[0]) & (box[3] > box[1]), box)


def mapped(corners: Column | str, affine: Column | str) -> Column:
    """Corners (x, y) under an affine map, an array of its two rows of three."""
    m = _col(affine)
    return F.transform(_col(corners), lambda c: F.struct((m[0] * c["x"] + m[1] * c["y"] + m[2]).alias("x"), (m[3] * c["x"] + m[4] * c["y"] + m[5]).alias("y")))


def anchor_centre(index: Column, feature_width: Column | int, stride: Column | int, anchors: int = 1) -> Column:
    """Centre of anchor `index` of a feature map, in pixels of the input; `anchors` share each cell."""
    cell = F.floor(index / anchors)
    return F.struct(((cell % feature_width) * stride).cast("double").alias("x"), (F.floor(cell / feature_width) * stride).cast("double").alias("y"))


def decoded_box(centre_: Column, distances: Column | str) -> Column:
    """Box (x1, y1, x2, y2) from distances left, top, right and bottom of a centre."""
    d = _col(distances)
    return F.array(centre_["x"] - d[0], centre_["y"] - d[1], centre_["x"] + d[2], centre_["y"] + d[3])


def decoded_points(centre_: Column, offsets: Column | str) -> Column:
    """Points (x, y) from alternating offsets of a centre."""
    o = _col(offsets)
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(o) / 2).cast("int") - 1), lambda i: F.struct((centre_["x"] + F.get(o, 2 * i)).alias("x"), (centre_["y"] + F.get(o, 2 * i + 1)).alias("y")))
