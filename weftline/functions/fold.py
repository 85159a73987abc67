"""Folds over ordered groups as JVM-side expressions.

A fold's state depends on what it kept before, so windows can't express it.
Each takes the array of a group's ordered rows; groups are the caller's, and
must be of a bounded size (a shot, a frame, a clip), because an array is held
whole. `weftline.operators.sequence` cuts longer series at resets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import geo, vec
from weftline.functions.vec import _col


def ordered(order: list[str], fields: list[str]) -> Column:
    """Aggregate: the group's rows as an array of structs, ordered."""
    return F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, *fields]))))


#: Rows between two copies of a scan's whole output.
BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def scan(rows: Column | str, start: Column, step: Callable[[Column, Column], Column], output: Callable[[Column, Column], Column], kind: str) -> Column:
    """Array of output(state after the row, row); kind is the output's type.

    Rows go by in blocks, so that a row's output is copied with its block and the block with the
    whole, not the whole with every row.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, row: Column) -> Column:
        return _let(step(acc["state"], row), lambda state: F.struct(state.alias("state"), F.array_append(acc["out"], output(state, row)).alias("out")))

    def block(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return _let(done, lambda d: F.struct(d["state"].alias("state"), F.array_append(acc["out"], d["out"]).alias("out")))

    def blocks(r: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / BLOCK).cast("int")), lambda i: F.slice(r, i * BLOCK + 1, BLOCK))

    init = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    r = _col(rows)
    return F.when(F.size(r) > 0, F.flatten(F.aggregate(blocks(r), init, block)["out"])).otherwise(none)


def ema(rows: Column | str, field: str, alpha: float) -> Column:
    """Smoothed values alpha * previous + (1 - alpha) * value; the first value seeds the state."""
    return scan(
        rows, F.lit(None).cast("double"),
        lambda s, r: F.when(s.isNull(), r[field].cast("double")).otherwise(alpha * s + (1.0 - alpha) * r[field]),
        lambda s, r: s, "double",
    )


def adaptive_ema(rows: Column | str, field: str, alpha: float = 0.6, scale: float = 6.0) -> Column:
    """Smoothing that lets go of large steps: the weight of the past is alpha * exp(-|step| / scale)."""
    def step(s: Column, r: Column) -> Column:
        a = alpha * F.exp(-F.abs(r[field] - s) / scale)
        return F.when(s.isNull(), r[field].cast("double")).otherwise(a * s + (1.0 - a) * r[field])

    return scan(rows, F.lit(None).cast("double"), step, lambda s, r: s, "double")


def throttled(rows: Column | str, time: str, apart: float = 0.5, always: str | None = None) -> Column:
    """Booleans: emitted if `apart` has passed since the last one emitted, or if the field `always` is true."""
    def step(s: Column, r: Column) -> Column:
        due = s["last"].isNull() | (r[time] - s["last"] >= apart)
        due = due | r[always] if always else due
        return F.struct(F.when(due, r[time].cast("double")).otherwise(s["last"]).alias("last"), due.alias("emit"))

    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(False).alias("emit"))
    return scan(rows, start, step, lambda s, r: s["emit"], "boolean")


def scene_cuts(rows: Column | str, value: str, floor: float = 8.0, ratio: float = 3.0, window: int = 24, warmup: int = 3, also: Callable[[Column], Column] | None = None) -> Column:
    """Booleans: a value at or over the floor and `ratio` times the median of recent ones cuts, and history restarts with it.

    Recent are the last `window` values since the last cut; before `warmup` of
    them only `also` can cut (for instance a low histogram correlation).
    """
    def step(s: Column, r: Column) -> Column:
        recent = F.array_sort(s["recent"])
        n = F.size(recent)
        at = lambda i: F.try_element_at(recent, i.cast("int"))
        middle = (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2.0
        spike = (n >= warmup) & (r[value] >= floor) & (r[value] >= ratio * F.greatest(F.coalesce(middle, F.lit(0.0)), F.lit(1.0)))
        cut = F.coalesce(spike, F.lit(False))
        cut = cut | F.coalesce(also(r), F.lit(False)) if also else cut
        own = F.array(r[value].cast("double"))
        longer = F.concat(s["recent"], own)
        kept = F.slice(longer, F.greatest(F.size(longer) - window + 1, F.lit(1)), F.lit(window))
        return F.struct(F.when(cut, own).otherwise(kept).alias("recent"), cut.alias("cut"))

    start = F.struct(F.array().cast("array<double>").alias("recent"), F.lit(False).alias("cut"))
    return scan(rows, start, step, lambda s, r: s["cut"], "boolean")


def _keep(rows: Column | str, clash: Callable[[Column, Column], Column], most: int | None) -> Column:
    r = _col(rows)
    empty = F.slice(r, 1, 0)

    def step(kept: Column, x: Column) -> Column:
        full = F.size(kept) >= most if most else F.lit(False)
        return F.when(full | F.exists(kept, lambda k: clash(k, x)), kept).otherwise(F.concat(kept, F.array(x)))

    return F.aggregate(r, empty, step)


def greedy_dedup(rows: Column | str, pose: float = 7.0, similarity: float = 0.92, most: int | None = 24) -> Column:
    """The rows (best first, fields yaw and embedding of unit norm) that are not close in pose and look to one kept before."""
    return _keep(rows, lambda k, x: (F.abs(k["yaw"] - x["yaw"]) <= pose) & (vec.dot(k["embedding"], x["embedding"]) >= similarity), most)


def mark_duplicates(rows: Column | str, name: str, pose: float = 12.0, similarity: float = 0.86, penalty: float = 0.5) -> Column:
    """Structs (name, duplicate_of, penalty), one a row, best first: a row close in pose and look to a kept one is its duplicate and counts `penalty`, others are kept."""
    r = _col(rows)

    def step(acc: Column, x: Column) -> Column:
        close = F.filter(acc["kept"], lambda k: (F.abs(k["yaw"] - x["yaw"]) <= pose) & (vec.dot(k["embedding"], x["embedding"]) >= similarity))
        of = F.get(close, 0)[name]
        mark = F.struct(x[name].alias(name), of.alias("duplicate_of"), F.when(of.isNull(), 1.0).otherwise(penalty).alias("penalty"))
        return F.struct(F.when(of.isNull(), F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept"), F.array_append(acc["marks"], mark).alias("marks"))

    first = F.get(r, 0)
    none = F.slice(F.array(F.struct(first[name].alias(name), first[name].alias("duplicate_of"), F.lit(1.0).alias("penalty"))), 1, 0)
    return F.aggregate(r, F.struct(F.slice(r, 1, 0).alias("kept"), none.alias("marks")), step)["marks"]


def nms(rows: Column | str, overlap: float = 0.4) -> Column:
    """The rows (best first, field box) that don't overlap one kept before by more than `overlap`."""
    return _keep(rows, lambda k, x: geo.iou(k["box"], x["box"]) > overlap, None)


def bounded_skips(rows: Column | str, skippable: str, most: int = 8) -> Column:
    """Booleans: whether an expensive check is skipped, at most `most` times in a row."""
    def step(s: Column, r: Column) -> Column:
        skip = r[skippable] & (s["run"] < most)
        return F.struct(F.when(skip, s["run"] + 1).otherwise(0).alias("run"), skip.alias("skip"))

    return scan(rows, F.struct(F.lit(0).alias("run"), F.lit(False).alias("skip")), step, lambda s, r: s["skip"], "boolean")
