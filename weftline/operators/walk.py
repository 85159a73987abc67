"""Walks over sorted rows: state that depends on all rows before, in series of any length.

Rows are partitioned by key and sorted; a task reads its rows once, batch by
batch, and keeps one key's state (a vector, a matrix, the last two dozen
values). No key is gathered into an array, so only a series' time is bounded
by one task, not its memory. A row whose `cut` is true starts its key's state anew.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType


def walked(rows: DataFrame, key: list[str], order: list[str], fields: list[str], start: Callable[[], object], step: Callable, name: str, kind: DataType, cut: str | None = None) -> DataFrame:
    """The key, order and fields of each row, and `name`: step(state, *fields) returns the state after the row and its value.

    A null cut is none.
    """
    names = list(dict.fromkeys([*key, *order, *fields, *([cut] if cut else [])]))
    narrow = rows.select(*names)
    keep = list(dict.fromkeys([*key, *order, *fields]))
    out_schema = narrow.select(*keep).schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        last, state = None, start()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = zip(*(batch.column(c).to_pylist() for c in key))
            values = zip(*(batch.column(c).to_pylist() for c in fields))
            cuts = batch.column(cut).to_pylist() if cut else [False] * batch.num_rows
            out = []
            for k, v, c in zip(keys, values, cuts):
                if k != last or c:
                    last, state = k, start()
                state, value = step(state, *v)
                out.append(value)
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, to_arrow_type(kind))], names=[*keep, name])

    return narrow.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, out_schema)


def _tidy(v: np.ndarray) -> list[float]:
    return v.tolist()


def smoothed(rows: DataFrame, key: list[str], order: list[str], vector: str, alpha: float = 0.80, unit: bool = True, cut: str | None = None, least: float = 1e-6) -> DataFrame:
    """Adds smoothed: alpha * state + (1 - alpha) * vector, the first vector seeding the state; of unit length if `unit`, the state itself never is.

    A null vector leaves the state and is null; a result of no length (under `least`) is the vector itself.
    """
    def step(state, v):
        if v is None:
            return state, None
        v = np.array(v, float)
        state = v if state is None else alpha * state + (1.0 - alpha) * v
        n = float(np.linalg.norm(state)) if unit else 1.0
        return state, _tidy(state / n if n > least else v)

    return walked(rows, key, order, [vector], lambda: None, step, "smoothed", ArrayType(DoubleType()), cut)


def smoothed_matrix(rows: DataFrame, key: list[str], order: list[str], matrix: str, size: str, alpha: float = 0.6, scale: float = 6.0, cut: str | None = None) -> DataFrame:
    """Adds smoothed: 2 x 3 matrices (six numbers, row by row) of which the past weighs less the further they move.

    The move is the step of the translation column from the smoothed matrix before, in percent of the face's size.
    """
    def step(state, m, face):
        if m is None:
            return state, None
        m = np.array(m, float)
        if state is None:
            return m, _tidy(m)
        move = float(np.hypot(m[2] - state[2], m[5] - state[5])) / max(face or 0.0, 1.0) * 100.0
        weight = min(max(alpha * float(np.exp(-move / scale)), 0.0), alpha)
        state = weight * state + (1.0 - weight) * m
        return state, _tidy(state)

    return walked(rows, key, order, [matrix, size], lambda: None, step, "smoothed", ArrayType(DoubleType()), cut)


class Recent:
    """The last values, and their median from a sorted list kept beside them."""

    def __init__(self, most: int):
        self.most, self.queue, self.sorted = most, deque(), []

    def add(self, value: float) -> None:
        self.queue.append(value)
        insort(self.sorted, value)
        if len(self.queue) > self.most:
            del self.sorted[bisect_left(self.sorted, self.queue.popleft())]

    def restart(self, value: float) -> None:
        self.queue, self.sorted = deque([value]), [value]

    def median(self) -> float:
        n = len(self.sorted)
        return (self.sorted[(n - 1) // 2] + self.sorted[n // 2]) / 2.0

    def __len__(self) -> int:
        return len(self.queue)


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson correlation of two histograms; 1 where either is flat."""
    x, y = a - a.mean(), b - b.mean()
    both = float((x * x).sum() * (y * y).sum())
    return float((x * y).sum()) / both**0.5 if both > np.finfo(float).eps else 1.0


def spike_cuts(rows: DataFrame, key: list[str], order: list[str], value: str, floor: float = 8.0, ratio: float = 3.0, window: int = 24, warmup: int = 3) -> DataFrame:
    """Adds is_cut: a value at or over the floor and `ratio` times the median of those since the last cut, `window` at most; history restarts with it."""
    def step(recent: Recent, v):
        cut = v is not None and len(recent) >= warmup and v >= floor and v >= ratio * max(recent.median(), 1.0)
        if v is not None:
            (recent.restart if cut else recent.add)(float(v))
        return recent, bool(cut)

    return walked(rows, key, order, [value], lambda: Recent(window), step, "is_cut", BooleanType())


def scene_cuts(rows: DataFrame, key: list[str], order: list[str], histogram: str, frame: str, least: float = 0.55, floor: float = 8.0, ratio: float = 3.0, window: int = 24, warmup: int = 3) -> DataFrame:
    """Adds is_cut of each frame against the one before, by both tests: a correlation of their histograms under `least`, or a spike of their mean absolute difference.

    `frame` is an array of a frame's samples. Before `warmup` differences only the histogram can cut. A key's first frame is none.
    """
    def step(state, h, f):
        before, recent = state
        here = (np.array(h, float), np.array(f, float))
        if before is None:
            return (here, recent), False
        away = float(np.abs(before[1] - here[1]).mean())
        spike = len(recent) >= warmup and away >= floor and away >= ratio * max(recent.median(), 1.0)
        cut = correlation(before[0], here[0]) < least or spike
        (recent.restart if cut else recent.add)(away)
        return (here, recent), bool(cut)

    whole = rows.where(F.col(histogram).isNotNull() & F.col(frame).isNotNull())
    return walked(whole, key, order, [histogram, frame], lambda: (None, Recent(window)), step, "is_cut", BooleanType())


def throttled(rows: DataFrame, key: list[str], order: list[str], time: str, apart: float = 0.5, always: str | None = None) -> DataFrame:
    """Adds emitted: whether `apart` has passed since the last row emitted, or the row is one of `always`."""
    def step(last, t, *must):
        due = last is None or t - last >= apart or bool(must and must[0])
        return (float(t) if due else last), due

    return walked(rows, key, order, [c for c in (time, always) if c], lambda: None, step, "emitted", BooleanType())
