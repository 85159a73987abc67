"""Streams: the tracker, the lock, progress events and heartbeats, on Spark's state API.

Each operator is a stateful processor with typed state per key in RocksDB:
numbers and structs in value state, tracks in list state. A clip's state ends by
its time to live if no frame comes; event-time timers tell of keys that fall
silent. The batch operators of the same names give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.operators.track import Lock, Tracks, _held, frames, match_frame, none

_STORE = "spark.sql.streaming.stateStore.providerClass"
_TRACK = "number long, look array<double>, box array<double>, speed array<double>, missed long"


def _with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str = "append", time: str = "None") -> DataFrame:
    """The output of a processor over the rows of each key; the state API needs the RocksDB store."""
    rows.sparkSession.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode=time)


def _time(ttl_ms: int | None) -> str:
    """A time to live runs by the clock, and a query that watches it never ends by itself."""
    return "ProcessingTime" if ttl_ms else "None"


def _sorted_frames(parts: Iterator[pd.DataFrame], clip: str, in_order: bool) -> Iterator[pd.DataFrame]:
    """A micro-batch's frames, one by one: as they come if they are in order, else sorted."""
    parts = parts if in_order else iter([pd.concat(list(parts), ignore_index=True).sort_values(["frame", "det"], ignore_index=True)])
    for _, _, rows in frames(parts, clip):
        yield rows


class _Tracking(StatefulProcessor):
    """Tracks of a clip: counters in value state, one row a track in list state."""

    def __init__(self, clip: str, diagonal: float, ttl_ms: int | None, in_order: bool):
        self.clip, self.diagonal, self.ttl, self.in_order = clip, diagonal, ttl_ms, in_order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "created long, lost long, vetoed long", self.ttl)
        self.tracks = handle.getListState("tracks", _TRACK, self.ttl)

    def load(self) -> Tracks:
        if not self.counters.exists():
            return none()
        rows = list(self.tracks.get()) if self.tracks.exists() else []
        number, look, box, speed, missed = zip(*rows, strict=True) if rows else ((),) * 5
        shaped = lambda x, n: np.array(x, float).reshape(len(rows), n)
        return Tracks(np.array(number, int), shaped(look, -1) if rows else np.zeros((0, 0)), shaped(box, 4), shaped(speed, 2), np.array(missed, int), *self.counters.get())

    def save(self, t: Tracks) -> None:
        self.counters.update((int(t.created), int(t.lost), int(t.vetoed)))
        self.tracks.put([(int(n), look.tolist(), box.tolist(), speed.tolist(), int(m)) for n, look, box, speed, m in zip(t.number, t.look, t.box, t.speed, t.missed, strict=True)])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.load()
        for frame in _sorted_frames(rows, self.clip, self.in_order):
            known, matched = match_frame(known, frame, self.diagonal)
            found = self.emit(key[0], matched)
            if len(found):
                yield found
        self.save(known)

    def emit(self, key, matched: pd.DataFrame) -> pd.DataFrame:
        return matched[matched["track"] > 0][[self.clip, "frame", "det", "track"]]

    def close(self) -> None:
        pass


class _Following(_Tracking):
    """The lock of a clip beside its tracks."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.locks = handle.getValueState("lock", "number long, look array<double>", self.ttl)

    def load(self) -> Tracks:
        self.lock = Lock()
        if self.locks.exists():
            number, look = self.locks.get()
            self.lock = Lock(number, None if look is None else np.array(look, float))
        return super().load()

    def emit(self, key, matched: pd.DataFrame) -> pd.DataFrame:
        self.lock, det, event = _held(self.lock, matched)
        return pd.DataFrame({self.clip: [key], "frame": [int(matched["frame"].iloc[0])], "det": pd.array([det], "Int32"), "event": [event]})

    def save(self, t: Tracks) -> None:
        super().save(t)
        self.locks.update((self.lock.number, None if self.lock.look is None else self.lock.look.tolist()))


def assign(detections: DataFrame, clip: str, diagonal: float, ttl_ms: int | None = None, in_order: bool = False) -> DataFrame:
    """`weftline.operators.track.assign` over a stream; a clip's state ends `ttl_ms` after its last frame, if given.

    Frames must come in order from micro-batch to micro-batch. Within one they are sorted, which
    gathers a clip's rows of a micro-batch; `in_order` says that they come sorted and are taken as they come.
    """
    kind = dict(detections.dtypes)[clip]
    return _with_state(detections, clip, _Tracking(clip, diagonal, ttl_ms, in_order), f"{clip} {kind}, frame long, det int, track int", time=_time(ttl_ms))


def follow(detections: DataFrame, clip: str, diagonal: float, ttl_ms: int | None = None, in_order: bool = False) -> DataFrame:
    """`weftline.operators.track.follow` over a stream, on the terms of `assign`."""
    kind = dict(detections.dtypes)[clip]
    return _with_state(detections, clip, _Following(clip, diagonal, ttl_ms, in_order), f"{clip} {kind}, frame long, det int, event string", time=_time(ttl_ms))


class _Throttle(StatefulProcessor):
    def __init__(self, time: str, apart: float, always: str | None):
        self.time, self.apart, self.always = time, apart, always

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        found = pd.concat(list(rows), ignore_index=True).sort_values(self.time, kind="stable", ignore_index=True)
        keep = []
        for t, must in zip(found[self.time], found[self.always] if self.always else [False] * len(found), strict=True):
            due = last is None or t - last >= self.apart or must is True or must is np.True_
            keep.append(bool(due))
            last = float(t) if due else last
        self.last.update((last,))
        if any(keep):
            yield found[keep]

    def close(self) -> None:
        pass


def throttled(events: DataFrame, key: str, time: str, apart_s: float = 0.5, always: str | None = None) -> DataFrame:
    """Progress events at least `apart_s` after the last one let through, or flagged by `always`; a key's state is one number."""
    return _with_state(events, key, _Throttle(time, apart_s, always), ", ".join(f"`{n}` {t}" for n, t in events.dtypes))


class _Liveness(StatefulProcessor):
    """The newest beat of a key, whether it has been reported stale, and one timer."""

    def __init__(self, key: str, ts: str, stale_ms: int):
        self.key, self.ts, self.stale = key, ts, stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beat = handle.getValueState("beat", "last long, stale boolean")

    def row(self, key, ms: int, state: str) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "last": [pd.Timestamp(ms, unit="ms")], "state": [state]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = int(max(pd.to_datetime(part[self.ts]).max().value // 1_000_000 for part in rows))
        last, stale = self.beat.get() if self.beat.exists() else (None, True)
        if last is not None and newest <= last:
            return
        if last is not None and not stale:
            self.handle.deleteTimer(last + self.stale)
        self.handle.registerTimer(newest + self.stale)
        self.beat.update((newest, False))
        if stale:
            yield self.row(key, newest, "alive")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _ = self.beat.get()
        self.beat.update((last, True))
        yield self.row(key, last, "stale")

    def close(self) -> None:
        pass


def liveness(beats: DataFrame, key: str, ts: str, stale_s: float = 180.0, late: str = "10 seconds") -> DataFrame:
    """key, last, state: `alive` at a key's first beat and when it comes back, `stale` once none came for `stale_s`.

    A key's silence is told by an event-time timer, when the others' beats have moved
    the watermark (the newest beat less `late`) past its end; the key needs no beat of its own.
    """
    kind = dict(beats.dtypes)[key]
    processor = _Liveness(key, ts, int(stale_s * 1000))
    return _with_state(beats.withWatermark(ts, late).select(key, ts), key, processor, f"{key} {kind}, last timestamp, state string", "update", "EventTime")
