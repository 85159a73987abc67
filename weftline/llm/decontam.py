"""Benchmark decontamination by q-gram lemma filtering.

A passage of n characters within k edits of a region of a document shares at
least n - q + 1 - k q of its q-grams with it, and these matches lie on at most
k + 1 neighbouring diagonals. So: every document position whose q-gram occurs
in an item is a match; matches are counted per document, item and band of
2 (k + 1) diagonals, each band overlapping the next by half; bands that meet
the bound are verified by banded alignment, the item against any substring.

Letters A-Z match in either case. The edit budget of an item is `RATE` of its
length, at any length from 32 characters on; of shorter items as many of these edits as
leave the bound positive, which are all but one at 20 to 23 characters and all at the other
lengths from `MIN_CHARS` on. Under that no edit does: an item is matched exactly, where it
doesn't begin or end within a word of ASCII letters and digits.

The items travel to the executors in blocks of about `BLOCK_CHARS` characters,
each with one pass over the documents; the driver holds the items, and a task one block at a time. A
q-gram that many items share is no hot key: a row's pairs are counted range of items by range, and expanded `PAIRS` at a time. Documents are read where they lie:
nothing is shuffled, and each text is searched whole.

Defined results: null or empty text matches nothing, null and empty items are left out,
items with equal text are found each under its own id; repeated rows give
repeated results; extra columns pass through `drop_contaminated` unchanged; an
empty benchmark leaves every document as it is.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrow import bound_batches, claim, pieces, powers, ragged, trim, utf8

Q, RATE = 8, 0.1
#: From twice the q-gram on, one edit leaves a q-gram whole.
MIN_CHARS = 2 * Q
BLOCK_CHARS = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_TABLE_BITS = 20
#: Alignments at a time, and cells of their texts, which bound a batch of long items.
_AT_ONCE, _CELLS = 512, 1 << 18
#: Pairs of a text's and an item's q-gram that are expanded at a time.
PAIRS = 1 << 18
_NEVER = np.int64(1 << 60)
_WORD = np.zeros(128, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _points(text: str) -> np.ndarray:
    p = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).copy()
    p[(p >= 65) & (p <= 90)] += 32
    return p


def _qgrams(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q = 8 characters from each position on."""
    if len(points) < Q:
        return np.zeros(0, np.uint64)
    b = [np.uint64(pow(_BASE, e, 1 << 64)) for e in (1, 2, 4)]
    h = points.astype(np.uint64)
    h = h[:-1] * b[0] + h[1:]
    h = h[:-2] * b[1] + h[2:]
    h = h[:-4] * b[2] + h[4:]
    return h


def _within(points: np.ndarray) -> np.ndarray:
    """Whether each character is an ASCII letter or digit."""
    return (points < 128) & _WORD[np.minimum(points, 127)]


class Short:
    """Items under `MIN_CHARS` characters, found exactly by polynomial hashes of the stretches that no word runs across."""

    def __init__(self, points: list[np.ndarray]):
        self.by: dict[int, dict[int, list[np.ndarray | list[int]]]] = {}
        known: dict[bytes, list[int]] = {}
        for i, p in enumerate(points):
            known.setdefault(p.tobytes(), []).append(i)
        for raw, numbers in known.items():
            p = np.frombuffer(raw, np.uint32)
            h = int((p.astype(np.uint64) * powers(_BASE, len(p))).sum(dtype=np.uint64))
            self.by.setdefault(len(p), {}).setdefault(h, []).append((p, numbers))

    def search(self, points: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item number, start, end), the first place of each item in each row."""
        if not self.by or not len(points):
            return []
        word = _within(points)
        joined = np.zeros(len(points) + 1, bool)  # a word runs across the place before each character
        joined[1:-1] = word[1:] & word[:-1]
        joined[starts] = False
        begins = np.flatnonzero(~joined[:-1])
        back = powers(pow(_BASE, -1, 1 << 64), len(points))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(points.astype(np.uint64) * powers(_BASE, len(points)))])
        row_end = starts[np.searchsorted(starts, begins, "right")]
        out = []
        for n, items in self.by.items():
            at = begins[begins + n <= row_end]
            at = at[~joined[at + n]]
            h = (sums[at + n] - sums[at]) * back[at]
            values = np.array(sorted(items), np.uint64)
            number = np.minimum(np.searchsorted(values, h), len(values) - 1)
            hit = np.flatnonzero(values[number] == h)
            order = hit[np.argsort(number[hit], kind="stable")]
            for part in np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(order) else []:
                for p, numbers in items[int(h[part[0]])]:
                    real = at[part][(points[at[part][:, None] + np.arange(n)] == p).all(axis=1)]
                    rows, first = np.unique(np.searchsorted(starts, real, "right") - 1, return_index=True)
                    begin = (real[first] - starts[rows]).tolist()
                    out += [(r, i, b, b + n) for r, b in zip(rows.tolist(), begin, strict=True) for i in numbers]
        return out


class Index:
    """Items with their budgets, and the places of each of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        filled = [(i, p) for i, t in items if t is not None and len(p := _points(t))]
        kept = [(i, p) for i, p in filled if len(p) >= MIN_CHARS]
        short = [(i, p) for i, p in filled if len(p) < MIN_CHARS]
        self.ids = [i for i, _ in kept + short]
        self.short = Short([p for _, p in short])
        self.points = [p for _, p in kept]
        self.n = np.array([len(p) for p in self.points], np.int64)
        self.k = np.minimum((self.n * rate).astype(np.int64), (self.n - Q) // Q)
        self.least = self.n - Q + 1 - self.k * Q
        grams = [_qgrams(p) for p in self.points]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, number, self.count = np.unique(flat[order], return_inverse=True, return_counts=True)
        self.key = number * len(self.n) + self.item  # ascending: the places of a gram, by item
        self.maybe = np.zeros(1 << _TABLE_BITS, bool)
        self.maybe[self._slot(self.grams)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _TABLE_BITS)

    def matches(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose q-gram is an item's, and the gram's number."""
        h = _qgrams(points)
        at = np.flatnonzero(self.maybe[self._slot(h)])
        number = np.searchsorted(self.grams, h[at])
        number[number == len(self.grams)] = 0
        real = self.grams[number] == h[at]
        return at[real], number[real]

    def search(self, points: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item number, edits, start, end), the best region of each row and item, in code points.

        `points` holds the rows one after the other, row i from starts[i] to starts[i + 1].
        """
        short = [(r, len(self.n) + i, 0, begin, end) for r, i, begin, end in self.short.search(points, starts)]
        return sorted(self._long(points, starts) + short)

    def _long(self, points: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        if not len(self.grams) or len(points) < Q:
            return []
        at, gram = self.matches(points)
        row = np.searchsorted(starts, at, "right") - 1
        inside = at + Q <= starts[row + 1]
        at, gram, row = at[inside], gram[inside], row[inside]
        # Whatever the item, `least` matches must lie within its length and budget: matches outside any such run are noise.
        run, reach = int(self.least.min()), int((self.n + self.k).max())
        if len(at) < run:
            return []
        begins = np.flatnonzero((at[run - 1 :] - at[: len(at) - run + 1] <= reach) & (row[run - 1 :] == row[: len(at) - run + 1]))
        cover = np.zeros(len(at) + 1, np.int64)
        np.add.at(cover, begins, 1)
        np.add.at(cover, begins + run, -1)
        dense = np.cumsum(cover[:-1]) > 0
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        at, gram, row = at[dense], gram[dense], row[dense]
        lo = 0
        while lo < len(at):  # whole rows, about `PAIRS` pairs at a time
            ends = np.cumsum(self.count[gram[lo:]])
            hi = lo + max(1, int(np.searchsorted(ends, PAIRS)))
            hi = int(np.searchsorted(row, row[min(hi, len(at)) - 1], "right"))
            parts = max(1, min(len(self.n), -(-int(self.count[gram[lo:hi]].sum()) // PAIRS)))
            for first, last in itertools.pairwise(np.linspace(0, len(self.n), parts + 1).astype(int).tolist()):
                self._bands(points, starts, at[lo:hi], gram[lo:hi], row[lo:hi], (first, last), found)
            lo = hi
        return [(r, i, *x) for (r, i), x in found.items()]

    def _counted(self, at: np.ndarray, gram: np.ndarray, base: np.ndarray, items: tuple[int, int], shift: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Matches of each (row, item, band) for a range of items; pairs are expanded `PAIRS` at a time, and only their counts kept."""
        begin = np.searchsorted(self.key, gram * len(self.n) + items[0])
        n = np.searchsorted(self.key, gram * len(self.n) + items[1]) - begin
        ends, keys, counts, lo = np.cumsum(n), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            some = n[lo:hi]
            which = ragged(begin[lo:hi], some)
            item, place = self.item[which], self.place[which]
            band = (np.repeat(at[lo:hi], some) - place + shift) // (self.k[item] + 1) + 1  # one up, so that the lower of the two is never negative
            key = (np.repeat(base[lo:hi], some) * len(self.n) + item) * size + band
            keys, back = np.unique(np.concatenate([keys, key, key - 1]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, np.ones(2 * len(key), np.int64)]), len(keys)).astype(np.int64)
            lo = hi
        return keys, counts

    def _bands(self, points, starts, at, gram, row, items, found) -> None:
        at = at - starts[row]
        shift = int(self.n.max())  # diagonals of regions that begin before the row are negative
        size = int(at.max()) + shift + 3
        keys, counts = self._counted(at, gram, row - row[0], items, shift, size)
        items = keys // size % len(self.n)
        good = counts >= self.least[items]
        keys, items = keys[good], items[good]
        rows = keys // size // len(self.n) + row[0]
        low = (keys % size - 1) * (self.k[items] + 1) - shift
        order = np.argsort(self.n[items], kind="stable")
        cells = self.n[items[order]] + 2 * (self.k[items[order]] + 1)
        lo = 0
        while lo < len(order):  # in order of length, so the last one of a batch is the longest
            fit = np.arange(1, min(_AT_ONCE, len(order) - lo) + 1) * cells[lo : lo + _AT_ONCE] <= _CELLS
            some = order[lo : lo + max(1, int(np.count_nonzero(fit)))]
            lo += len(some)
            for r, i, x in self._align(points, starts, rows[some], items[some], low[some]):
                if (r, i) not in found or x < found[r, i]:
                    found[r, i] = x

    def _align(self, points, starts, rows, items, low) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
        """Banded alignment of each item with any substring on the band's diagonals low .. low + 2 k + 1."""
        n, k = self.n[items], self.k[items]
        top, wide = int(n.max()), int(2 * (k.max() + 1))
        cells = np.arange(wide)
        step = 1 << wide.bit_length()  # cost * step + start of the alignment within its band
        pattern = np.zeros((len(items), top), np.uint32)
        for c, i in enumerate(items):
            pattern[c, : n[c]] = self.points[i]
        begin, end = starts[rows], starts[rows + 1]
        where = (begin + low)[:, None] + np.arange(top + wide)
        text = np.where((where >= begin[:, None]) & (where < end[:, None]), points[np.clip(where, 0, len(points) - 1)], np.uint32(0xFFFFFFFF))
        outside = cells >= 2 * (k[:, None] + 1)
        v = np.where(outside, _NEVER, cells)  # a free start on any diagonal
        done = np.full_like(v, _NEVER)
        for s in range(1, top + 1):
            diagonal = v + step * (pattern[:, s - 1 : s] != text[:, s - 1 : s - 1 + wide])
            down = np.full_like(v, _NEVER)
            down[:, :-1] = v[:, 1:] + step
            v = np.minimum(diagonal, down)
            v[outside] = _NEVER
            v = np.minimum.accumulate(v - step * cells, axis=1) + step * cells
            v[outside] = _NEVER
            ended = n == s
            if ended.any():
                done[ended] = v[ended]
            if s % 64 == 0 and (v.min(axis=1) // step > k)[n > s].all():  # costs never fall
                break
        best = done.argmin(axis=1)
        value = done[np.arange(len(items)), best]
        for c in np.flatnonzero(value // step <= k):
            length = int(end[c] - begin[c])
            first = int(np.clip(low[c] + value[c] % step, 0, length))
            yield int(rows[c]), int(items[c]), (int(value[c] // step), first, int(np.clip(n[c] + low[c] + best[c], first, length)))


def blocks(benchmark: DataFrame, size: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about `size` characters."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / size))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        if rows := sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x)):
            yield rows


def _searched(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    claim("decontam")
    data, offsets = utf8(texts)
    for lo, hi in pieces(offsets):
        part = data[offsets[lo] : offsets[hi]]
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        starts = chars[offsets[lo : hi + 1] - offsets[lo]]
        for row, item, edits, start, end in index.search(_points(part.tobytes().decode()), starts):
            yield lo + row, item, edits, start, end


def find(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, span_start, span_end: the best region for each document and item it holds."""
    schema = "doc_id long, item_id long, edits int, span_start int, span_end int"
    bound_batches(documents.sparkSession)
    texts, out = documents.select(F.col("doc_id").cast("long"), "text"), None
    for items in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index(items)
            for batch in batches:
                ids = batch.column("doc_id")
                rows = list(_searched(batch.column("text"), index))
                row, item, edits, start, end = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row, pa.int64())), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(edits, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                    names=["doc_id", "item_id", "edits", "span_start", "span_end"],
                )

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return documents.sparkSession.createDataFrame([], schema) if out is None else out


def _cleaner(items: list[tuple[int, str]]):
    """A column function: whether a text holds none of the items."""
    made: list[Index] = []

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Index(items))
        keep = np.ones(len(texts), bool)
        keep[[x[0] for x in _searched(texts, made[0])]] = False
        trim()
        return pa.array(keep)

    return clean


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that hold no item within its edit budget; only texts go to Python."""
    bound_batches(documents.sparkSession)
    for items in blocks(benchmark):
        documents = documents.where(_cleaner(items)("text"))
    return documents
