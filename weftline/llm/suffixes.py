"""Suffix-array deduplication of byte strings of `LENGTH` or more.

A byte goes if it lies in a window of LENGTH = 200 bytes that also starts
anywhere else. Sorting all suffixes would move each byte 200 times, so only
suffixes at anchors are sorted. The anchor of a window is the position of the
least hash among its GRAM-byte strings (the leftmost of equals): equal windows
have equal anchors, at one offset. A run of windows with one anchor is a
segment; the anchor's leading tokens are the GRAM bytes that follow it.

1. Segments are counted by (anchor, content), on the map side first: equal ones are
   folded into one with a number. An anchor that occurs once has no repeated window.
2. The folded segments are range-partitioned by their leading tokens: splitters are
   sampled. The segments of an anchor with very many contents are cut into blocks of
   offsets, for windows at different offsets never match, and have for leading tokens,
   beside the anchor's, the bytes that all windows of the block hold: other contents, other buckets.
3. In its bucket, a segment is two suffixes: its bytes from the anchor on, and
   those before the anchor, read backwards. Both are sorted by multikey quicksort: a run of
   suffixes that are still equal is parted by the next 8 bytes, in lexicographic order, and those that
   are alone drop out. Neighbours' common prefixes give, for each offset d, the suffixes that agree for
   200 - d bytes after the anchor and d before it: windows of one class of both are equal. A window is repeated if
   its class holds two segments, or a folded one.
4. Buckets compare across their boundaries: the last leading tokens of each and the first of the next must differ,
   as they do where no run of equal ones is parted; if not, the job fails rather than miss a match.
5. Intervals return to all places of their segments.

Hot passages are counted by partial aggregation before any shuffle, and only
distinct segments are ever sorted. A task holds about `TILE` bytes, or the segments of one run of leading tokens. Work arrays are bounded by pieces of text,
long documents included.

Defined results: null text is empty; text under LENGTH bytes is kept whole;
a text that repeats inside itself counts, overlaps included; repeated rows are
copies of each other, whatever their ids, null ones too; extra columns are dropped by `report`; an empty table
stays empty.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrow import pieces, utf8
from weftline.llm.shared import Stored, release

LENGTH, GRAM = 200, 32
TILE = 1 << 20
#: Distinct contents of one anchor from which its windows are dealt by offset, and segments that a bucket is meant to hold.
SALT_FROM, SALT_BLOCK = 512, 16
BUCKET = 250_000
#: Places of one segment in a task.
PLACES = 2_048
_BASE = 0x9E3779B97F4A7C15


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM = 32 bytes from each position on, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    for e in (1, 2, 4, 8, 16):
        h = h[:-e] * np.uint64(pow(_BASE, e, 1 << 64)) + h[e:]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :]) if have < width else keys


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor, hash of the anchor's gram) of every segment of the rows in `data`.

    Positions count from the start of `data`. A row is cut into tiles of
    windows; a segment that a tile's edge divides is two segments.
    """
    out = []
    stops = offsets[1:] - LENGTH  # last window of each row, less than its start if there is none
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    lo = 0
    while lo + LENGTH <= len(data):
        hi = min(lo + TILE, len(data) - LENGTH + 1)  # windows lo .. hi - 1
        h = _grams(data[lo : hi + LENGTH - 1])
        place = np.arange(len(h), dtype=np.uint64)
        best = _least((h & np.uint64(0xFFFFFFFF00000000)) | place, LENGTH - GRAM + 1)
        anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        row = owner[lo:hi]
        valid = np.arange(lo, hi) <= stops[row]
        new = np.ones(hi - lo, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], hi - lo) - 1
        ok = valid[first]
        first, last = first[ok], last[ok]
        out.append((row[first], first + lo, last + lo, anchor[first] + lo, h[anchor[first]].view(np.int64)))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def _located(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, ...], np.ndarray]]:
    """For each piece of a batch: its first row, bytes, offsets, segments and their content hashes."""
    data, offsets = utf8(batch.column("text"))
    with np.errstate(over="ignore"):
        for lo, hi in pieces(offsets):
            part = data[offsets[lo] : offsets[hi]]
            ends = offsets[lo : hi + 1] - offsets[lo]
            found = segments(part, ends)
            view = memoryview(part.tobytes())
            content = np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + LENGTH]) for a, b in zip(found[1].tolist(), found[2].tolist(), strict=True)), np.uint64, len(found[0]))
            yield lo, part, ends, found, content.view(np.int64)


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, key, text_hash, text: rows of one id but different texts stay apart by the hash, and a null id has it for a key."""
    h = F.xxhash64("text")
    return documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), h).alias("key"), h.alias("text_hash"), "text")


def _counts(keyed: DataFrame) -> DataFrame:
    """anchor, content, n, owner: how often each segment occurs, and the least key that holds it; batches are counted first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            parts = [(f[4], c, keys[lo + f[0]]) for lo, _, _, f, c in _located(batch)]
            if not sum(len(p[0]) for p in parts):
                continue
            anchor, content, key = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((key, content, anchor))
            anchor, content, key = anchor[order], content[order], key[order]
            first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])))
            n = np.diff(np.append(first, len(anchor)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[first]), pa.array(content[first]), pa.array(n.astype(np.int64)), pa.array(key[first])], names=["anchor", "content", "n", "owner"]
            )

    return keyed.select("key", "text").mapInArrow(run, "anchor long, content long, n long, owner long")


def _repeated(keyed: DataFrame) -> DataFrame:
    """anchor, content, n, owner, kinds of all segments whose anchor occurs twice or more; one shuffle serves all three steps."""
    each = _counts(keyed).repartition("anchor").groupBy("anchor", "content").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"))
    per = each.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1").select("anchor", "kinds")
    return each.join(per, "anchor")


def _places(keyed: DataFrame) -> DataFrame:
    """key, text_hash, first, last, at, anchor, content of every segment of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text_hash")
            for lo, _, ends, (row, first, last, at, anchor), content in _located(batch):
                take, begin = pa.array(lo + row), ends[row]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(take), texts.take(take), pa.array(first - begin), pa.array(last - begin), pa.array(at - begin), pa.array(anchor), pa.array(content)],
                    names=["key", "text_hash", "first", "last", "at", "anchor", "content"],
                )

    return keyed.select("key", "text_hash", "text").mapInArrow(run, "key long, text_hash long, first long, last long, at long, anchor long, content long")


SUFFIXES = "anchor long, content long, n long, at int, lead binary, bytes binary"


def _suffixes(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of one of each wanted segment, with the number of its copies, where its anchor is, and its leading tokens."""
    lists = wanted.groupBy("key", "text_hash").agg(F.collect_set(F.struct("first", "last", "at", "anchor", "content", "n", "salted")).alias("wanted"))
    rows = keyed.select("key", "text_hash", "text").join(lists, ["key", "text_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text, some in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                for x in some:
                    lo, hi, at = x["first"], x["last"], x["at"]
                    lead = data[at : at + GRAM]
                    parts = [(lo, hi, lead)]
                    if x["salted"]:  # windows s with (at - s) // SALT_BLOCK = b; all of them hold the bytes from at - b * SALT_BLOCK on
                        parts = [
                            (max(lo, at - (b + 1) * SALT_BLOCK + 1), min(hi, at - b * SALT_BLOCK), lead + bytes([b]) + data[at - b * SALT_BLOCK : at - (b + 1) * SALT_BLOCK + 1 + LENGTH])
                            for b in range((at - hi) // SALT_BLOCK, (at - lo) // SALT_BLOCK + 1)
                        ]
                    for a, z, tokens in parts:
                        for column, value in zip(out, (x["anchor"], x["content"], x["n"], at - a, tokens, data[a : z + LENGTH]), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["anchor", "content", "n", "at", "lead", "bytes"])

    # Segments that stand twice in their first document come twice; one is enough.
    return rows.mapInArrow(run, SUFFIXES).dropDuplicates(["anchor", "content", "at", "lead"])


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number, the first byte highest; zeros follow the end."""
    data = np.concatenate([data, np.zeros(7, np.uint8)])
    out = np.zeros(len(data) - 7, np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | data[i : i + len(out)]
    return out


_MASKS = np.array([0] + [((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(1, 9)], np.uint64)


def _token(eights: np.ndarray, start: np.ndarray, length: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The next 8 bytes of suffixes, zeros beyond their ends, and how many of them there are."""
    here = np.clip(length - depth, 0, 8)
    return eights[np.minimum(start + depth, len(eights) - 1)] & _MASKS[here], here


def multikey_quicksort(eights: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray, depth: int = 0) -> np.ndarray:
    """Suffixes (rows of start, length) in lexicographic order within their groups, the first `depth` bytes of a group being equal.

    A suffix's place is that of the first of its run; each round parts the runs by the next token.
    """
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.append(True, group[order[1:]] != group[order[:-1]])[: len(order)])
    size = np.diff(np.append(first, len(order)))
    place = np.empty(len(order), np.int64)
    place[order] = np.repeat(first, size)
    alive = order[np.repeat(size > 1, size)]
    while len(alive):
        value, here = _token(eights, start[alive], length[alive], depth)
        by = np.lexsort((here, value, place[alive]))
        alive, value, here = alive[by], value[by], here[by]
        run = place[alive]
        outer = np.append(True, run[1:] != run[:-1])
        inner = outer | np.append(True, (value[1:] != value[:-1]) | (here[1:] != here[:-1]))
        begin, outer_begin = np.flatnonzero(inner), np.flatnonzero(outer)
        size = np.diff(np.append(begin, len(alive)))
        place[alive] = np.repeat(run[begin] + begin - outer_begin[np.searchsorted(outer_begin, begin, "right") - 1], size)
        alive = alive[np.repeat(size > 1, size) & (here == 8)]
        depth += 8
    return np.argsort(place, kind="stable")


def common_prefixes(eights: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it; -1 where the group is another."""
    out = np.zeros(len(start), np.int64)
    out[:1] = -1
    out[1:][group[1:] != group[:-1]] = -1
    alive, depth = np.flatnonzero(out == 0), 0
    while len(alive):
        x, n = _token(eights, start[alive], length[alive], depth)
        y, m = _token(eights, start[alive - 1], length[alive - 1], depth)
        differ = x ^ y
        same = np.full(len(alive), 8)
        for k in range(8):
            same[(differ >> np.uint64(56 - 8 * k)) & np.uint64(255) != 0] = np.minimum(same, k)[(differ >> np.uint64(56 - 8 * k)) & np.uint64(255) != 0]
        same = np.minimum(same, np.minimum(n, m))
        out[alive] += same
        alive = alive[same == 8]
        depth += 8
    return out


def equal_windows(blobs: list[bytes], at: np.ndarray, group: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of every window that equals one of another segment, or stands in a segment of several copies; equal windows share group and offset."""
    data = np.frombuffer(b"".join(blobs), np.uint8)
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    anchor = np.cumsum(sizes) - sizes + at
    windows = sizes - LENGTH + 1
    classes = []
    for text, start, length, depth in ((data, anchor, sizes - at, GRAM), (data[::-1], len(data) - anchor, at, 0)):
        eights = _eights(text)
        order = multikey_quicksort(eights, start, length, group, depth)
        shared = common_prefixes(eights, start[order], length[order], group[order])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        classes.append((shared, back))
    (after, after_place), (before, before_place) = classes
    found_segment, found_window = [], []
    for d in range(int((at - windows + 1).min()), int(at.max()) + 1):
        member = np.flatnonzero((at >= d) & (at - windows < d))
        if not len(member):
            continue
        key = np.cumsum(after < LENGTH - d)[after_place[member]] * (len(at) + 1) + np.cumsum(before < d)[before_place[member]]
        order = np.argsort(key)
        begin = np.flatnonzero(np.append(True, key[order[1:]] != key[order[:-1]]))
        total = np.add.reduceat(copies[member[order]], begin)
        twice = member[order[np.repeat(total > 1, np.diff(np.append(begin, len(order))))]]
        found_segment.append(twice)
        found_window.append(at[twice] - d)
    if not found_segment:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    segment, window = np.concatenate(found_segment), np.concatenate(found_window)
    order = np.lexsort((window, segment))
    return segment[order], window[order]


MATCHED = "anchor long, content long, n long, lo long, hi long, bucket int, first_lead binary, last_lead binary"


def _matched(suffixes: DataFrame, partitions: int) -> DataFrame:
    """anchor, content, n, lo, hi: byte intervals, from the anchor on, that repeated windows of the segments cover; and a row of each bucket's edges."""

    def finish(table: pa.Table) -> pa.RecordBatch:
        lead = table.column("lead").combine_chunks()
        group = np.cumsum(np.append(False, pa.compute.not_equal(lead[1:], lead[:-1]).to_numpy(zero_copy_only=False)))
        at = table.column("at").to_numpy().astype(np.int64)
        segment, window = equal_windows(table.column("bytes").to_pylist(), at, group, table.column("n").to_numpy())
        new = np.append(True, (segment[1:] != segment[:-1]) | (window[1:] != window[:-1] + 1))[: len(segment)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(segment))[: len(first)] - 1
        take, offset = pa.array(segment[first]), window[first] - at[segment[first]]
        ids = [table.column(c).combine_chunks().take(take) for c in ("anchor", "content", "n")]
        n = len(first)
        return _rows(*ids, pa.array(offset), pa.array(window[last] - at[segment[first]] + LENGTH), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        waiting, held, first, last = [], 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            lead = batch.column("lead")
            first, ends = lead[0].as_py() if first is None else first, lead[-1].as_py()
            # The last run of a batch may go on in the next one: what comes before it is whole.
            tail = int(pa.compute.index_in(pa.scalar(ends, pa.binary()), value_set=lead).as_py())
            if tail or ends != last:
                waiting.append(batch.slice(0, tail))
                held += waiting[-1].nbytes
                if held > TILE:
                    table = pa.Table.from_batches(waiting)
                    if table.num_rows:
                        yield finish(table)
                    waiting, held = [], 0
            waiting.append(batch.slice(tail))
            held += waiting[-1].nbytes
            last = ends
        if waiting and (table := pa.Table.from_batches(waiting)).num_rows:
            yield finish(table)
        if first is not None:
            yield _rows(*(pa.nulls(1, pa.int64()) for _ in range(5)), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary()))

    return suffixes.repartitionByRange(partitions, "lead").sortWithinPartitions("lead").mapInArrow(run, MATCHED)


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=[c.split()[0] for c in MATCHED.split(", ")])


def _compare_boundaries(matched: DataFrame) -> None:
    """Fails if a run of equal leading tokens lies across the boundary of two buckets: a window could then match in the next one. One row a bucket."""
    edge = matched.where("bucket is not null").select("bucket", "first_lead", "last_lead").orderBy("bucket").collect()
    for one, two in zip(edge, edge[1:], strict=False):
        if one["last_lead"] >= two["first_lead"]:
            raise RuntimeError(f"buckets {one['bucket']} and {two['bucket']} share leading tokens")


def intervals(documents: DataFrame) -> DataFrame:
    """key, text_hash, lo, hi: byte intervals, overlapping ones included, that cover all repeated windows."""
    spark = documents.sparkSession
    keyed = _keyed(documents)
    repeated = Stored(_repeated(keyed))
    release(spark)
    placed = Stored(_places(keyed).join(repeated.rows, ["anchor", "content"]).select(
        "key", "text_hash", "first", "last", "at", "anchor", "content", "n", (F.col("key") == F.col("owner")).alias("owner"), (F.col("kinds") > SALT_FROM).alias("salted")
    ))
    repeated.discard()
    release(spark)
    suffixes = Stored(_suffixes(keyed, placed.rows.where("owner")))
    release(spark)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(suffixes.rows.count() / BUCKET))
    matched = Stored(_matched(suffixes.rows, partitions))
    _compare_boundaries(matched.rows)
    suffixes.discard()
    release(spark)
    # A segment has at most LENGTH windows, so its intervals are one short row, whatever the number of its places.
    found = matched.rows.where("bucket is null").groupBy("anchor", "content").agg(F.collect_set(F.struct("lo", "hi")).alias("found"), F.max("n").alias("n"))
    # A segment of very many copies is dealt over several tasks.
    deals = F.ceil(F.col("n") / PLACES).cast("int")
    dealt = found.select("anchor", "content", "found", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"))
    places = placed.rows.select("key", "text_hash", "at", "anchor", "content", F.pmod(F.xxhash64("key", "text_hash", "at"), deals).cast("int").alias("deal")).join(dealt, ["anchor", "content", "deal"])
    return places.select("key", "text_hash", "at", F.explode("found").alias("x")).select("key", "text_hash", (F.col("at") + F.col("x.lo")).alias("lo"), (F.col("at") + F.col("x.hi")).alias("hi"))


def _merged(found: list[dict] | None, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in sorted((f["lo"], f["hi"]) for f in found or ()):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [(a, min(b, size)) for a, b in out]


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes' spans for every row."""
    keyed = _keyed(documents)
    lists = intervals(documents).groupBy("key", "text_hash").agg(F.collect_set(F.struct("lo", "hi")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n, gone, spans, sha = [], [], [], []
            for i, found in enumerate(batch.column("found").to_pylist()):
                text = memoryview(data[offsets[i] : offsets[i + 1]])
                merged, at, h = _merged(found, len(text)), 0, hashlib.sha256()
                for a, b in merged:
                    h.update(text[at:a])
                    at = b
                h.update(text[at:])
                n.append(len(text))
                gone.append(sum(b - a for a, b in merged))
                spans.append([[a, b] for a, b in merged])
                sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(list(map(len, spans)), pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    joined = keyed.join(lists, ["key", "text_hash"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
