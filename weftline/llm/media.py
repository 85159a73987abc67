"""Media columns: WAV payloads, short-time spectra and peak-pair fingerprints.

A payload is stored as the samples of an 8-bit mono WAV file by the `wave`
module and read back by it. Frames of 192 samples, 96 apart, are windowed and
transformed; the strongest bin of each of three bands is a peak where it is a
local maximum over time. Each peak is paired with the three that follow it
within 63 frames, and a pair is one time-coded integer:
`time << 20 | bin << 13 | bin of the partner << 6 | distance in time`.

The windowed transform uses integer coefficients so small that every sum is
exact in float32: equal payloads give equal features on any machine, in any
batch. Rows are independent; nothing is shuffled, and work arrays are bounded
by a few MB (or by one payload).

Defined results: null text is an empty payload, which is padded to 192 spaces;
silence (a constant payload) has no peaks and an empty array; repeated rows
give repeated results; extra columns are dropped; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrow import bound_batches, list_array, pieces, trim, utf8

FRAME, HOP, RATE = 192, 96, 8_000
BANDS = ((1, 12), (12, 36), (36, 96))
PARTNERS, REACH = 3, 63


def _basis() -> np.ndarray:
    """(FRAME, 2 * bins): windowed cosines and sines as integers of at most 7 bits, each column without a mean."""
    n, k = np.arange(FRAME)[:, None], np.arange(1, BANDS[-1][1])[None, :]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * (n + 0.5) / FRAME)
    angle = 2 * np.pi * n * k / FRAME
    basis = np.hstack([np.rint(window * np.cos(angle) * 63), np.rint(window * np.sin(angle) * 63)])
    basis[FRAME // 2] -= basis.sum(axis=0)
    return basis.astype(np.float32)


BASIS = _basis()


def write_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def padded(text: bytes) -> bytes:
    return text.ljust(max(FRAME, -(-len(text) // FRAME) * FRAME), b" ")


def spectra(samples: np.ndarray) -> np.ndarray:
    """Power of every bin (columns) and frame (rows), exact integers in float64."""
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32) - 128.0, FRAME)[::HOP]
    z = np.ascontiguousarray(frames) @ BASIS
    half = z.shape[1] // 2
    z = z.astype(np.float64)
    return z[:, :half] ** 2 + z[:, half:] ** 2


def fingerprints(payloads: list[bytes]) -> list[np.ndarray]:
    """The time-coded pairs of each payload; lengths are multiples of FRAME."""
    samples = np.frombuffer(b"".join(payloads), np.uint8)
    counts = np.array([len(p) // HOP - 1 for p in payloads])
    starts = np.concatenate([[0], np.cumsum([len(p) // HOP for p in payloads])])[:-1]
    power = spectra(samples)
    owner = np.full(len(power), -1)
    time = np.zeros(len(power), np.int64)
    for i, (s, c) in enumerate(zip(starts, counts, strict=True)):  # the frame across two payloads stays unowned
        owner[s : s + c] = i
        time[s : s + c] = np.arange(c)
    found = []
    for lo, hi in BANDS:
        band = power[:, lo - 1 : hi - 1]
        top = band.argmax(axis=1)
        level = band[np.arange(len(band)), top]
        level[owner < 0] = -1.0
        before = np.concatenate([[-1.0], level[:-1]])
        after = np.concatenate([level[1:], [-1.0]])
        peak = np.flatnonzero((level > 0) & (level >= before) & (level > after))
        found.append(np.stack([peak, top[peak] + lo]))
    at, bins = np.concatenate(found, axis=1)
    order = np.lexsort((bins, at))
    at, bins = at[order], bins[order]
    who, when = owner[at], time[at]
    codes, owners = [], []
    for step in range(1, PARTNERS + 1):
        if len(at) > step:
            apart = when[step:] - when[:-step]
            ok = (who[step:] == who[:-step]) & (apart <= REACH)
            codes.append((when[:-step][ok] << 20) | (bins[:-step][ok] << 13) | (bins[step:][ok] << 6) | apart[ok])
            owners.append(who[:-step][ok])
    if not codes:
        return [np.zeros(0, np.int64) for _ in payloads]
    code, own = np.concatenate(codes), np.concatenate(owners)
    order = np.lexsort((code, own))
    code, own = code[order], own[order]
    cuts = np.searchsorted(own, np.arange(1, len(payloads)))
    return np.split(code, cuts)


STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprint array<long>"


def _stored(batch: pa.RecordBatch) -> Iterator[tuple[list, list[int], list[bytes]]]:
    data, offsets = utf8(batch.column("text"))
    ids = batch.column("doc_id").to_pylist()
    for lo, hi in pieces(offsets):
        raw = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)]
        yield ids[lo:hi], [len(r) for r in raw], [write_wav(padded(r)) for r in raw]


def _read(ids: list, sizes: list[int], media: list[bytes]) -> pa.RecordBatch:
    payloads = [read_wav(m) for m in media]
    prints = fingerprints(payloads)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array([len(p) for p in payloads], pa.int64()),
            pa.array([sha(p) for p in payloads], pa.string()), pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
            pa.array([len(m) for m in media], pa.int64()), pa.array([sha(m) for m in media], pa.string()),
            list_array(np.concatenate(prints), np.array([len(p) for p in prints]), pa.int64()),
        ],
        names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprint"],
    )


def store(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the WAV file of every text, for writing to a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, media in _stored(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    bound_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, STORED)


def read(stored: DataFrame) -> DataFrame:
    """Checksums and fingerprints from WAV files, as `store` made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, media = (batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))
            ends = np.concatenate([[0], np.cumsum([len(m) for m in media])])
            for lo, hi in pieces(ends):
                yield _read(ids[lo:hi], sizes[lo:hi], media[lo:hi])

    bound_batches(stored.sparkSession)
    return stored.mapInArrow(run, READ)


def store_and_read(documents: DataFrame) -> DataFrame:
    """`read(store(documents))` in one pass: each file goes through the wave module both ways, but not to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stored in _stored(batch):
                yield _read(*stored)
            trim()

    bound_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, READ)


def digest(fingerprint: Column) -> Column:
    """A fingerprint as one string: its length and a hash of its codes."""
    return F.concat_ws(":", F.size(fingerprint), F.sha2(F.array_join(fingerprint, ","), 256))
