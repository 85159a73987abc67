"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel K(s, t) sums, over all subsequences of `ORDER` characters that two
strings share, LAMBDA to the power of the lengths they span in both: gaps and
inserted characters weaken a match but don't end it. Strings are words between
an opening and a closing mark, so that a word's begin and end count as characters.
Against a landmark l a word x scores min(1, K(x, l) / K(l, l)); these features are
whitened by the landmarks' own kernel matrix (Nyström) and go to a linear SVM.

A document is a bag of words. Its features are, for each landmark, the logarithm of 1 + the sum of its words'
scores to the power of `SHARPEN`, again a kernel: one insult can be enough, and pieces that stand in
clean documents too count by how often they stand. The SVM is trained on whole documents of both labels. A logistic
calibration, fitted on margins of samples left out of the SVM they come from, makes a margin a score.

Landmarks are pieces of words, of both labels and all languages: those of toxic
documents by likelihood ratio, one after the other over the words that hold none
of the ones before, which must stand `LIFT` times as often in toxic as in clean documents, but not be absent from these:
the SVM weighs that; and the clean words that come closest to these. Words are taken
as written, and with punctuation, repeated single letters ("i d i o t") and digits used as
letters undone.

Training uses at most `POSITIVE` toxic and `NEGATIVE` clean labelled documents,
those of smallest hash; only their distinct words reach the driver. Scoring
reads each whole text once and shuffles nothing. Before the kernel is
computed, a bit-parallel longest common subsequence finds the words that share
`ORDER` characters with a landmark; for all others the kernel is 0.

Defined results: null or empty text scores as a document whose words match no
landmark; a label of either kind missing, or no landmark found, gives score 0 everywhere; a document
that is labelled twice is toxic if either label says so, and of several texts under one labelled id
the least counts; null ids are scored and never learned from; a word of more than
32 characters is read in overlapping windows of 32; extra columns are dropped.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrow import mix
from weftline.llm.langid import training_fold
from weftline.llm.sample import by_hash

LAMBDA, ORDER = 0.66, 5
POSITIVE, NEGATIVE = 1_200, 2_500
#: Landmarks of toxic documents, and clean words beside them, at most; chance that a piece of no meaning becomes one.
LANDMARKS, CONTRASTS, CHANCE = 40, 8, 0.01
#: Least ratio of the rates at which toxic and clean documents hold a landmark: syllables of a language that is more often toxic have a small one.
LIFT = 3
#: Weights of a clean document, and of a landmark with a character inserted, against that of a toxic one.
CLEAN_WEIGHT, INSERTED_WEIGHT = 2.0, 0.5
SHARPEN, FOLDS = 2.5, 5
WINDOW, STRIDE = 32, 20
PIECE_MIN, PIECE_MAX = 5, 8
OPEN, CLOSE = "\x02", "\x03"

#: Characters that stand for letters in disguised words.
_LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_SPACED = re.compile(r"(?:(?<!\S)\w[.,\-_*]?\s+){2,}\w(?!\S)")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_LEET = str.maketrans(_LOOKS_LIKE)


def words(text: str | None) -> set[str]:
    """The distinct lower-case words of a text, as written and undisguised."""
    if not text:
        return set()
    text = text.lower()
    out = set()
    for chunk in set(text.split()):
        if chunk.isalpha():
            out.add(chunk)
            continue
        parts = [p for p in _NOT_LETTER.split(chunk) if p]
        out.update(parts)
        out.add("".join(parts))
        core = chunk.strip(".,;:?!\"'()[]|#%&*")
        digits = sum(c in _LOOKS_LIKE for c in core)
        if digits and 3 * digits <= 2 * len(core):
            out.add(_NOT_LETTER.sub("", core.translate(_LEET)))
    for m in _SPACED.finditer(text):
        out.add(_NOT_LETTER.sub("", m[0].translate(_LEET)))
    out.discard("")
    return out


def _windows(word: str) -> list[str]:
    """The marked word, or the overlapping windows of a long one."""
    word = OPEN + word + CLOSE
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW + STRIDE, STRIDE)]


def kernel(strings: np.ndarray, mark: np.ndarray, p: int = ORDER) -> np.ndarray:
    """K of every string (rows of codes, padded by 0) with one landmark; codes of 0 match nothing."""
    n, m = len(strings), len(mark)
    # prime[i][j]: the sum over subsequences of length i of (string so far, mark[:j]), each weighted to the end of both.
    prime = np.zeros((p, m + 1, n), np.float32)
    prime[0] = 1.0
    decay = np.tril(np.float32(LAMBDA) ** np.subtract.outer(np.arange(m), np.arange(m))).astype(np.float32)
    total = np.zeros(n, np.float32)
    for c in range(strings.shape[1]):
        same = (mark[:, None] == strings[None, :, c]) * np.float32(LAMBDA**2)
        total += (prime[p - 1, :m] * same).sum(axis=0)
        for i in range(p - 1, 0, -1):
            prime[i] *= np.float32(LAMBDA)
            prime[i, 1:] += decay @ (prime[i - 1, :m] * same)
    return total


class Landmarks:
    """Kernel scores of words against fixed landmarks."""

    def __init__(self, marks: list[str]):
        self.marks = marks
        letters = sorted(set("".join(marks)))
        self.lut = np.zeros(0x110000, np.uint16)
        self.lut[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.coded = [self._codes([m], len(m))[0] for m in marks]
        self.own = np.array([kernel(m[None, :], m)[0] for m in self.coded])
        self.bits = np.zeros((len(marks), len(letters) + 1), np.uint64)
        for k, m in enumerate(self.coded):
            for j, c in enumerate(m):
                self.bits[k, c] |= np.uint64(1) << np.uint64(j)

    def _codes(self, strings: list[str], width: int) -> np.ndarray:
        return self.lut[np.array(strings, f"U{width}").view(np.uint32).reshape(len(strings), width)]

    def whitening(self) -> np.ndarray:
        """The Nyström map: the landmarks' own kernel matrix to the power of -1/2, without its null space."""
        width = max(map(len, self.marks))
        codes = self._codes(self.marks, width)
        gram = np.array([kernel(codes, m) for m in self.coded])
        values, vectors = np.linalg.eigh((gram / np.sqrt(np.outer(self.own, self.own))) ** SHARPEN)
        keep = values > 1e-6
        return vectors[:, keep] / np.sqrt(values[keep])

    def _common(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Length of the longest common subsequence of each row with landmark k."""
        v = np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF))
        for c in range(codes.shape[1]):
            u = v & self.bits[k][codes[:, c]]
            v = (v + u) | (v - u)
        mask = np.uint64((1 << len(self.coded[k])) - 1)
        return np.bitwise_count(~v & mask)

    def features(self, words_: list[str]) -> tuple[list[str], np.ndarray]:
        """Those words that share a subsequence with any landmark, and their scores against each; the greatest of a long word's windows."""
        parts = [(i, x) for i, w in enumerate(words_) if len(w) + 2 >= ORDER for x in _windows(w)]
        owner = np.fromiter((i for i, _ in parts), np.int64, len(parts))
        size = np.fromiter((len(x) for _, x in parts), np.int64, len(parts))
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        with np.errstate(over="ignore"):
            for top, low in ((8, 0), (12, 8), (20, 12), (WINDOW, 20)):
                rows = np.flatnonzero((size > low) & (size <= top))
                for lo in range(0, len(rows), 32_768):
                    some = rows[lo : lo + 32_768]
                    codes = self._codes([parts[i][1] for i in some], top)
                    for k, mark in enumerate(self.coded):
                        close = np.flatnonzero(self._common(codes, k) >= ORDER)
                        if len(close):
                            found.append((owner[some[close]], k, np.minimum(1.0, kernel(codes[close], mark) / self.own[k])))
        held = np.unique(np.concatenate([f[0] for f in found])) if found else np.zeros(0, np.int64)
        out = np.zeros((len(held), len(self.marks)))
        for at, k, value in found:
            np.maximum.at(out[:, k], np.searchsorted(held, at), value)
        return [words_[i] for i in held], out


def _unlike(documents: list[set[str]]) -> list[set[str]]:
    """One of all documents that agree, under any of four hashes, in the two least hashed of their longer words: most near copies go."""
    seen: set[tuple[int, ...]] = set()
    out = []
    for ws in documents:
        if not ws:
            continue
        h = np.fromiter((zlib.crc32(w.encode()) for w in sorted(ws) if len(w) >= 8), np.uint64)
        keys = [(i, *np.sort(mix(h + np.uint64(i)))[:2].tolist()) for i in range(4)] if len(h) > 1 else []
        if not any(k in seen for k in keys):
            out.append(ws)
        seen.update(keys)
    return out


def _pieces(word: str) -> set[str]:
    w = OPEN + word + CLOSE
    return {w[i : i + n] for n in range(PIECE_MIN, PIECE_MAX + 1) for i in range(len(w) - n + 1)}


def _frequent(counts: Counter[str], enough) -> tuple[set[str], int]:
    """The pieces whose words' counts together are enough, and the number of distinct pieces: by hashes in arrays, for the pieces of all words are many."""
    names = list(counts)
    marked = [OPEN + w + CLOSE for w in names]
    text = "".join(marked)
    codes = np.array([text], f"U{len(text)}").view(np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(names), dtype=np.int32), np.fromiter(map(len, marked), np.int64, len(marked)))
    weight = np.fromiter((counts[w] for w in names), np.int64, len(names))
    found = []
    with np.errstate(over="ignore"):
        for n in range(PIECE_MIN, PIECE_MAX + 1):
            h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
            for i in range(n):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(h)])
            inside = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
            _, first, back = np.unique(h[inside], return_index=True, return_inverse=True)
            total = np.zeros(len(first), np.int64)
            np.add.at(total, back, weight[owner[inside]])
            found.append((n, inside[first], total))
    kinds = sum(len(t) for _, _, t in found)
    out: set[str] = set()
    for n, at, total in found:
        good = {t: enough(t, kinds) for t in np.unique(total).tolist()}
        out.update(text[i : i + n] for i, t in zip(at.tolist(), total.tolist(), strict=True) if good[t])
    return out, kinds


def _ratio(a: int, b: int, toxic: int, clean: int) -> float:
    """Twice the log likelihood ratio of a piece's rates in a of the toxic and b of the clean documents; 0 unless the toxic rate is `LIFT` times the clean one."""
    if a * clean < LIFT * b * toxic:
        return 0.0
    share = (a + b) / (toxic + clean)
    part = lambda x, e: x * math.log(x / e) if x else 0.0
    return 2 * (part(a, toxic * share) + part(b, clean * share) + part(toxic - a, toxic * (1 - share)) + part(clean - b, clean * (1 - share)))


def choose_landmarks(toxic: list[set[str]], clean: list[set[str]], most: int = LANDMARKS) -> list[str]:
    """Pieces of words that toxic documents hold more often than clean ones, by likelihood ratio; longer ones first among equals.

    Each is chosen over the words that hold none of those before, and only if chance would give
    no piece so great a ratio. Copies count once.
    """
    toxic, clean = _unlike(toxic), _unlike(clean)
    if not toxic or not clean:
        return []
    for_, against = Counter(w for ws in toxic for w in ws), Counter(w for ws in clean for w in ws)
    ratio = lambda a, b: _ratio(min(a, len(toxic)), min(b, len(clean)), len(toxic), len(clean))
    often, kinds = _frequent(for_, lambda total, kinds: ratio(total, 0) >= 2 * math.log(max(2, kinds) / CHANCE))
    least = 2 * math.log(max(2, kinds) / CHANCE)
    holds: dict[str, set[str]] = {}
    for w in for_:
        for g in _pieces(w) & often:
            holds.setdefault(g, set()).add(w)
    holds = {g: ws for g, ws in holds.items() if ratio(sum(for_[w] for w in ws), 0) >= least}
    other: Counter[str] = Counter()
    for w, n in against.items():
        for g in _pieces(w) & holds.keys():
            other[g] += n
    marks: list[str] = []
    while len(marks) < most:
        value = {g: ratio(sum(for_[w] for w in ws), other[g]) for g, ws in holds.items()}
        holds = {g: ws for g, ws in holds.items() if value[g] >= least}
        if not holds:
            break
        best = max(holds, key=lambda g: (value[g] * (1 + 0.05 * len(g)), g))
        marks.append(best)
        done = holds.pop(best)
        holds = {g: rest for g, ws in holds.items() if (rest := ws - done)}
    return marks


class Model:
    """Landmarks, the Nyström map, a linear SVM on documents and its logistic calibration."""

    def __init__(self, toxic: list[set[str]], clean: list[set[str]]):
        self.marks = choose_landmarks(toxic, clean) if toxic and clean else []
        if not self.marks:
            return
        insults = [m.strip(OPEN + CLOSE) for m in self.marks]
        self.marks += nearest(self.marks, clean)
        landmarks = Landmarks(self.marks)
        self.map = landmarks.whitening()
        # An insult alone, or with a character inserted, is still one, however many stand together in the samples.
        inserted = [{m} for m in insults] + [{m[:i] + "\x01" + m[i:]} for m in insults if len(m) >= ORDER for i in range(1, len(m))]
        x = self.documents(landmarks, toxic + clean + inserted)
        y = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean)), np.ones(len(inserted))])
        weight = np.where(y < 0, CLEAN_WEIGHT, 1.0)
        weight[len(toxic) + len(clean) :] = INSERTED_WEIGHT
        self.weights, self.bias = _svm(x, y, weight)
        margin = np.zeros(len(y))
        for fold in range(FOLDS):
            out = np.arange(len(y)) % FOLDS == fold
            w, bias = _svm(x[~out], y[~out], weight[~out])
            margin[out] = x[out] @ w + bias
        self.slope, self.offset = _logistic(margin, y)

    def documents(self, landmarks: Landmarks, documents: list[set[str]]) -> np.ndarray:
        """For each document and landmark the logarithm of 1 + the sum of its words' scores to the power of `SHARPEN`; whitened."""
        found, f = landmarks.features(sorted(set().union(*documents)))
        f **= SHARPEN
        row = {w: i for i, w in enumerate(found)}
        out = np.zeros((len(documents), len(self.marks)))
        for i, ws in enumerate(documents):
            held = [row[w] for w in ws if w in row]
            if held:
                out[i] = np.log1p(f[held].sum(axis=0))
        return out @ self.map

    def score(self, landmarks: Landmarks, documents: list[set[str]]) -> np.ndarray:
        """The probability that each document is toxic."""
        margin = self.documents(landmarks, documents) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50)))


def nearest(marks: list[str], clean: list[set[str]]) -> list[str]:
    """The clean words nearest to the landmarks, by kernel times the logarithm of the number of documents that hold them."""
    held = Counter(w for ws in clean for w in ws if PIECE_MIN <= len(w) + 2 <= PIECE_MAX)
    found, f = Landmarks(marks).features(sorted(held))
    near = f.max(axis=1) * np.log1p([held[w] for w in found]) if found else np.zeros(0)
    words_ = [OPEN + found[i] + CLOSE for i in np.argsort(-near, kind="stable")]
    return [w for w in words_ if w not in marks][:CONTRASTS]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 30.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM with a squared hinge on weighted samples, by Newton steps on the active set."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = c * weight
    w = np.zeros(x1.shape[1])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (x1 @ w) < 1
        xa, wa = x1[active], weight[active]
        new = np.linalg.solve(ridge + xa.T @ (wa[:, None] * xa), xa.T @ (wa * y[active]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of Platt's calibration with smoothed targets, by Newton's method."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        h = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * z).sum() + 1e-3 * a, (p - t).sum()])
        m = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        da, db = np.linalg.solve(m, g)
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def train(documents: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> Model:
    """A model from the labelled documents of the training fold."""
    known = labels.where(training_fold() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    some = by_hash(known.where("label = 1"), positive).unionByName(by_hash(known.where("label = 0"), negative))
    # At most positive + negative ids: safe to broadcast.
    rows = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(sorted(words(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.string())], names=["label", "words"])

    got = sorted((r["label"], r["words"]) for r in rows.select("label", "text").mapInArrow(reduce, "label int, words string").collect())
    return Model([set(w.split()) for v, w in got if v == 1], [set(w.split()) for v, w in got if v == 0])


_LANDMARKS: dict[tuple[str, ...], Landmarks] = {}


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple(model.marks)
        if key and key not in _LANDMARKS:
            _LANDMARKS.clear()
            _LANDMARKS[key] = Landmarks(model.marks)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                part = batch.slice(lo, 2_000)
                if key:
                    value = model.score(_LANDMARKS[key], [words(t.as_py()) for t in part.column("text")])
                else:
                    value = np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
