"""Language ID by rank-order profiles of n-grams.

A profile is a language's `RANKS` most frequent letter n-grams (n = 1, 2, 3;
words lower-cased and padded by a blank) in order of frequency. A document's
own most frequent n-grams are compared with each profile: a gram that stands
at rank i in one and j in the other costs |i - j|, one that a profile lacks
costs `RANKS`. The language of least distance wins.

Profiles are learned from all labelled documents; counting is distributed and
pre-aggregated, and what reaches the driver is languages x `RANKS` rows. Prediction reads each
whole text once and shuffles nothing.

Defined results: null text, or text without a letter, is `und` with score 0.
Ties go to the language that sorts first, equal counts to the smaller gram.
Repeated rows give repeated results; extra columns are dropped by `predict`.
With nothing to learn from, every document is `und` with score 0; `has_letter`
tells those without a letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.arrow import bound_batches, claim, trim

#: BITS hold a code of its own for every letter of Unicode.
RANKS, BITS = 300, 18
#: Code points that are counted at once.
STEP = 4 << 20


def training_fold(doc_id: str = "doc_id") -> Column:
    """Rows to learn from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    points = np.arange(0x110000, dtype=np.uint32)
    points[[not (i < 0xD800 or i > 0xDFFF) or not chr(i).isalpha() for i in range(0x110000)]] = 0
    return points


def _points(text: str) -> np.ndarray:
    """Code points of letters, with one 0 before, between and after words; empty without a letter."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    full = np.concatenate([[0], points, [0]]).astype(np.uint32)
    return full[np.concatenate([[True], (full[1:] != 0) | (full[:-1] != 0)])] if points.any() else points[:0]


def _grams(codes: np.ndarray) -> np.ndarray:
    """n-grams of codes below 2**BITS as integers; those of blanks alone are left out."""
    c = codes.astype(np.int64)
    two = (c[:-1] << BITS) | c[1:]
    three = (two[:-1] << BITS) | c[2:]
    one = c[c != 0]
    inner = c[1:-1] != 0  # a blank stands only at either end of a trigram
    return np.concatenate([one, two[two > 0] | (1 << 2 * BITS), three[inner] | (1 << 3 * BITS)])


def _ranked(grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n most frequent grams, most frequent first, and their counts."""
    values, counts = np.unique(grams, return_counts=True)
    order = np.argsort(-counts, kind="stable")[:n]
    return values[order], counts[order]


def _spell(gram: tuple[int, ...]) -> str:
    return "".join(chr(c) if c else " " for c in gram)


def learn(documents: DataFrame, ranks: int = RANKS) -> list[tuple[str, list[str]]]:
    """(lang, grams by rank) of every language of the documents' `lang` column."""
    bound_batches(documents.sparkSession)
    rows = documents.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():  # an id counts once, with its least row
        rows = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x")).select("x.*")

    def counts(by: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in by.items():
            c = np.concatenate(parts).astype(np.int64)
            grams = np.concatenate([c[c != 0], ((c[:-1] << 21) | c[1:] | (1 << 62))[(c[:-1] | c[1:]) != 0]])
            three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[c[1:-1] != 0]
            for values, kind in ((grams, 0), (three, 3)):
                v, n = np.unique(values, return_counts=True)
                spelled = [_spell(_parts(x, kind)) for x in v.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v), pa.string()), pa.array(spelled, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                if len(p := _points(text.as_py())):
                    by.setdefault(lang.as_py(), []).append(p)
                    held += len(p)
                if held >= STEP:
                    yield from counts(by)
                    by, held = {}, 0
                    trim()
        yield from counts(by)
        trim()

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= ranks)
    out: dict[str, list[str]] = {}
    for r in best.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return sorted(out.items())


def _parts(value: int, kind: int) -> tuple[int, ...]:
    mask = (1 << 21) - 1
    if kind == 3:
        return (value >> 42 & mask, value >> 21 & mask, value & mask)
    return (value >> 21 & mask, value & mask) if value >> 62 & 1 else (value,)


class Model:
    """Profiles as a table: rank of each gram that any profile holds (columns) in each language (rows).

    Every letter has a code of its own, those of the profiles first; `grams` are
    the profiles' grams in order, gram i has column i + 1, and column 0 is any other gram.
    """

    def __init__(self, profiles: list[tuple[str, list[str]]], ranks: int = RANKS):
        self.langs = [lang for lang, _ in profiles]
        self.ranks = ranks
        seen: dict[str, int] = {}
        for _, grams in profiles:
            for g in grams:
                for ch in g:
                    seen[ch] = seen.get(ch, 0) + 1
        seen.pop(" ", None)
        known = sorted(seen, key=lambda c: (-seen[c], c))
        letters = np.flatnonzero(_letters())
        rest = letters[~np.isin(letters, [ord(c) for c in known])]
        self.codes = np.zeros(0x110000, np.int32)
        self.codes[rest] = np.arange(len(known) + 1, len(known) + 1 + len(rest))
        for i, ch in enumerate(known):
            self.codes[ord(ch)] = i + 1
        index = {ch: i + 1 for i, ch in enumerate(known)} | {" ": 0}
        found: list[tuple[int, int, int]] = []
        for row, (_, grams) in enumerate(profiles):
            for rank, g in enumerate(grams):
                value = 0
                for ch in g:
                    value = value << BITS | index[ch]
                found.append((row, value | (0 if len(g) == 1 else 1 << len(g) * BITS), rank))
        self.grams = np.array(sorted({g for _, g, _ in found}), np.int64)
        self.table = np.full((len(profiles), len(self.grams) + 1), ranks, np.int64)
        for row, g, rank in found:
            self.table[row, self.column(np.array([g]))[0]] = rank

    def column(self, grams: np.ndarray) -> np.ndarray:
        """The column of each gram."""
        if not len(self.grams):
            return np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, at + 1, 0)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """The language, its lead over the next one, and its fit: 0 if none of the text's grams is in the profile, 1 if all are at their ranks."""
        points = _points(text) if text else ()
        if not len(points) or not self.langs:
            return "und", 0.0, 0.0
        top, _ = _ranked(_grams(self.codes[points]), self.ranks)
        ranks = self.table[:, self.column(top)]
        cost = np.where(ranks < self.ranks, np.abs(ranks - np.arange(len(top))), self.ranks).sum(axis=1)
        best = int(cost.argmin())
        second = np.partition(cost, 1)[1] if len(cost) > 1 else self.ranks * len(top)
        return self.langs[best], float(1.0 - cost[best] / second) if second else 0.0, float(1.0 - cost[best] / (self.ranks * len(top)))


def has_letter(text: str) -> Column:
    """Whether the text of a column holds a letter; false for null."""

    @F.arrow_udf("boolean")
    def lettered(texts: pa.Array) -> pa.Array:
        return pa.array([bool(t and any(map(str.isalpha, t))) for t in texts.to_pylist()], pa.bool_())

    return lettered(text)


_MODELS: dict[int, Model] = {}


def predict(documents: DataFrame, profiles: list[tuple[str, list[str]]], keep: list[str] | None = None, suffix: str = "") -> DataFrame:
    """The documents' `keep` columns (doc_id by default) with lang_pred, score and fit, whose names get the suffix against clashes.

    Only texts go to Python and only the two results come back; other columns stay where they are.
    """
    keep = ["doc_id"] if keep is None else keep
    bound_batches(documents.sparkSession)
    key = hash(str(profiles))

    @F.arrow_udf("struct<lang_pred: string, score: double, fit: double>")
    def judge(texts: pa.Array) -> pa.Array:
        claim("langid", _MODELS.clear)
        model = _MODELS.get(key)
        if model is None:
            _MODELS.clear()
            model = _MODELS[key] = Model(profiles)
        langs, *rest = zip(*(model.judge(t.as_py()) for t in texts), strict=True) if len(texts) else ((), (), ())
        trim()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), *(pa.array(x, pa.float64()) for x in rest)], names=["lang_pred", "score", "fit"])

    own = "_judged"
    while own in documents.columns:
        own += "_"
    judged = documents.withColumn(own, judge("text"))
    return judged.select(*keep, *(F.col(f"{own}.{c}").alias(f"{c}{suffix}") for c in ("lang_pred", "score", "fit")))
