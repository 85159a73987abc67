"""Byte-level BPE encoding and decoding by DuckDB's recursive queries.

Texts are cut into words by the tokenizer's pattern, and words into fragments at
every place that no token of the vocabulary can span: a token over it would be
its two bytes, or hold one of the two byte triples across it. In each partition
the distinct new fragments go to an in-memory DuckDB as token-position rows, one
byte token a row at first. A recursive query joins adjacent tokens with the merge
table, contracts each fragment's leftmost pair of minimum rank, and ends when no
pair merges. For fragments of at most `SHORT` bytes a row holds a token and the
next one, so that a round needs no sort; every round's rows stay, and the last
ones of a fragment count. For longer fragments the query keeps only the present
tokens, and contracts from the leftmost pair on, in the same round, all further
pairs of that rank up to the first whose contraction makes a pair of lower rank:
just what contracting one after the other gives. An ordered aggregation of the
vocabulary's bytes decodes the id list of each document.

Rows are independent and nothing is shuffled. One query takes fragments of at
most `BYTES_AT_ONCE` bytes together, or one longer fragment, so its memory follows
the longest fragment, not the number of merges in it. A worker keeps the words that it
has encoded, up to `CACHE_TOKENS` tokens or `CACHE_WORDS` words; beyond that those used
most since stay, up to half of these bounds (what goes is encoded again, which only costs time).
Between tasks it keeps `IDLE_WORDS`: an executor may hold more idle workers than it has cores.

Defined results: null text is empty text, with no tokens; special tokens are
never produced; very long words are encoded whole; repeated rows and null ids give
rows like any other; extra columns are dropped; an empty table stays empty.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrow import bound_batches, claim, list_array, pieces, ragged, trim, utf8

CACHE_WORDS, CACHE_TOKENS = 300_000, 4_000_000
IDLE_WORDS = 50_000
#: Bytes of texts, of fragments and tokens of one step; every query has a cost of its own, and what it holds grows with its rows.
TEXT_AT_ONCE, BYTES_AT_ONCE, TOKENS_AT_ONCE = 1 << 20, 150_000, 125_000
#: Fragments of at most so many bytes keep the rows of all rounds: at most half as many for each byte.
SHORT = 32
ENCODE_SHORT = """
WITH RECURSIVE step(round, word, pos, tok, next) AS (
    SELECT 0::SMALLINT, word, pos::SMALLINT, tok, next FROM start
  UNION ALL (
    WITH least AS MATERIALIZED (SELECT word, min(merged::BIGINT << 16 | pos) AS hit FROM step JOIN merges ON l = tok AND r = next GROUP BY word),
    hits AS (SELECT word, hit & 65535 AS place, (hit >> 16)::INTEGER AS merged FROM least)
    SELECT (round + 1)::SMALLINT, word, (pos - (pos > place)::SMALLINT)::SMALLINT,
           CASE WHEN pos = place + 1 THEN merged ELSE tok END, CASE WHEN pos = place - 1 THEN merged ELSE next END
    FROM step JOIN hits USING (word) WHERE pos <> place))
SELECT word, list(tok ORDER BY pos) AS ids FROM step JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round)
GROUP BY word ORDER BY word
"""
#: `down` holds the merges that rank below one of their own parts: only they can go before a pair of a minimum rank.
ENCODE = """
WITH RECURSIVE step(place, word, tok) USING KEY (place) AS (
    SELECT word::BIGINT * 4294967296 + pos, word, tok FROM start
  UNION (
    WITH live AS MATERIALIZED (
        SELECT place, word, tok, lead({'place': place, 'word': word, 'tok': tok}) OVER (ORDER BY place) AS next
        FROM recurring.step WHERE tok >= 0 AND word IN (SELECT word FROM step)),
    pairs AS (SELECT place, live.word, next.place AS after, merged FROM live JOIN merges ON l = tok AND r = next.tok WHERE live.word = next.word),
    least AS (SELECT word, min(merged) AS merged, count(*) AS n FROM pairs GROUP BY word),
    hits AS MATERIALIZED (SELECT p.*, n FROM pairs p JOIN least USING (word, merged)),
    several AS MATERIALIZED (SELECT word FROM hits WHERE n > 1 GROUP BY word HAVING count(*) > 1),
    placed AS (SELECT place, row_number() OVER w AS k, lag(tok) OVER w AS before, lead(tok, 2) OVER w AS beyond
               FROM live WHERE word IN (SELECT word FROM several) WINDOW w AS (PARTITION BY word ORDER BY place)),
    runs AS (SELECT *, k - row_number() OVER (PARTITION BY word ORDER BY k) AS run FROM hits JOIN placed USING (place)),
    apart AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY k) % 2 = 1),
    joined AS (SELECT *, CASE WHEN lag(k) OVER (PARTITION BY word ORDER BY k) = k - 2 THEN merged ELSE before END AS left_tok FROM apart),
    marked AS (SELECT j.*, x.l IS NOT NULL OR y.l IS NOT NULL AS lowers FROM joined j
               LEFT JOIN down x ON x.l = j.left_tok AND x.r = j.merged LEFT JOIN down y ON y.l = j.merged AND y.r = j.beyond),
    done AS (SELECT place, word, after, merged FROM hits WHERE word NOT IN (SELECT word FROM several)
             UNION ALL SELECT place, word, after, merged FROM marked
             QUALIFY k <= coalesce(min(CASE WHEN lowers THEN k END) OVER (PARTITION BY word), k))
    SELECT place, word, merged FROM done UNION ALL SELECT after, word, -1 FROM done))
SELECT word, list(tok ORDER BY place) AS ids FROM step WHERE tok >= 0 GROUP BY word ORDER BY word
"""

DECODE = """
SELECT t.doc, string_agg(v.hex, '' ORDER BY t.pos) AS hex
FROM tokens t JOIN vocabulary v ON v.id = t.id GROUP BY t.doc ORDER BY t.doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """One worker's DuckDB with the merge table, and the words it has encoded."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.words = regex.compile(pattern).findall
        self.bytes_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        rows = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        l, r, merged = (np.array(x, np.int32) for x in zip(*rows, strict=True))  # noqa: E741
        below = merged < np.maximum(l, r)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB"})
        self._table("merges", l=l, r=r, merged=merged)
        self._table("down", l=l[below], r=r[below])
        self._table("vocabulary", id=np.fromiter(self.ranks.values(), np.int32), hex=pa.array([t.hex() for t in self.ranks]))
        self.two, self.three = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        for t in self.ranks:
            if len(t) == 2:
                self.two[int.from_bytes(t)] = True
            for i in range(len(t) - 2):
                self.three[int.from_bytes(t[i : i + 3])] = True
        self.clear()

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table({k: pa.array(v) for k, v in columns.items()}))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.sizes, self.uses = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _thin(self, most: int) -> None:
        """Keep the words used most, and more than once, up to so many and to half of the tokens that the store may hold."""
        order = np.argsort(-self.uses, kind="stable")[:most]
        at = np.sort(order[(self.uses[order] > 1) & (np.cumsum(self.sizes[order]) <= CACHE_TOKENS // 2)])
        held = list(self.index)
        self.index = {held[i]: k for k, i in enumerate(at.tolist())}
        self.ids, self.sizes = _gather(self.ids, self.sizes, at)
        self.uses = np.zeros(len(at), np.int64)

    def _cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where fragments begin: at the words' starts, and where no token can span."""
        d = data.astype(np.int64)
        two = d[:-1] << 8 | d[1:]
        spanned = self.two[two]
        if len(d) > 2:
            three = self.three[two[:-1] << 8 | d[2:]]
            spanned[1:] |= three
            spanned[:-1] |= three
        cut = np.append(True, ~spanned)
        cut[starts] = True
        return np.flatnonzero(cut)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each word, none of which is empty."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        rest = np.flatnonzero(whole < 0)
        ids, lengths = whole, np.ones(len(words), np.int64)
        if len(rest):
            some = [words[i] for i in rest]
            data = np.frombuffer(b"".join(some), np.uint8)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
            cuts = self._cuts(data, np.append(0, ends[:-1]))
            view = memoryview(data).tobytes()
            parts = [view[a:b] for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(data)).tolist(), strict=True)]
            distinct = {x: i for i, x in enumerate(dict.fromkeys(parts))}
            flat, sizes = self._contracted(list(distinct))
            at = np.fromiter((distinct[x] for x in parts), np.int64, len(parts))
            got, n = _gather(flat, sizes, at)
            lengths[rest] = np.add.reduceat(n, np.searchsorted(cuts, np.append(0, ends[:-1])))
            ids = np.repeat(whole, lengths)
            ids[ids < 0] = got
        return ids.astype(np.uint32), lengths

    def _contracted(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each distinct fragment."""
        lookup = self.ranks.get
        whole = np.fromiter((lookup(x, -1) for x in parts), np.int64, len(parts))
        sizes, found = np.ones(len(parts), np.int64), []
        rest = np.flatnonzero(whole < 0)
        length = np.fromiter((len(parts[i]) for i in rest), np.int64, len(rest))
        order = np.argsort(length, kind="stable")  # like lengths together: a query has as many rounds as its longest fragment asks for
        rest, length = rest[order], length[order]
        short = int(np.searchsorted(length, SHORT, "right"))
        for query, first, last in ((ENCODE_SHORT, 0, short), (ENCODE, short, len(rest))):
            for lo, hi in pieces(np.append(0, np.cumsum(length[first:last])), BYTES_AT_ONCE):
                some, n = rest[first + lo : first + hi], length[first + lo : first + hi]
                tok = self.bytes_id[np.frombuffer(b"".join([parts[i] for i in some]), np.uint8)]
                after = np.append(tok[1:], np.int32(-1))
                after[np.cumsum(n) - 1] = -1
                self._table("start", word=np.repeat(np.arange(len(n), dtype=np.int32), n), pos=ragged(np.zeros(len(n), np.int64), n).astype(np.int32), tok=tok, next=after)
                got = self.db.sql(query).to_arrow_table().column("ids").combine_chunks()
                sizes[some] = np.diff(got.offsets.to_numpy())
                found.append(got.flatten().to_numpy())
        starts = np.cumsum(sizes) - sizes
        ids = np.repeat(whole, sizes)
        if found:
            ids[ragged(starts[rest], sizes[rest])] = np.concatenate(found)
        return ids, sizes

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids."""
        out = []
        for lo, hi in pieces(np.append(0, np.cumsum(lengths)), TOKENS_AT_ONCE):
            n, first = lengths[lo:hi], int(lengths[:lo].sum())
            some = ids[first : first + int(n.sum())].astype(np.int32)
            self._table("tokens", doc=np.repeat(np.arange(hi - lo, dtype=np.int32), n), pos=np.arange(len(some), dtype=np.int32), id=some)
            got = dict(self.db.execute(DECODE).fetchall())
            out += [bytes.fromhex(got.get(i, "")) for i in range(hi - lo)]
        return out

    def idle(self) -> None:
        """Between tasks, let go of most words."""
        if len(self.index) > IDLE_WORDS or len(self.ids) > CACHE_TOKENS // 2:
            self._thin(IDLE_WORDS)
            trim()

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each text."""
        words = list(map(self.words, texts))
        flat = list(chain.from_iterable(words))
        new = set(flat).difference(self.index)
        if self.index and new and (len(self.index) + len(new) > CACHE_WORDS or len(self.ids) > CACHE_TOKENS):
            self._thin(CACHE_WORDS // 2)
            new = set(flat).difference(self.index)
        if new:
            some = list(new)
            ids, sizes = self.encode([w.encode() for w in some])
            self.index.update(zip(some, range(len(self.index), len(self.index) + len(some)), strict=True))
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.uses = np.append(self.uses, np.zeros(len(some), np.int64))
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        self.uses += np.bincount(at, minlength=len(self.uses))
        ids, n = _gather(self.ids, self.sizes, at)
        per = np.fromiter(map(len, words), np.int64, len(words))
        return ids, np.bincount(np.repeat(np.arange(len(texts)), per), n, len(texts)).astype(np.int64)


def _gather(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen lists, one after the other, and their sizes."""
    n = sizes[at]
    return flat[ragged((np.cumsum(sizes) - sizes)[at], n)], n


@lru_cache(1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _release() -> None:
    codec.cache_clear()  # the codec's database goes with it


ENCODED = "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(documents: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (null unless kept), n_tokens, ids_sha256 and the digest of the decoded ids."""
    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", _release)
        c = codec(path, pattern)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, hi in pieces(offsets, TEXT_AT_ONCE):
                ids, n = c.documents([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(lo, hi)])
                ids_at = np.concatenate([[0], np.cumsum(n)])
                ids_hex = [hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(ids_at, ids_at[1:], strict=False)]
                raw_hex = [hashlib.sha256(raw).hexdigest() for raw in c.decode(ids, n)]
                kept = list_array(ids.astype(np.int32), n, pa.int32()) if keep_ids else pa.nulls(hi - lo, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[lo:hi], pa.int64()), kept, pa.array(n, pa.int64()), pa.array(ids_hex), pa.array(raw_hex)],
                    names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            trim()
        c.idle()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of an ids column. Null ids give null; bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", _release)
        c = codec(path, pattern)
        for batch in batches:
            lists = batch.column("ids")
            lengths = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            raw = c.decode(lists.flatten().to_numpy(), lengths)
            texts = [x.decode(errors="replace") if ok else None for x, ok in zip(raw, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
