"""Secret scans: base patterns plus Markov models of random strings.  [native]

Base spans come from three patterns. For each kind the text is split at the
pattern, which gives the pieces between matches; with the matches themselves
the code-point offsets follow by summing lengths.

The method: a first-order character Markov model of random strings and one of
ordinary identifiers. A candidate is a run of 20 or more characters of
`[A-Za-z0-9+/_=-]` that holds a digit and a letter; its score is the mean
log-likelihood ratio of its transitions, and one from the threshold on is a span
of kind `markov`. Both models are trained from labelled samples. Random
strings are digests of a counter in hexadecimal and base64. Ordinary samples are
written as identifiers are (snake, kebab and path names, camel case, numbers and
dates between them): of the words of all documents, each with its count,
and of a list of words common in names, half and half. Each model keeps a
share `UNKNOWN` for characters at random, so that no single transition decides. The
threshold is the one that `FALSE_RATE` of held-out ordinary names reach; these are names of
all words that the models have not seen, and of the list.

Only DataFrame functions run: the table of ratios is a 128 x 128 array
literal, whatever the corpus, and only pair counts and rates reach the driver. Words are counted on the map side
before they are shuffled.

Defined results: null text is empty text and has no span; overlapping spans of
different kinds all stay; repeated rows and null ids each get a row; extra columns are
dropped by `scan` and kept by `redact`, whatever their names; an empty table gives an empty result,
with models trained on the list alone.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.shared import cut

#: The base patterns, in the order in which spans of one start are listed.
ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")

#: Random strings that are made for the models, and unseen ones that `rates` tries.
RANDOM_STRINGS, HELD_OUT = 4_000, 2_000
#: Words that are put in order together to make names of four.
NAMED_TOGETHER = 4_096
#: Share of held-out ordinary names that the threshold lets pass as secrets.
FALSE_RATE = 0.002
SMOOTHING, BACKOFF, UNKNOWN = 0.05, 4.0, 0.1
ALPHABET = 66  # letters, digits, + / _ =

#: Words common in names of files, functions and addresses.
NAME_WORDS = (
    "account action add all app archive article author auth base build button by cache category change channel check class client code common company config connection content "
    "control core count create current data date default delete doc document download email english error event example export file filter first form format frame from "
    "function get global group have header history html http id image import in init input install int is java json key language level library line link list local log map "
    "message method model module month name network new news node not note number object of open option order output page path product project query queue read report request "
    "resource response result review run schema script select send sequence server service session set show size source start state static status storage string system table "
    "tag task test text the type update upload url user value version video view window"
).split()


class Model(NamedTuple):
    """Log-likelihood ratio of each transition, by 128 * first + second, and the mean from which a candidate is a secret."""

    ratios: list[float]
    threshold: float


def _pairs(strings: DataFrame) -> dict[tuple[int, int], int]:
    """Weighted counts (column n) of adjacent ASCII codes: at most 128 * 128 rows reach the driver."""
    codes = strings.where(F.length("s") >= 2).select(F.transform(F.split("s", ""), lambda c: F.ascii(c)).alias("c"), "n").where("size(c) >= 2")
    pair = F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: a * 128 + b))
    rows = codes.select(pair.alias("p"), "n").where("p between 0 and 16383").groupBy("p").agg(F.sum("n").alias("n")).collect()
    return {divmod(r["p"], 128): r["n"] for r in rows}


def _log_model(samples: list[dict[tuple[int, int], float]]) -> list[list[float]]:
    """log P(second | first), samples of equal weight: shares that back off to those of the second character alone, and to chance."""
    counts: dict[tuple[int, int], float] = {}
    most = max((sum(c.values()) for c in samples), default=0)
    for c in samples:
        for k, n in c.items():
            counts[k] = counts.get(k, 0.0) + n * most / sum(c.values())
    single = [sum(counts.get((a, b), 0) for a in range(128)) for b in range(128)]
    alone = [(n + SMOOTHING) / (sum(single) + SMOOTHING * ALPHABET) for n in single]
    out = []
    for a in range(128):
        total = sum(counts.get((a, b), 0) for b in range(128))
        out.append([math.log((1 - UNKNOWN) * (counts.get((a, b), 0) + BACKOFF * alone[b]) / (total + BACKOFF) + UNKNOWN / ALPHABET) for b in range(128)])
    return out


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS, first: int = 0) -> DataFrame:
    """Labelled random samples, columns s and n: digests of a counter in two alphabets, of 20 to 43 characters."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    text = F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).otherwise(F.regexp_replace(F.base64(F.unhex(digest)), "=+$", ""))
    return spark.range(first, first + n, 1, 2).select(F.substring(text, F.lit(1), (20 + F.col("id") % 24).cast("int")).alias("s"), F.lit(1).cast("long").alias("n"))


def words(documents: DataFrame) -> DataFrame:
    """word, n: the ASCII words that stand between blanks in all documents, and how often."""
    chunk = documents.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[\x20\x0A]")).alias("chunk")).where("length(chunk) between 2 and 20")
    word = F.lower(F.regexp_extract("chunk", r"^[('\"]?([A-Za-z][a-z]{1,15})[,.;:!?)'\"]*$", 1))
    return chunk.groupBy("chunk").agg(F.count("*").alias("n")).select(word.alias("word"), "n").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _listed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, 1) for w in NAME_WORDS], "word string, n long")


def held_out(word: Column) -> Column:
    """One of ten words is kept for the threshold."""
    return F.pmod(F.crc32(word.cast("binary")), F.lit(10)) == 0


def identifiers(words_: DataFrame) -> dict[tuple[int, int], float]:
    """Counts of adjacent codes in the words' names: as they stand beside separators, in camel case and capitals, numbers and dates between them.

    Only counts of letter pairs, of first pairs, and of first and last letters are gathered: at most 2 * 128 * 128 + 256 rows.
    """
    c = F.transform(F.split("word", ""), lambda x: F.ascii(x))
    pairs = _let(c, lambda c: F.concat(
        F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: a * 128 + b),
        F.array(16384 + F.get(c, 0) * 128 + F.get(c, 1), 32768 + F.get(c, 0), 32896 + F.element_at(c, -1)),
    ))
    rows = words_.select(F.explode(pairs).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n")).collect()
    inner, start, first, last = ({r["p"] - lo: r["n"] for r in rows if lo <= r["p"] < hi} for lo, hi in ((0, 16384), (16384, 32768), (32768, 32896), (32896, 33024)))
    out: dict[tuple[int, int], float] = {}

    def add(a: int, b: int, n: float) -> None:
        out[a, b] = out.get((a, b), 0.0) + n

    total, up = max(1, sum(last.values())), lambda x: x - 32
    digits, separators = range(48, 58), [ord(x) for x in "_-/"]
    for p, n in inner.items():
        add(*divmod(p, 128), 8 * n)  # as written
        add(*map(up, divmod(p, 128)), n)  # all capitals
    for p, n in start.items():
        a, b = divmod(p, 128)
        add(up(a), b, 3 * n)
    for a, n in first.items():
        for x in separators:
            add(x, a, 2 * n)
            add(x, up(a), n / 2)
        for d in digits:
            add(d, a, n / 60)
            add(d, up(a), n / 60)
        for b, m in last.items():
            add(b, up(a), 2 * n * m / total)
    for b, n in last.items():
        for x in separators:
            add(b, x, 2 * n)
            add(up(b), x, n / 2)
        for d in digits:
            add(b, d, n / 20)
            add(up(b), d, n / 60)
    for d in digits:
        for x in separators:
            add(x, d, total / 20)
            add(d, x, total / 20)
        for e in digits:
            add(d, e, total / 40)
        add(ord("v"), d, total / 40)
    return out


def names(words_: DataFrame) -> DataFrame:
    """Ordinary names, column s: of all words by fours (what is left over goes to the last), in snake, kebab, path and camel form with a number or date, as candidates have it."""
    groups = max(1, -(-words_.count() // NAMED_TOGETHER))
    some = words_.select("word", F.xxhash64("word").alias("h")).withColumn("g", F.pmod("h", F.lit(groups)))
    own = Window.partitionBy("g")
    place = F.floor((F.row_number().over(own.orderBy("h", "word")) - 1) / 4)
    last = F.greatest(F.floor(F.count("*").over(own) / 4) - 1, F.lit(0))
    fours = some.select((F.col("g") + groups * F.least(place, last)).alias("k"), "word").groupBy("k").agg(F.sort_array(F.collect_list("word")).alias("w"))
    number, year = (F.col("k") % 100).cast("string"), (1990 + F.col("k") % 40).cast("string")
    month = F.lpad((1 + F.col("k") % 12).cast("string"), 2, "0")
    camel = F.array_join(F.transform("w", lambda x: F.initcap(x)), "")
    forms = F.array(
        F.concat(F.array_join("w", "_"), F.lit("_"), number), F.concat(year, F.lit("-"), month, F.lit("-"), month, F.lit("-"), F.array_join("w", "-")),
        F.concat(F.lit("/"), year, F.lit("/"), month, F.lit("/"), F.array_join("w", "/")), F.concat(F.array_join("w", "/"), F.lit("/v"), number), F.concat(camel, number),
        F.concat(F.lower(F.element_at("w", 1)), camel, F.lit("V"), number), F.concat(F.upper(F.array_join("w", "_")), F.lit("_"), number),
    )
    return fours.select(F.element_at(forms, (1 + F.col("k") % 7).cast("int")).alias("s")).where("length(s) >= 20")


def train(documents: DataFrame) -> Model:
    """Both models and the threshold."""
    spark = documents.sparkSession
    counted, listed = cut(words(documents)), _listed(spark)
    seen = [identifiers(w.where(~held_out(F.col("word")))) for w in (counted, listed)]
    random, ordinary = _log_model([_pairs(random_strings(spark))]), _log_model(seen)
    ratios = [x - y for a, b in zip(random, ordinary, strict=True) for x, y in zip(a, b, strict=True)]
    kept = names(counted.where(held_out(F.col("word")))).unionByName(names(listed))
    reached = kept.select(_ratio(F.col("s"), _table(ratios)).alias("r")).agg(F.expr(f"percentile(round(r, 4), {1 - FALSE_RATE})")).first()[0]
    return Model(ratios, max(reached, 0.05) if reached is not None else 0.05)


def rates(spark: SparkSession, model: Model, ordinary: DataFrame, n: int = HELD_OUT) -> tuple[float, float]:
    """Shares of unseen random strings, and of ordinary names, that reach the threshold."""
    share = lambda s: s.agg(F.avg((_ratio(F.col("s"), _table(model.ratios)) >= model.threshold).cast("int"))).first()[0]
    return share(random_strings(spark, n, 10_000_000)), share(names(ordinary))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _before(lengths: Column) -> Column:
    """For each of the lengths the sum of those before it; in blocks, so that growing arrays stay short."""
    step, none = 256, F.array().cast("array<int>")
    run = lambda xs, first: F.aggregate(
        xs, F.struct(first.alias("at"), none.alias("out")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    )["out"]
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / step).cast("int")), lambda b: F.slice(lengths, b * step + 1, step))
    return F.when(F.size(lengths) > 0, _let(parts, lambda p: F.flatten(F.zip_with(p, run(F.transform(p, total), F.lit(0)), run)))).otherwise(none)


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """array<struct<start, kind, end, value>> of a pattern's kept matches."""
    def placed(hits: Column, gaps: Column, before: Column) -> Column:
        start = lambda i: F.get(before, i) + F.length(F.get(gaps, i))
        each = F.transform(hits, lambda h, i: F.struct(start(i).alias("start"), F.lit(kind).alias("kind"), (start(i) + F.length(h)).alias("end"), h.alias("value")))
        return F.filter(each, lambda x: keep(x["value"]))

    walk = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: _let(F.split(text, pattern, -1), lambda gaps: _let(
        _before(F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i)))), lambda before: placed(hits, gaps, before),
    )))
    return F.when(text.rlike(pattern), walk).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def _table(ratios: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded into one literal


def _ratio(token: Column, table: Column) -> Column:
    codes = F.filter(F.transform(F.split(token, ""), lambda c: F.ascii(c)), lambda c: c > 0)
    steps = _let(codes, lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.element_at(table, a * 128 + b + 1)))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.length(token) - 1, F.lit(1))


def find(documents: DataFrame, model: Model, base: str = "secret_base", spans: str = "secret_spans") -> DataFrame:
    """Adds two columns of these names, arrays of (start, kind, end, value): base spans, and all spans."""
    text = F.coalesce("text", F.lit(""))
    plain = F.concat(
        _spans(text, ASSIGN, 0, lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 6),
        _spans(text, ACCESS, 1, lambda v: F.length(v) >= 20),
        _spans(text, HEX, 2, lambda v: F.length(v) >= 24),
    )
    random = _spans(text, CANDIDATE, 3, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (_ratio(v, _table(model.ratios)) >= model.threshold))
    return documents.withColumn(base, F.sort_array(plain)).withColumn(spans, F.sort_array(F.concat(base, random)))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda k: F.size(F.filter("secret_base", lambda s: s["kind"] == k)).cast("long")
    return find(documents.select("doc_id", "text"), model).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("secret_base")), 256).alias("base_sha256"), _joined(F.col("secret_spans")).alias("spans"),
    )


def redact(documents: DataFrame, model: Model, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span, overlapping ones merged, replaced by a mark; n_chars follows where there is one."""
    base, spans = "secret_base", "secret_spans"
    while {base, spans} & set(documents.columns):
        base, spans = base + "_", spans + "_"
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int>>")
    merged = F.aggregate(  # spans come by start; one that begins before the last end widens the last
        spans, F.struct(F.lit(-1).alias("lo"), F.lit(0).alias("hi"), none.alias("out")),
        lambda acc, s: F.when((acc["lo"] >= 0) & (s["start"] < acc["hi"]), F.struct(acc["lo"].alias("lo"), F.greatest(acc["hi"], s["end"]).alias("hi"), acc["out"].alias("out")))
        .otherwise(F.struct(s["start"].alias("lo"), s["end"].alias("hi"), F.when(acc["lo"] >= 0, F.array_append(acc["out"], F.struct(acc["lo"].alias("start"), acc["hi"].alias("end")))).otherwise(acc["out"]).alias("out"))),
        lambda acc: F.array_append(acc["out"], F.struct(acc["lo"].alias("start"), acc["hi"].alias("end"))),
    )
    between = _let(merged, lambda m: F.array_append(
        F.transform(m, lambda x, i: F.substring(text, F.coalesce(F.get(m, i - 1)["end"], F.lit(0)) + 1, x["start"] - F.coalesce(F.get(m, i - 1)["end"], F.lit(0)))),
        F.substring(text, F.element_at(m, -1)["end"] + 1, F.length(text)),
    ))
    clean = F.when(F.size(spans) > 0, F.array_join(between, mark)).otherwise(F.col("text"))
    out = find(documents, model, base, spans).withColumn("text", clean)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)
