"""Mixing sources to target weights, block by block.  [native]

The words of each source, document after document, are packed into blocks of
`BLOCK` words. Targets share the mix among the sources by weight, at most
`most` times a source's size. The mix is a row of slots of one block each:
shards hold `SLOTS` of them, what a source gives to a shard is a multinomial
draw, and a source's slots take its blocks in the order of a pseudorandom
permutation of their indices, a new one for each pass over the source. Blocks
and slots are joined by (source, index); no text moves to plan a mix.

Independent multinomial draws would miss a target by a few percent where slots
are few, and would exceed the limit of a source that is at it in half of all
cases. The draws are therefore conditional on each source's total: one
permutation of all slots deals them to the shards, which gives exactly that law.
Permutations are swap-or-not networks: they fit any length, need no table, and
a slot is computed by itself, so nothing is sorted and reruns agree.

Defined results: a null text, or one without a word, has size 0 and is never
taken; a null source is a source, the last one. Repeated rows are each packed
(rows that tie in doc_id are ordered by size and text digest). A source's last
block may be short; it ends each pass, and the last slot of the last pass is
cut where the target, rounded to words, is reached. Columns beside doc_id,
text and source are ignored; an empty table gives an empty result. A very long
document spans many blocks and is dealt with as these.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.ordered import key_of, running
from weftline.llm.shared import Stored, cut

WORD = "[^\\x20\\x09-\\x0D]+"
#: Words of a block, slots of a shard, rounds of a permutation.
BLOCK, SLOTS, ROUNDS = 256, 4_096, 24
#: Slots are made from source rows in two steps, so that those of a large source come from many tasks, of about `_TASK` each.
_CHUNK, _TASK = 1_024, 65_536
#: Sources up to which their table is broadcast; a row is under 1 KB.
BROADCAST_SOURCES = 20_000
SEED = "mix"


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text) and the text's digest."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(text).alias("digest"))


def targets(sources: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """key, source, source_size, n (place from 0), target (words as a double) of every source.

    sources: key, source, source_size; weights repeat in the order of the sources,
    null last. Together they are to take share[0]/share[1] of all sizes. A source
    whose part would exceed `most` times its size stops there; the others share
    what is left, until none is above. All sums are exact integers.
    """
    placed, files = running(sources.select("key", "source", "source_size", F.lit("").alias("all"), F.col("source").isNull().alias("last")), "all", ["last", "source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("start") % len(weights) + 1).cast("int")).cast("decimal(38,0)")
    placed = cut(placed.select("key", "source", "source_size", F.col("start").alias("n"), weight.alias("weight")))
    files.discard()
    size, up, down = F.col("source_size").cast("decimal(38,0)"), *share
    whole = int(placed.agg(F.sum(size)).first()[0] or 0)
    capped, seen = F.lit(False), None
    while True:
        at_most, weights_left, n = placed.agg(F.sum(F.when(capped, size)), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))).first()
        # What a unit of weight gets is num / den.
        num, den = up * whole - down * most * int(at_most or 0), down * int(weights_left or 0)
        if n == seen or den == 0:
            break
        capped, seen = F.col("weight") * F.lit(num).cast("decimal(38,0)") > size * F.lit(most * den).cast("decimal(38,0)"), n
    part = (F.col("weight") * F.lit(num).cast("decimal(38,0)")).cast("double") / F.lit(float(den or 1))
    return placed.select("key", "source", "source_size", "n", F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(part).alias("target"))


def permuted(x: Column, n: Column, keys: Column, *names: Column) -> Column:
    """The place of x under a pseudorandom permutation of 0 .. n-1 (swap-or-not).

    In each round x and its partner (key - x mod n) swap, or don't, by a hash of the larger one.
    """

    def step(x: Column, k: Column) -> Column:
        partner = F.pmod(k["key"] - x, n)
        swap = F.ascii(F.md5(F.concat_ws(":", F.lit(SEED), *names, k["round"], F.greatest(x, partner)))) % 2 == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(keys, x, step)


def keys_of(n: Column, *names: Column) -> Column:
    """A key below n for each round; names tell permutations apart."""
    key = lambda r: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.lit("key"), *names, r)), 1, 12), 16, 10).cast("long") % n
    return F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: F.struct(r.alias("round"), key(r).alias("key")))


@dataclass
class Mix:
    """sources: key, source, source_size, n, target.
    slots: shard, slot, key, pass, block and the words taken from the block's start.
    pieces: what a block holds of a document: row, key, block, low and high in the block, first (the word of the document at low), doc_id, digest.
    rows: doc_id, source, size, digest, row, key of every document.
    """

    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame
    rows: DataFrame

    def counts(self) -> DataFrame:
        """shard, key, n: the blocks that a shard takes of each source."""
        return self.slots.groupBy("shard", "key").agg(F.count("*").alias("n"))

    def parts(self) -> DataFrame:
        """shard, slot, row, doc_id, digest, key, first, words: which words of which documents fill the mix."""
        words = F.least("high", "words") - F.col("low")
        return (
            self.pieces.join(self.slots.hint("merge"), ["key", "block"]).where("words > low")
            .select("shard", "slot", "low", "row", "doc_id", "digest", "key", "first", words.alias("words"))
        )

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target and taken of every document."""
        sums = self.parts().groupBy("row").agg(F.sum("words").alias("taken"))
        found = self.rows.join(sums.hint("merge"), "row", "left").join(self.sources.select("key", "source_size", "target"), "key")
        return found.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))

    def texts(self, documents: DataFrame) -> DataFrame:
        """shard, slot, source, text: the blocks of the mix, words joined by blanks."""
        text = F.coalesce("text", F.lit(""))
        texts = documents.select("doc_id", F.md5(text).alias("digest"), "text").dropDuplicates(["doc_id", "digest"])
        wanted = self.parts().groupBy("doc_id", "digest").agg(F.collect_list(F.struct("shard", "slot", "low", "key", "first", "words")).alias("parts"))
        # The array around the words makes the lambda's variable of them: they are found once for a document, not for each part.
        sliced = F.transform(
            F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))),
            lambda words: F.transform("parts", lambda p: F.struct(
                p["shard"].alias("shard"), p["slot"].alias("slot"), p["low"].alias("low"), p["key"].alias("key"),
                F.array_join(F.slice(words, (p["first"] + 1).cast("int"), p["words"].cast("int")), " ").alias("text"),
            )),
        )
        found = wanted.join(texts, (wanted["doc_id"].eqNullSafe(texts["doc_id"])) & (wanted["digest"] == texts["digest"])).select(F.inline(sliced[0]))
        whole = found.groupBy("shard", "slot", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "text"))), lambda p: p["text"]), " ").alias("text"))
        return whole.join(self.sources.select("key", "source"), "key").select("shard", "slot", "source", "text")


def _slots(sources: DataFrame, most: int, slots: int) -> DataFrame:
    spark = sources.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((sources.agg(F.sum("target")).first()[0] or 0) / BLOCK / _TASK))
    words = F.floor(F.col("target") + 0.5).cast("long")
    passes = sources.select(
        "key", F.col("source_size").alias("size"), F.expr(f"source_size div {BLOCK}").alias("full"),
        F.explode(F.array(*(F.struct(F.lit(p).alias("pass"), F.greatest(F.lit(0), F.least(words - p * F.col("source_size"), F.col("source_size"))).alias("left")) for p in range(most)))).alias("p"),
    ).select("key", "full", "p.*").where("left > 0").withColumn("count", F.expr(f"(left + {BLOCK - 1}) div {BLOCK}")).withColumn("all", F.lit(""))
    placed, _ = running(passes, "all", ["key", "pass"], "count")
    chunks = (
        placed.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (count - 1) div {_CHUNK})"))).repartition(tasks, "key", "pass", "chunk")
        .withColumn("keys", keys_of(F.greatest("full", F.lit(1)), "key", "pass")).withColumn("deal", keys_of(F.col("total"), F.lit("shards")))
    )
    each = chunks.withColumn("i", F.explode(F.expr(f"sequence(chunk * {_CHUNK}, least(count, (chunk + 1) * {_CHUNK}) - 1)")))
    block = F.when(F.col("i") < F.col("full"), permuted(F.col("i"), F.greatest("full", F.lit(1)), F.col("keys"), "key", "pass")).otherwise(F.col("full"))
    place = permuted(F.col("start") + F.col("i"), F.col("total"), F.col("deal"), F.lit("shards"))
    return each.select("key", "pass", block.alias("block"), F.least(F.lit(BLOCK), F.col("left") - F.col("i") * BLOCK).alias("words"), place.alias("place")).select(
        F.expr(f"place div {slots}").alias("shard"), F.expr(f"place % {slots}").alias("slot"), "key", "pass", "block", "words"
    )


def mix(documents: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, slots: int = SLOTS) -> Mix:
    """Plan a mix of (doc_id, text, source)."""
    rows = Stored(sized(documents).withColumn("key", key_of("source")))
    placed, files = running(rows.rows, "key", ["doc_id", "size", "digest"], "size")
    placed = cut(placed)
    rows.discard()
    files.discard()
    sources = cut(targets(placed.groupBy("key").agg(F.max("source").alias("source"), F.max("total").alias("source_size")), weights, share, most))
    few = sources.count() <= BROADCAST_SOURCES
    spans = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")))
    low = F.greatest(F.col("start") - F.col("block") * BLOCK, F.lit(0))
    pieces = spans.select(
        "row", "key", "block", low.alias("low"), F.least(F.col("start") + F.col("size") - F.col("block") * BLOCK, F.lit(BLOCK)).alias("high"),
        (F.col("block") * BLOCK + low - F.col("start")).alias("first"), "doc_id", "digest",
    )
    return Mix(F.broadcast(sources) if few else sources, cut(_slots(sources, most, slots)), pieces, placed.drop("start", "total"))
