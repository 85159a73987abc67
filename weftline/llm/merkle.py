"""Merkle dataset manifest of 16-way trees, by higher-order functions over blocks of leaves.

Rows become leaves (SHA-256 of their length-prefixed fields). Each group's
leaves, in order, form a tree, and the groups' roots in turn form the tree of
the dataset. Leaves are gathered into blocks of `BLOCK` consecutive ones; in a
block, `sequence`, `slice`, `transform` and `aggregate` collapse `DEPTH`
levels at once, and the block roots are the leaves of the next stage until
each tree has one node. Proofs go the other way: each block joins the path of
its own root and prepends the siblings of every member.

A stage's table is 1/256 of the one before; no array exceeds a block, and a
group of any size is spread over its blocks. Trees of all groups collapse
together, so the number of jobs follows the logarithm of the largest group.
Digests, not texts, are shuffled.

Defined results: a null field is `-`, so it differs from an empty one; a null
group comes first and is a group; null order values come first, and rows that
tie in them are ordered by leaf. Repeated rows each are a leaf. A group of one
row has its leaf as root, a dataset of one group that group's root; the last
run of a level may be of one node, which is hashed like any other. Columns that
aren't fields are ignored; an empty table gives an empty result. A text of any
length is hashed whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.ordered import key_of, running
from weftline.llm.shared import Stored

#: Children of a node (a power of two), levels a stage, nodes of a block.
FANOUT, DEPTH = 16, 2
BLOCK, _BITS = FANOUT**DEPTH, FANOUT.bit_length() - 1

#: One more level on top of `levels`, an array of arrays of digests.
_COLLAPSE = f"""concat(levels, array(transform(sequence(0, (size(element_at(levels, -1)) - 1) div {FANOUT}),
    i -> sha2(array_join(slice(element_at(levels, -1), i * {FANOUT} + 1, {FANOUT}), ''), 256))))"""
_LEVELS = f"""aggregate(slice(sequence(0, {DEPTH}), 1, depth), array(transform(members, m -> m.digest)), (levels, k) -> {_COLLAPSE})"""
#: For the member at place i, its siblings on each level of the block, left and right of it.
_PATH = f"""transform(slice(sequence(0, {DEPTH}), 1, depth), k -> struct(
    array_join(slice(levels[k], (shiftright(i, {_BITS} * (k + 1)) * {FANOUT}) + 1, shiftright(i, {_BITS} * k) % {FANOUT}), '') AS left,
    array_join(slice(levels[k], shiftright(i, {_BITS} * k) + 2, {FANOUT - 1} - shiftright(i, {_BITS} * k) % {FANOUT}), '') AS right))"""


def leaf(fields: Sequence[str], replaced: dict[str, Column] | None = None) -> Column:
    """The digest of a row's fields: each `-` if null, else its number of UTF-8 bytes, `:` and its text."""
    texts = [((replaced or {}).get(f, F.col(f))).cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


class Forest:
    """The trees of all groups: nodes (tree, start, total, digest, payload) collapsed stage by stage.

    `stages` hold the blocks of each stage in the shared folder, `roots` the one digest of each tree.
    """

    def __init__(self, nodes: DataFrame):
        self.stages = []
        while True:
            blocks = Stored(
                nodes.groupBy("tree", F.expr(f"start div {BLOCK}").alias("block"))
                .agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("start", "digest", "payload"))).alias("members"))
                .withColumn("depth", sum((F.col("total") > FANOUT**k).cast("int") for k in range(DEPTH)))
            )
            self.stages.append(blocks)
            roots = blocks.rows.select(
                "tree", F.col("block").alias("start"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"),
                F.expr(f"element_at({_LEVELS}, -1)[0]").alias("digest"), F.lit(0).alias("payload"),
            )
            if (blocks.rows.agg(F.max("total")).first()[0] or 0) <= BLOCK:
                break
            nodes = roots
        self.roots = roots.select("tree", "digest")

    def paths(self, above: DataFrame) -> DataFrame:
        """payload, digest, path and carry of every node of the first stage; above: (tree, path, carry) of each root.

        A path is the siblings (left, right) of a node, of its parent, and so on.
        """
        above = above.withColumn("block", F.lit(0).cast("long"))
        for blocks in reversed(self.stages):
            members = (
                blocks.rows.withColumn("levels", F.expr(_LEVELS)).join(above.hint("merge"), ["tree", "block"])
                .select("tree", "carry", F.expr(f"inline(transform(members, (m, i) -> struct(m.start AS block, m.digest AS digest, m.payload AS payload, concat({_PATH}, path) AS path)))"))
            )
            above = members.select("tree", "block", "path", "carry")
        return members.select("payload", "digest", "path", "carry")

    def discard(self) -> None:
        for blocks in self.stages:
            blocks.discard()


def proofs(rows: DataFrame, group: str, order: str) -> DataFrame:
    """payload, leaf, subroot, root and path of every row of (group, order, leaf, payload).

    Hash a leaf with its siblings along the path (`fold`) to get the root.
    """
    leaves = Stored(rows.select(key_of(group).alias("tree"), F.col(order).alias("order"), F.col("leaf").alias("digest"), "payload"))
    placed, files = running(leaves.rows, "tree", ["order", "digest", "payload"])
    groups = Forest(placed)
    files.discard()
    leaves.discard()
    subroots, more = running(groups.roots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("payload")), "tree", ["payload"])
    whole = Forest(subroots)
    more.discard()
    no_path = F.expr("cast(array() AS array<struct<left: string, right: string>>)")
    tops = whole.paths(whole.roots.select("tree", no_path.alias("path"), F.col("digest").alias("carry")))
    tops = tops.select(F.col("payload").alias("tree"), "path", F.struct(F.col("digest").alias("subroot"), F.col("carry").alias("root")).alias("carry"))
    return groups.paths(tops).select("payload", F.col("digest").alias("leaf"), "carry.subroot", "carry.root", "path")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, digest, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def verify(rows: DataFrame, fields: Sequence[str], group: str, order: str, altered: Column) -> DataFrame:
    """payload.key (the `order` value), leaf, subroot, root, path, folded_root, verified.

    altered: the digest that is presented in a row's place, or null for its own leaf.
    """
    named = rows.select(F.col(group).alias("group"), F.col(order).alias("key"), leaf(fields).alias("leaf"), altered.alias("altered"))
    proven = proofs(named.withColumn("payload", F.struct("key", "altered")), "group", "key")
    folded = proven.withColumn("folded_root", fold(F.coalesce("payload.altered", "leaf"), F.col("path")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
