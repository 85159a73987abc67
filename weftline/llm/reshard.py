"""Resharding by minimum-cost flow: new capacities, fewest bytes moved.

Law `bytes`: the new shards' sizes are near equal. Rows of every old shard are
dealt by hash into blocks. Block sizes give the old shards' sizes; a
minimum-cost flow from these to the new capacities (a byte that stays costs
nothing, one that moves costs 1) says how many bytes go from each old shard to
each new one. An old shard's rows, in block order, are then cut at the flow's
amounts, so a transfer is a run of blocks, of which the first and the last may
be divided between two shards.

Only block sums reach the driver: at most old shards x `MOST_BLOCKS` rows, whatever the
number of documents; the number of blocks follows that of rows. Texts are never shuffled, and a block holds about
`BLOCK_ROWS` rows: rows of equal id and text are counted, on the map side first, and told apart by their number, so
that they are dealt over all blocks of their old shard.

Defined results: null text has size 1; null ids and repeated rows are rows like any other; an empty table gives an empty result;
rows of equal id and text are interchangeable, and each gets its own slot. `rewrite` finds the rows of a table by
id, size and checksum, and numbers those that repeat; its own columns get other names where the table has theirs.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.ordered import running
from weftline.llm.shared import Stored, cut

BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 20_000, 16, 4_096
#: Equal rows that are told apart in one array.
COPIES = 1_000


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Amounts (from, to) that place all supply within the capacities at least cost.

    Successive shortest augmenting paths with potentials; cost(i, j) >= 0.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities don't hold the supply")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # edge: to, residual, cost, index of its reverse

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    left, potential = sum(supply), [0] * len(graph)
    while left:
        best: list[float] = [float("inf")] * len(graph)
        best[source] = 0
        via: dict[int, tuple[int, int]] = {}
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room and (t := d + price + potential[a] - potential[b]) < best[b]:
                    best[b], via[b] = t, (a, k)
                    heapq.heappush(heap, (t, b))
        potential = [p + int(d) if d < float("inf") else p for p, d in zip(potential, best, strict=True)]
        path, at, push = [], sink, left
        while at != source:
            a, k = via[at]
            push = min(push, graph[a][k][1])
            path.append((a, k))
            at = a
        for a, k in path:
            graph[a][k][1] -= push
            graph[graph[a][k][0]][graph[a][k][3]][1] += push
        left -= push
    return {(i, e[0] - n): f for i in range(n) for e in graph[i] if n <= e[0] < n + m and (f := graph[e[0]][e[3]][1])}


def sized(documents: DataFrame, *more: Column) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, and more columns."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *more)


def old_by_hash(n: int) -> Column:
    """An old layout of n shards, for tables that carry no shard column."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with copy: 0, 1, ... for rows that are equal, the same whatever the partitions."""
    equal = rows.groupBy("old_shard", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    chunk = equal.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    upto = F.least(F.lit(COPIES), F.col("n") - F.col("chunk") * COPIES) - 1
    return chunk.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), upto))).withColumn("copy", F.col("chunk") * COPIES + F.col("copy")).drop("n", "chunk")


def reshard(rows: DataFrame, old_shard: Column, n_new: int, blocks: int | None = None) -> DataFrame:
    """Rows of `sized` with old_shard, shard and slot.

    New shard j continues old shard j; a move is any other pair. Passes go
    over the rows without texts: one sums the blocks, one cuts them.
    """
    rows = rows.withColumn("old_shard", old_shard)
    if blocks is None:
        size = rows.agg(F.count("*").alias("n"), F.max("old_shard").alias("last")).first()
        blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-size["n"] // (BLOCK_ROWS * ((size["last"] or 0) + 1)))))
    rows = _numbered(rows).withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "copy"), F.lit(blocks)).cast("int"))
    sums = [(r["old_shard"], r["block"], r["b"]) for r in rows.groupBy("old_shard", "block").agg(F.sum("size").alias("b")).collect()]
    if not sums:
        return rows.select("doc_id", "size", "text_crc32", "old_shard", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    sums.sort()
    n_old = max(max(o for o, _, _ in sums) + 1, 1)
    supply = [0] * n_old
    starts = []
    for o, b, s in sums:
        starts.append((o, b, supply[o]))
        supply[o] += s
    total = sum(supply)
    capacity = [total // n_new + (j < total % n_new) for j in range(n_new)]
    flow = min_cost_flow(supply, capacity, lambda i, j: int(i != j))
    cuts: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for i in range(n_old):
        at = 0
        for j in range(n_new):
            if f := flow.get((i, j), 0):
                cuts[i].append((at, at + f, j))
                at += f

    spark = rows.sparkSession
    pieces = []  # for every block, the pieces of the flow that it overlaps: (offset of its first byte, [(end, shard)])
    sizes = {(o, b): s for o, b, s in sums}
    for o, b, start in starts:
        over = [(hi, j) for lo, hi, j in cuts[o] if hi > start and lo < start + sizes[o, b]]
        pieces.append((o, b, start, over))
    plan = spark.createDataFrame(pieces, "old_shard int, block int, start long, over array<struct<hi: long, shard: int>>")
    # A row belongs to the piece that holds its middle byte.
    order = Window.partitionBy("old_shard", "block").orderBy(F.xxhash64("doc_id", "text_crc32", "copy"), "doc_id", "text_crc32", "size", "copy")
    middle = F.col("start") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.expr("size div 2") - 1
    placed = (
        rows.join(F.broadcast(plan), ["old_shard", "block"]).withColumn("middle", middle)
        .withColumn("shard", F.coalesce(F.filter("over", lambda p: F.col("middle") < p["hi"])[0]["shard"], F.element_at("over", -1)["shard"]))
    )
    counts = defaultdict(dict)
    for r in placed.groupBy("shard", "old_shard", "block").count().collect():
        counts[r["shard"]][r["old_shard"], r["block"]] = r["count"]
    firsts = []
    for shard, by in counts.items():
        at = 0
        for (o, b), n in sorted(by.items()):
            firsts.append((shard, o, b, at))
            at += n
    first = spark.createDataFrame(firsts, "shard int, old_shard int, block int, first long")
    within = Window.partitionBy("old_shard", "block", "shard").orderBy("middle", "doc_id", "text_crc32", "copy")
    return placed.join(F.broadcast(first), ["shard", "old_shard", "block"]).select(
        "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.row_number().over(within) - 1).alias("slot")
    )


def own_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores as set it apart from a table's columns."""
    while name in taken:
        name += "_"
    return name


def rewrite(documents: DataFrame, placed: DataFrame, path: str) -> tuple[list[int], list[str]]:
    """Write the shards that gain or lose rows to `path`/shard=N; others keep their files.

    `placed` is `reshard` of the documents. Returns the shards written and the
    names of the columns shard, slot and old_shard in their files, which stand
    beside the documents' own. Every task that has rows of a shard writes a file
    of it, by slot, straight from the join: texts are shuffled once.
    """
    changed = placed.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct()
    affected = sorted(r["shard"] for r in changed.collect())
    names = [own_name(n, documents.columns) for n in ("shard", "slot", "old_shard")]

    def address(rows: DataFrame) -> Column:
        return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "size", "text_crc32")

    text = F.coalesce("text", F.lit(""))
    whole = F.struct(*documents.columns).alias("whole")
    here = documents.select(whole, "doc_id", (F.octet_length(text) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    here = here.select("whole", address(here).alias("address"))
    there = placed.select(address(placed).alias("address"), "shard", "slot", "old_shard")
    several = cut(there.groupBy("address").agg(F.count("*").alias("n")).where("n > 1").select("address"))
    wanted = there.where(F.col("shard").isin(affected))
    if several.isEmpty():
        found = here.join(wanted, "address")
    else:
        found = here.join(several, "address", "left_anti").join(wanted, "address")
        # Rows of one address are numbered on both sides, in any order: they are equal.
        copies = Stored(here.join(several, "address", "left_semi").withColumn("n", F.monotonically_increasing_id()))
        mine, _ = running(copies.rows, "address", ["n"])
        theirs, _ = running(there.join(several, "address", "left_semi"), "address", ["shard", "slot"])
        pairs = mine.select("whole", "address", "start").join(theirs.select("address", "start", "shard", "slot", "old_shard").where(F.col("shard").isin(affected)), ["address", "start"])
        found = found.unionByName(pairs.drop("start"))
    out = found.select(*(F.col("whole")[c].alias(c) for c in documents.columns), *(F.col(c).alias(n) for c, n in zip(("shard", "slot", "old_shard"), names)))
    out.sortWithinPartitions(*names[:2]).write.mode("overwrite").option("compression", "zstd").partitionBy(names[0]).parquet(path)
    return affected, names
