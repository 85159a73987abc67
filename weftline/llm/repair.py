"""Conversation structure repair by the cheapest edits, on a bidirectional tight-arc DAG.

A conversation's rows are to become `(s?(ua)+)?` in role initials: at most one
system row, then user and assistant in turn. Node (i, state) of the DAG stands
before row i; arcs keep, rerole or delete the row, or insert an empty one.
Forward minimum costs F and backward minimum costs B tell all arcs of all
cheapest repairs: those with F + cost + B equal to the total, the tight ones. A
traversal starts from the set of the first node and at each step follows the
least edit letter of the frontier's tight arcs, which yields the ASCII-least of
all cheapest repairs.

Rows are range-partitioned by (conversation, turn) and cut into blocks of
`BLOCK`, one letter a row, so a conversation of any length spreads over many
tasks. A block's costs are a 4 x 4 matrix of entry and exit states; walks over
the sorted blocks of a conversation carry four costs from block to block,
forward and backward, and all arcs inside blocks are then found in parallel. Only
the digest of a repaired text, a SHA-256 by nature, reads a conversation in one
task, row by row as a stream.

Defined results: a null id is a conversation of its own; null turns come first;
a null role or text is one blank, so a row that must be deleted (blank) or can't
be kept. Rows that tie in turn are ordered by role and text. A repeated row is a
duplicate. Initials other than s, u and a are legal nowhere. An empty table gives
an empty result; columns beside conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrow import bound_batches
from weftline.llm.ordered import key_of, running
from weftline.llm.shared import Stored

BLOCK = 1_024
_SPACES = "\\x20\\x09-\\x0D"
#: What the edits cost; a truncated row that stays costs `TRUNCATED` besides.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 60
#: Next state for each initial. States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state after an inserted or reroled row, which the state before determines, and its role.
_FILL = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
_ENDS = (0, FAR, FAR, 0)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows after the damage that CRC-32 of `conv_id:turn` modulo 20 decides; nulls are one blank there.

    0 drops the row, 1 empties its text, 2 takes out `[.!?]`, 3 repeats the row, 4 makes its role user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _arcs(state: int, code: str) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) for what may become of a row; code: initial of a whole row, its capital if truncated, else blank or duplicate."""
    arcs = [("D", DELETE, state)]
    if code not in "bd":
        more = TRUNCATED * code.isupper()
        arcs.append(("R", REROLE + more, _FILL[state][0]))
        if (to := _NEXT[state].get(code.lower())) is not None:
            arcs.append(("K", more, to))
    return arcs


_ROW = {code: [_arcs(state, code) for state in range(4)] for code in "suaxSUAXbd"}


def _with_inserts(costs: list[int]) -> list[int]:
    """Least cost to the end from each state, if rows may be inserted first."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[_FILL[s][0]]) for s, c in enumerate(costs)]
    return costs


def backward(codes: str, after: list[int]) -> list[list[int]]:
    """B of the four states before each row and after the last, where `after` is known."""
    found = [list(after)]
    for code in reversed(codes):
        after = found[-1]
        found.append(_with_inserts([min(cost + after[to] for _, cost, to in _ROW[code][s]) for s in range(4)]))
    return found[::-1]


def forward(codes: str, before: list[int]) -> list[list[int]]:
    """F of the four states at each row and after the last; `before` is without the inserts at the first row."""
    found = []
    for code in (*codes, ""):
        at = list(before)
        for _ in range(3):
            for s in range(4):
                at[_FILL[s][0]] = min(at[_FILL[s][0]], at[s] + INSERT)
        found.append(at)
        if code:
            before = [FAR] * 4
            for s in range(4):
                for _, cost, to in _ROW[code][s]:
                    before[to] = min(before[to], at[s] + cost)
    found[-1] = before
    return found


@lru_cache(1 << 15)
def matrix(codes: str) -> list[int]:
    """Costs from each entry state to each exit state of a block, row by row."""
    to = [backward(codes, [0 if s == end else FAR for s in range(4)])[0] for end in range(4)]
    return [min(to[end][start], FAR) for start in range(4) for end in range(4)]


@lru_cache(1 << 15)
def traversal(codes: str, entry: int, before: tuple[int, ...], after: tuple[int, ...], last: bool) -> tuple[str, int]:
    """The letters of a block's least tight arcs from `entry`, and the state where they end; the last block ends by its inserts."""
    f, b = forward(codes, list(before)), backward(codes, list(after))
    total = f[0][entry] + b[0][entry]
    letters, frontier = [], {(0, entry)}
    while True:
        i, state = min(frontier)
        if i == len(codes) and (not last or b[i][state] == 0):
            return "".join(letters), state
        tight = []
        for i, state in frontier:
            cost = f[i][state] if i < len(codes) else total - b[i][state]
            arcs = [("I", INSERT, (i, _FILL[state][0]))]
            if i < len(codes):
                arcs += [(letter, c, (i + 1, to)) for letter, c, to in _ROW[codes[i]][state]]
            tight += [(letter, node) for letter, c, node in arcs if cost + c + b[node[0]][node[1]] == total]
        letters.append(least := min(letter for letter, _ in tight))
        frontier = {node for letter, node in tight if letter == least}


def _walked(rows: DataFrame, schema: str, step: Callable, order: list[Column], end: Callable | None = None) -> DataFrame:
    """The output of `step(state, row)` over each conversation's rows in order; the state, None at first, is all that is kept.

    step gives (state, output or None), `end(state)` an output after the last row of a conversation.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            out = []
            names = batch.schema.names
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict(zip(names, values))
                if row["key"] != key:
                    if end and key is not None:
                        out.append(end(key, state))
                    key, state = row["key"], None
                state, found = step(state, row)
                if found is not None:
                    out.append(found)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=to_arrow)
        if end and key is not None:
            yield pa.RecordBatch.from_pylist([end(key, state)], schema=to_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    to_arrow = to_arrow_schema(_parse_datatype_string(schema))
    return rows.repartition("key").sortWithinPartitions("key", *order).mapInArrow(walk, schema)


def _positioned(damaged: DataFrame) -> tuple[Stored, DataFrame]:
    """key, position, total, turn, role, text of each row, written; and key, block, codes, initials, turns of its blocks."""
    rows, files = running(damaged.withColumn("key", key_of("conv_id")), "key", ["turn", "role", "text"])
    stored = Stored(rows.select("key", F.col("start").alias("position"), "total", "turn", "role", "text"))
    files.discard()
    rows = stored.rows
    # A row is the first of its kind where a group's least position is its own: both sides of the join have distinct keys.
    first = rows.groupBy("key", "role", F.sha2("text", 256).alias("digest")).agg(F.min("position").alias("position")).select("key", "position", F.lit(True).alias("first"))
    ending = F.regexp_extract("text", f"([^{_SPACES}])[{_SPACES}]*\\z", 1)
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(ending == "", "b").when(F.col("first").isNull(), "d").when(ending.isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    coded = rows.select("key", "position", "total", "turn", initial.alias("initial"), "role", "text").join(first, ["key", "position"], "left")
    block, last = F.expr(f"position div {BLOCK}"), F.expr(f"position div {BLOCK} = (total - 1) div {BLOCK}")
    blocks = coded.select("key", block.alias("block"), last.alias("last"), F.struct("position", code.alias("code"), "initial", "turn").alias("row"))
    joined = lambda field: F.array_join(F.transform("rows", lambda r: r[field]), "")
    blocks = blocks.groupBy("key", "block", "last").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return stored, blocks.select("key", "block", "last", joined("code").alias("codes"), joined("initial").alias("initials"), F.transform("rows", lambda r: r["turn"]).alias("turns"))


def _apply(rows: DataFrame, schema: str, one: Callable[[dict], dict]) -> DataFrame:
    """One output row for each row, in place."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(row) for row in batch.to_pylist()], schema=to_arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    to_arrow = to_arrow_schema(_parse_datatype_string(schema))
    return rows.mapInArrow(each, schema)


def _facts(row: dict) -> dict:
    codes, initials, turns = row["codes"], row["initials"], [t for t in row["turns"] if t is not None]
    return {
        "key": row["key"], "block": row["block"], "last": row["last"], "codes": codes, "costs": matrix(codes),
        "blank": codes.count("b"), "duplicate": codes.count("d"), "truncated": sum(c.isupper() for c in codes),
        "illegal": sum(p not in ("su", "ua", "au") for p in map("".join, zip(initials, initials[1:]))), "ends": initials[0] + initials[-1],
        "distinct": len(set(turns)), "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
    }


_FACTS = "key string, block long, last boolean, codes string, costs array<long>, blank long, duplicate long, truncated long, illegal long, ends string, distinct long, low long, high long"


def _back(after: list[int] | None, row: dict) -> tuple[list[int], dict]:
    after = after or _with_inserts(list(_ENDS))
    before = [min(row["costs"][4 * s + e] + after[e] for e in range(4)) for s in range(4)]
    return before, {"key": row["key"], "block": row["block"], "last": row["last"], "codes": row["codes"], "costs": row["costs"], "after": after}


def _ahead(before: list[int] | None, row: dict) -> tuple[list[int], dict]:
    before = before or [0, FAR, FAR, FAR]
    then = [min(FAR, *(before[s] + row["costs"][4 * s + e] for s in range(4))) for e in range(4)]
    return then, {"key": row["key"], "block": row["block"], "last": row["last"], "codes": row["codes"], "before": before, "after": row["after"]}


def _options(row: dict) -> dict:
    """Letters and exit state of a block for each entry state that a cheapest repair can pass."""
    codes, before, after = row["codes"], tuple(row["before"]), tuple(row["after"])
    start = [f + b for f, b in zip(before, backward(codes, list(after))[0])]
    found = [traversal(codes, s, before, after, row["last"]) if c == min(start) < FAR else ("", 0) for s, c in enumerate(start)]
    return {"key": row["key"], "block": row["block"], "cost": min(start), "letters": [x for x, _ in found], "exits": [x for _, x in found]}


def _chosen(state: int | None, row: dict) -> tuple[int, dict]:
    entry = state or 0
    return row["exits"][entry], {"key": row["key"], "block": row["block"], "cost": row["cost"], "entry": entry, "letters": row["letters"][entry]}


def _summed(state: dict | None, row: dict) -> tuple[dict, None]:
    if state is None:
        return {k: row[k] for k in ("blank", "duplicate", "truncated", "illegal", "distinct", "low", "high")} | {"end": row["ends"][1]}, None
    for k in ("blank", "duplicate", "truncated", "illegal"):
        state[k] += row[k]
    state["illegal"] += state["end"] + row["ends"][0] not in ("su", "ua", "au")
    if row["low"] is not None:
        state["distinct"] += row["distinct"] - (state["high"] == row["low"])
        state |= {"low": row["low"] if state["low"] is None else state["low"], "high": row["high"]}
    return state | {"end": row["ends"][1]}, None


def _summary(key: str, s: dict) -> dict:
    gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["distinct"]
    return {"key": key, "gaps": gaps} | {k: s[k] for k in ("blank", "duplicate", "truncated", "illegal")}


def _lines(state: list | None, row: dict) -> tuple[list, dict | None]:
    """Hash and count a conversation's repaired lines; a block's letters stand before its rows."""
    if state is None:
        state = [hashlib.sha256(), 0, 0, "", 0]  # digest, lines, state, letters, place
    digest, _, _, letters, place = state

    def line(role: str, text: str) -> None:
        digest.update(("\n" if state[1] else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        state[1] += 1

    def inserted() -> None:
        while state[4] < len(state[3]) and state[3][state[4]] == "I":
            state[2], role = _FILL[state[2]]
            line(role, "")
            state[4] += 1

    if row["position"] is None:
        state[2:] = [row["entry"], row["text"], 0]
        inserted()
        return state, None
    letter = letters[place]
    state[4] += 1
    if letter == "K":
        line(row["role"], row["text"])
        state[2] = _NEXT[state[2]][row["role"][0]]
    elif letter == "R":
        state[2], role = _FILL[state[2]]
        line(role, row["text"])
    inserted()
    return state, None


def repair(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of `conversations`.

    damaged: its rows (conv_id, turn, role, text) as they are to be repaired, none null but ids and turns.
    """
    bound_batches(conversations.sparkSession)
    stored, blocks = _positioned(damaged)
    facts = Stored(_apply(blocks, _FACTS, _facts))
    light = facts.rows.select("key", "block", "last", "codes", "costs")
    after = _walked(light, "key string, block long, last boolean, codes string, costs array<long>, after array<long>", _back, [F.desc("block")])
    before = _walked(after, "key string, block long, last boolean, codes string, before array<long>, after array<long>", _ahead, [F.asc("block")])
    options = _apply(before, "key string, block long, cost long, letters array<string>, exits array<int>", _options)
    chosen = Stored(_walked(options, "key string, block long, cost long, entry int, letters string", _chosen, [F.asc("block")]))
    sums = _walked(
        facts.rows.drop("last", "codes", "costs"), "key string, gaps long, blank long, duplicate long, truncated long, illegal long", _summed, [F.asc("block")], _summary
    )
    audits = chosen.rows.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "letters"))), lambda b: b["letters"]), "").alias("audit"), F.max("cost").alias("cost"))
    lines = (
        stored.rows.select("key", F.expr(f"position div {BLOCK}").alias("block"), "position", "role", "text", F.lit(None).cast("int").alias("entry"))
        .unionByName(chosen.rows.select("key", "block", F.lit(None).cast("long").alias("position"), F.lit(None).cast("string").alias("role"), F.col("letters").alias("text"), "entry"))
    )
    hashes = _walked(lines, "key string, repaired_sha256 string", _lines, [F.asc("block"), F.asc_nulls_first("position")], lambda key, s: {"key": key, "repaired_sha256": s[0].hexdigest()})
    found = audits.join(sums, "key").join(hashes, "key")
    every = conversations.groupBy(key_of("conv_id").alias("key")).agg(F.first("conv_id").alias("conv_id")).join(found, "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
