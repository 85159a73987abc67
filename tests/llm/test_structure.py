"""Conversation repair, mixing and the Merkle manifest against brute force and SQL, with awkward rows."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.llm import merkle, mixing, oracles, queries, repair

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def rows_of(frame, sort=True):
    found = [tuple(r) for r in frame.collect()]
    return sorted(found, key=repr) if sort else found


def through(spark, tmp_path, tables, name):
    """A query's rows and its SQL's rows, over tables given as frames."""
    folder = str(tmp_path / name)
    for t, frame in tables.items():
        frame.write.parquet(f"{folder}/{t}.parquet")
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, folder)
    want = con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    return rows_of(got.select(*columns)), sorted(con.sql(f"SELECT {', '.join(columns)} FROM want").fetchall(), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", ["op11_conversation_structure_repair", "op12_mixing_sources", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(queries.ORACLES[name])
    assert rows_of(got.select(*columns)) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM want").fetchall(), key=repr)


# --- Merkle manifest

def tree_root(nodes):
    """The root, and for each leaf its siblings (left, right) level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = i // 16 * 16
            paths[leaf].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])))
        nodes, at = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)], [i // 16 for i in at]
    return nodes[0], paths


def manifest(rows):
    """What op13 is to return, row by row."""
    leaf = lambda r, text: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_root([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, tops = tree_root([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for (_, _, h, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r, None if r[1] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[1])) if tampered else h
            for left, right in path + top:
                node = sha(left + node + right)
            out.append((r[0], h, trees[g][0], root, sha("".join(a + b for a, b in path + top)), node, node == root))
    return sorted(out, key=repr)


def test_manifest_equals_brute_force(spark, tmp_path):
    sizes = {None: 3, "": 1, "one": 1, "é": 16, "run": 17, "Z": 256, "block": 257, "large": 4_400}
    rows, ids = [], itertools.count()
    for source, n in sizes.items():
        rows += [(next(ids), random.Random(i).choice(["Text A", "", None, "日本 X", "ß" * 50]), "en" if i % 3 else None, source, i if i % 4 else None) for i in range(n)]
    rows += [rows[5]] * 3 + [(None, "x", "y", "run", 1), (None, "x", "y", "run", 1), (7, "other", None, "run", 2), (5, "long " * 100_000, "en", "Z", 9)]
    rows += [(10_000 + i, f"t{i}", "en", f"s{i:03d}", i) for i in range(300)]  # more sources than a block holds
    random.Random(1).shuffle(rows)
    clash = {c: F.lit("x") for c in ("tree", "start", "total", "row", "payload", "order", "digest", "path", "carry", "key", "leaf", "altered", "group", "block", "root")}
    got, want = through(spark, tmp_path, {"documents": spark.createDataFrame(rows, DOCS).repartition(5).withColumns(clash)}, "op13_merkle_manifest")
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    brute = sorted([tuple(dict(zip(columns, r))[c] for c in sorted(columns)) for r in manifest(rows)], key=repr)
    assert got == brute and want == brute
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    one = spark.createDataFrame([(4, None, None, None, None)], DOCS)
    assert through(spark, tmp_path / "one", {"documents": one}, "op13_merkle_manifest")[0] == [tuple(dict(zip(("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"), manifest([tuple(one.first())])[0]))[c] for c in sorted(("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")))]
    assert through(spark, tmp_path / "none", {"documents": one.limit(0)}, "op13_merkle_manifest")[0] == []


def test_a_changed_field_or_order_changes_the_root(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 2}", i) for i in range(40)]
    def root(rows):
        frame = spark.createDataFrame(rows, DOCS)
        return {r["root"] for r in merkle.verify(frame, queries.LEAF, "source", "doc_id", F.lit(None).cast("string")).collect()}
    base = root(rows)
    assert len(base) == 1 and root(rows[::-1]) == base
    for changed in ([*rows[:-1], (39, "text 39", "en", "s1", 40)], [*rows, rows[0]]):
        assert root(changed) != base


# --- mixing

def mixed_documents(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.choice([0, 1, 3, 40, 300, 900]))), "en", r.choice(["b", "b", "b", "a", "a", "a", "é", "", None]), 1) for i in range(150)]
    rows += [(900, "long\tword\n" * 1_000, "en", "b", 1), (901, None, "en", "void", 1), (902, "", "en", "void", 1), (903, "\x0b \x1f é", "en", "tiny", 1)]
    rows += [(904, "same words here", "en", "a", 1)] * 5 + [(904, "other", "en", "a", 1), (None, "no id", "en", None, 1), (None, None, None, None, None)]
    clash = {c: F.lit("x") for c in ("key", "size", "digest", "row", "start", "total", "target", "taken", "block", "shard", "slot", "words", "low", "first", "all", "n", "weight")}
    return rows, spark.createDataFrame(rows, DOCS).repartition(4).withColumns(clash)


def test_mix_equals_its_sql_and_keeps_its_limits(spark, tmp_path):
    rows, frame = mixed_documents(spark)
    got, want = through(spark, tmp_path, {"documents": frame}, "op12_mixing_sources")
    assert got == want and len(got) == len(rows)
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    by = collections.defaultdict(list)
    for doc_id, n, source, source_size, taken, target in got:
        by[source].append((n, taken, source_size, target))
        assert 0 <= taken <= 2 * n
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weights, left, open_ = dict(zip(order, itertools.cycle((3, 1, 2)))), 1.5 * sum(sizes.values()), set(order)
    targets = {}
    while True:  # as the rule is told: cap, share anew, until none is above
        unit = left / sum(weights[s] for s in open_)
        above = {s for s in open_ if unit * weights[s] > 2 * sizes[s]}
        if not above:
            break
        open_ -= above
        left -= sum(2 * sizes[s] for s in above)
        targets |= {s: 2.0 * sizes[s] for s in above}
    targets |= {s: unit * weights[s] for s in open_}
    assert any(s not in open_ for s in order) and len(open_) > 1
    for s in order:
        assert {x[2] for x in by[s]} == {sizes[s]} and {round(x[3], 6) for x in by[s]} == {round(targets[s], 6)}
        assert abs(sum(x[1] for x in by[s]) - targets[s]) <= 0.5


def test_blocks_of_a_mix_hold_the_words_that_it_takes(spark):
    rows, frame = mixed_documents(spark)
    mix = mixing.mix(frame, slots=7)
    texts = mix.texts(frame).collect()
    words = {(r["shard"], r["slot"]): r["text"].split(" ") for r in texts}
    slots = {(r["shard"], r["slot"]): r for r in mix.slots.collect()}
    assert {k: len(v) for k, v in words.items()} == {k: r["words"] for k, r in slots.items()} and len(texts) == len(slots)
    shards = collections.Counter(k[0] for k in slots)
    assert set(shards) == set(range(len(shards))) and all(n == 7 for s, n in shards.items() if s < max(shards))
    have, taken = collections.Counter(), collections.Counter(w for v in words.values() for w in v)
    for r in rows:
        have.update(re.findall("[^\x20\x09-\x0d]+", r[1] or ""))
    assert all(n <= 2 * have[w] for w, n in taken.items()) and taken["long"] + taken["word"] > 0
    counts = mix.counts().groupBy("key").sum("n").collect()
    assert sum(r["sum(n)"] for r in counts) == len(slots)
    used = collections.Counter((r["key"], r["pass"], r["block"]) for r in slots.values())
    assert max(used.values()) == 1
    assert rows_of(mixing.mix(frame.repartition(2), slots=7).taken().select("doc_id", "size", "source", "taken")) == rows_of(mix.taken().select("doc_id", "size", "source", "taken"))


@pytest.mark.parametrize("n", [1, 2, 3, 16, 257])
def test_permutations_are_permutations(spark, n):
    frame = spark.range(n).withColumn("n", F.lit(n).cast("long")).withColumn("keys", mixing.keys_of(F.col("n"), F.lit("a")))
    places = [r[0] for r in frame.orderBy("id").select(mixing.permuted(F.col("id"), F.col("n"), F.col("keys"), F.lit("a"))).collect()]
    assert sorted(places) == list(range(n)) and (n < 16 or sum(abs(a - b) for a, b in enumerate(places)) > n * n / 6)


def test_mix_of_no_documents_and_of_no_words(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixing.mix(none).taken().count() == 0
    assert rows_of(mixing.mix(spark.createDataFrame([(1, None, "en", "s", 0)], DOCS)).taken().select("doc_id", "size", "source_size", "target", "taken")) == [(1, 0, 0, 0.0, 0)]


# --- conversation repair

def cheapest(rows):
    """(cost, audit) by trying each edit of each row, from the last row back; no matrices, no shared suffixes."""
    nexts = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {}

    def suffix(i, state, inserts):
        if (i, state, inserts) in best:
            return best[i, state, inserts]
        found = [(0, "")] if i == len(rows) and state in (0, 3) else []
        fill = 3 if state == 2 else 2
        if inserts < 2:
            cost, letters = suffix(i, fill, inserts + 1)
            found.append((cost + 3, "I" + letters))
        if i < len(rows):
            role, fault = rows[i]
            cost, letters = suffix(i + 1, state, 0)
            found.append((cost + 4, "D" + letters))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                cost, letters = suffix(i + 1, fill, 0)
                found.append((cost + 3 + more, "R" + letters))
                if role[:1] in nexts[state]:
                    cost, letters = suffix(i + 1, nexts[state][role[:1]], 0)
                    found.append((cost + more, "K" + letters))
        best[i, state, inserts] = min(found, default=(10**9, ""))
        return best[i, state, inserts]

    for i in range(len(rows), -1, -1):  # from the last row, so that no call goes deep
        for state in range(4):
            suffix(i, state, 0)
    return suffix(0, 0, 0)


def repaired(rows):
    """What op11 is to return, conversation by conversation."""
    groups = collections.defaultdict(list)
    blank = lambda v: " " if v is None else v
    for conv, turn, role, text in rows:
        group, kind = groups[conv], zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            group += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    out = []
    for conv, group in groups.items():
        group.sort()
        seen, faults = set(), []
        for _, _, role, text in group:
            last = re.findall("[^\x20\x09-\x0d]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for known, t, _, _ in group if known}
        cost, audit = cheapest([(g[2], f) for g, f in zip(group, faults)])
        lines, queue, state = [], list(zip(group, faults)), 0
        for letter in audit:
            if letter == "I":
                lines.append(("assistant:", "user:")[state != 2])
            else:
                (_, _, role, text), _ = queue.pop(0)
                if letter == "D":
                    continue
                role = role if letter == "K" else ("assistant", "user")[state != 2]
                lines.append(f"{role}:{text}")
            state = 1 if lines[-1][0] == "s" and letter == "K" else 3 if state == 2 else 2
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(group, group[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


def conversations(n, seed=5):
    r, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(r.choice([1, 2, 5, 9, 30])):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ufo", "Assistant"])
            text = r.choice(["Fine.", "Fine?", "cut off", " ", "", None, "日本。", f"All {turn}!", f"Well {turn}. \n", "\x1f"])
            rows.append((conv, r.choice([turn, turn, turn, None, turn // 2]), role, text))
    return rows + [(None, 1, "user", "a."), (None, None, "assistant", "b."), (None, 2, None, None)]


def test_repair_equals_brute_force_and_sql(spark, tmp_path):
    rows = conversations(150)
    clash = {c: F.lit("x") for c in ("key", "position", "total", "kind", "block", "codes", "first", "row", "start", "audit", "cost", "copy", "digest")}
    frame = spark.createDataFrame(rows, CONVERSATIONS).repartition(3).withColumns(clash)
    got, want = through(spark, tmp_path, {"conversations": frame}, "op11_conversation_structure_repair")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    brute = sorted([tuple(dict(zip(columns, r))[c] for c in sorted(columns)) for r in repaired(rows)], key=repr)
    assert got == brute and want == brute
    assert {"K", "D", "I", "R"} <= set("".join(r[0] for r in got))


def test_repair_in_blocks_equals_repair_at_once(spark, monkeypatch):
    r = random.Random(8)
    rows = conversations(40, 6) + [(999, t, r.choice(["user", "assistant", "system"]), r.choice([f"Line {t}.", f"cut {t}", "Same."])) for t in range(900)]
    frame = spark.createDataFrame(rows, CONVERSATIONS)
    for size in (1, 3, 64):
        monkeypatch.setattr(repair, "BLOCK", size)
        assert rows_of(repair.repair(frame, repair.damage(frame))) == repaired(rows)


def test_repair_of_long_texts_dropped_rows_and_none(spark):
    dropped = next((c, t) for c in range(50) for t in range(50) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    rows = [(*dropped, "user", "gone."), (2_000, 5, "user", "word " * 200_000 + "end."), (2_000, 6, "assistant", "x." * 300_000)]
    frame = spark.createDataFrame(rows, CONVERSATIONS)
    found = rows_of(repair.repair(frame, repair.damage(frame)))
    assert found == repaired(rows) and (dropped[0], 0, 0, 0, 0, 0, 0, "", sha("")) in found
    assert repair.repair(frame.limit(0), repair.damage(frame.limit(0))).count() == 0


def test_costs_from_both_ends_agree():
    r = random.Random(2)
    for _ in range(300):
        codes = "".join(r.choice("suaxSUAXbd") for _ in range(r.randint(1, 9)))
        f, b = repair.forward(codes, [0, repair.FAR, repair.FAR, repair.FAR]), repair.backward(codes, repair._with_inserts(list(repair._ENDS)))
        assert all(min(x + y for x, y in zip(f[i], b[i])) == b[0][0] for i in range(len(codes) + 1))
