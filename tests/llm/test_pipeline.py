"""Each stage of the pipeline against what it promises, and the run against its stages."""

import os
import zlib

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "byte_level_bpe":
            assert out.columns == docs.columns
        docs = out
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] == counts[-3] and counts[-1] > 0.7 * counts[0]
    assert counts[1] == counts[0]  # every document of these tables has a letter
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_stages_equal_brute_force_on_their_own_input(spark):
    import hashlib
    import struct

    import tiktoken

    import test_llm as by_hand
    from weftline.llm import bpe, decontam
    from weftline.llm.queries import tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: by_hand.shingles(t) for i, t in rows.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(by_hand.components(pairs, sets).values()))

    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    clean = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, SF).collect()}
    lower = {i: (t or "").lower() for i, t in rows.items()}
    held = {i for i, t in lower.items() if any(x.lower() in t for x in items.values() if len(x) >= decontam.MIN_CHARS)}
    assert held and not held & clean
    index = decontam.Index(sorted(items.items()))
    for i in sorted(set(rows) - clean)[:12]:  # what goes holds an item within its budget, by the whole table of distances
        found = {x[1] for x in index.search(decontam._points(rows[i]), decontam.np.array([0, len(rows[i])]))}
        assert any(by_hand.edits(items[index.ids[n]].lower(), lower[i]) <= len(items[index.ids[n]]) // 10 for n in found)

    redacted = {r["doc_id"]: r["text"] for r in corpus_pipeline.secret_scan(spark, docs, SF).collect()}
    assert all(not [x for x in by_hand.base_spans(t) if "[SECRET]" not in (t or "")[x[0] : x[2] + 8]] for t in redacted.values())
    assert {i for i, t in rows.items() if by_hand.base_spans(t)} <= {i for i, t in redacted.items() if "[SECRET]" in (t or "")}

    path, pattern = tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in corpus_pipeline.tokens(spark, docs, SF).collect():
        ids = library.encode_ordinary(rows[r["doc_id"]] or "")
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


@pytest.mark.parametrize("langs", [[None] * 6, ["en"] * 6])
def test_language_stage_drops_only_documents_without_a_letter(spark, langs):
    texts = ["Some words here.", "日本語", None, "", "12 34 --", "x"]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0][:6]  # with a label, but none in the training fold
    rows = [(i, t, g, "s", len(t or "")) for i, t, g in zip(ids, texts, langs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.language(spark, docs, SF)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [ids[0], ids[1], ids[5]]


def test_language_stage_decides_by_its_prediction(spark):
    words = {"xx": "zor bel tamin okarel dun miska ", "yy": "qua lith nepo vurrin shae coule "}
    unseen = next(i for i in range(950, 999) if zlib.crc32(str(i).encode()) % 5 == 0)  # its label is in no learned row
    rows = [(i, words[g] * 9, g) for i in range(60) for g in ("xx", "yy")]
    rows = [(i, t, g) for i, (_, t, g) in enumerate(rows)]
    rows += [(900, words["xx"] * 9, "yy"), (unseen, words["xx"] * 9, "zz"), (902, words["yy"] * 9, None), (903, "日本語 テキスト", None), (904, "12 -- 7", "xx"), (905, None, "xx")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, lang string, count int, lang_pred_told int, score_told int, _judged int")
    out = corpus_pipeline.language(spark, docs, SF)
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == docs.columns and kept == set(range(120)) | {unseen, 902}
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF, languages=["yy"]).collect()} == {i for i in range(120) if i % 2} | {902}


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 2 + [(1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "Words that repeat here are few.", None, None, None)] + [(3, "Some more words, all of one row.", "en", "s", 1)] * 3])
def test_run_of_empty_null_and_repeated_rows(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "an item that no document holds"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ([2, 3] if rows else [])
