"""The queries opN_<name> over the driver's tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontam, langid, media, merkle, mixing, neardup, oracles, repair, reshard, secrets, suffixes, toxicity, urls
from weftline.llm.shared import cut, shared_folder

#: The rules that op1 is asked to judge by.
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), 85)


#: The layout that op4 starts from, by hash, and the one that it makes.
OLD_SHARDS, NEW_SHARDS = 6, 8


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The placement, of the shards that change as their rewritten files have it, of the others as they are."""
    documents = _table(spark, sf_dir, "documents")
    placed = cut(reshard.reshard(reshard.sized(documents), reshard.old_by_hash(OLD_SHARDS), NEW_SHARDS))
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    affected, (shard, slot, old) = reshard.rewrite(documents, placed, path)
    found = placed.where(~F.col("shard").isin(affected))
    if affected:
        files = spark.read.parquet(path)
        found = found.unionByName(reshard.sized(files, F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.col(old).alias("old_shard")))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_and_read(_table(spark, sf_dir, "documents"))
    return stored.withColumn("feature", media.digest(F.col("fingerprint")))


def tokenizer() -> tuple[str, str]:
    """The vocabulary's path and the word pattern that it goes with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), *tokenizer(), keep_ids=False).drop("ids")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return secrets.scan(documents, secrets.train(documents))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(_table(spark, sf_dir, "documents")).drop("spans")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    profiles = langid.learn(documents.where(langid.training_fold()))
    found = langid.predict(documents, profiles)
    return found.select("doc_id", (~F.coalesce(langid.training_fold(), F.lit(True))).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.train(documents, _table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select("doc_id", (~F.coalesce(langid.training_fold(), F.lit(True))).alias("held_out"), "score", "predicted")


def op11_conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return repair.repair(conversations, repair.damage(conversations))


def op12_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken", "source")


#: The fields of a manifest's leaf, in their order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    altered = F.when(tampered, merkle.leaf(LEAF, {"text": F.translate("text", urls.UPPER, urls.LOWER)}))
    proven = merkle.verify(documents, LEAF, "source", "doc_id", altered)
    return proven.select(
        F.col("payload.key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_benchmark_decontamination, op3_minhash_near_dedup, op4_sharding, op5_media_columns,
        op6_byte_level_bpe, op7_secret_scans, op8_suffix_array_dedup, op9_language_id, op10_toxicity,
        op11_conversation_structure_repair, op12_mixing_sources, op13_merkle_manifest,
    )
}

ORACLES: dict[str, str] = {
    "op1_url_filters": """
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
q AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT DISTINCT host, path FROM q),
best AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
         FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, q.host, q.path, rule, coalesce(rv, 'allow') AS verdict
FROM q LEFT JOIN best ON q.host = best.host AND q.path = best.path
""",
    "op11_conversation_structure_repair": oracles.REPAIR,
    "op12_mixing_sources": oracles.MIX,
    "op13_merkle_manifest": oracles.MERKLE,
}
