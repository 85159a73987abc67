"""URL filters from expressions of host suffix and path prefix.  [native]

Each distinct (host, path) is expanded into one expression for every number of
host labels and every path length that occurs among the rules. The first
bytes of an expression's SHA-256 are the equi-join key against the rules; the
full digest confirms, and the longest confirmed rule decides.

Only DataFrame functions run. Urls are reduced to distinct (host, path) pairs
before they are expanded, so a url that a third of all rows hold is expanded
once. The rules are broadcast up to `BROADCAST_RULES` rows; beyond that the
join shuffles.

Defined results: a null url, or one without "://", has an empty host and path,
which fits no rule and gets the default verdict. Repeated rows each get their
own row. Extra columns are dropped; an empty table gives an empty result. A
host or path longer than every rule is expanded only to the rules' lengths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest rule table that is broadcast; a rule row is under 4 KB.
BROADCAST_RULES = 20_000
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(_rest(url), "^[^/?#]*", ""), "^[^?#]*", 0)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rules as a table; path starts with a slash."""
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `pages`.

    Of rules with equal length, the one with the longer host wins, then the
    larger string. A rule that is listed twice with two verdicts blocks.
    """
    rules = rules.where("rule_host is not null and rule_path is not null and verdict is not null")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))
    # Numbers of labels and lengths are few: both are bounded by the longest rule, not by the data.
    shape = rules.agg(
        F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
        F.count("*").alias("n"),
    ).first()
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shape["n"]:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    keyed = rules.select(
        F.concat("rule_host", "rule_path").alias("rule"),
        "rule_verdict",
        F.length("rule_host").alias("host_length"),
        F.sha2(F.concat("rule_host", "rule_path"), 256).alias("rule_digest"),
    ).withColumn("rule_key", F.substring("rule_digest", 1, PREFIX_HEX))
    if shape["n"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)

    n_labels = F.size(F.split("host", r"\."))
    suffixes = F.array_compact(F.array(*[F.when(n_labels >= k, F.substring_index("host", ".", -k)) for k in sorted(shape["labels"])]))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape["lengths"])]))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    expanded = (
        urls.where("host <> ''").select("host", "path").distinct()
        .select("host", "path", F.explode(expressions).alias("expression"))
        .withColumn("digest", F.sha2("expression", 256))
    )
    found = expanded.join(keyed, F.substring("digest", 1, PREFIX_HEX) == F.col("rule_key")).where("digest = rule_digest")
    best = found.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("l"), "host_length", "rule", "rule_verdict")).alias("best")
    )
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
