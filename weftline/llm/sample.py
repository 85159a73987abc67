"""Bounded samples of labelled rows, the same whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_hash(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The rows with the n smallest hashes of a key, one for each key value.

    The cut is found from the key column alone, so texts of other rows are
    neither shuffled nor sent to the driver. Rows with a null key are never
    taken; ties can't exceed the bound because a key value counts once, with the least of its rows.
    """
    h = F.xxhash64(key)
    keys = rows.where(F.col(key).isNotNull())
    cut = keys.select(h.alias("h")).distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    if cut is None:
        return keys.limit(0)
    least = F.min(F.struct(*(c for c in keys.columns if c != key))).alias("_least")
    return keys.where(h <= cut).groupBy(key).agg(least).select(key, "_least.*").select(*keys.columns)
