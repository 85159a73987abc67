"""Running totals in a total order, within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import Stored


def key_of(column: str) -> Column:
    """A string that is never null, sorts as the column's text does, null first, and tells null from empty."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def running(rows: DataFrame, group: str, order: Sequence[str], value: str | None = None) -> tuple[DataFrame, Stored]:
    """The rows with `row` (their own number), `start` (the group's sum of `value` before the row) and `total` (the group's sum).

    Without `value` each row counts 1, so that `start` is its position from 0.
    `group` must not be null; nulls of `order` come first; rows that tie in all
    of `order` take an arbitrary but fixed order. Rows are range-partitioned,
    sorted and written once, so that a hot group spreads over many tasks; the
    sums of each (partition, group) give the offsets. The files may be
    discarded when the rows have been used.
    """
    keys = [F.asc_nulls_first(c) for c in (group, *order)]
    stored = Stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("row", F.monotonically_increasing_id()))
    value_of = F.lit(1).cast("long") if value is None else F.col(value)
    dealt = stored.rows.withColumn("_part", F.shiftright("row", 33))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        dealt.groupBy("_part", group).agg(F.sum(value_of).alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .withColumn("total", F.sum("_sum").over(Window.partitionBy(group))).drop("_sum")
    )
    within = Window.partitionBy("_part", group).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn("_inner", F.coalesce(F.sum(value_of).over(within), F.lit(0)))
    return inner.join(parts, ["_part", group]).withColumn("start", F.col("_inner") + F.col("_offset")).drop("_part", "_inner", "_offset"), stored
