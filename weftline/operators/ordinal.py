"""Places in a total order over all rows, without one partition that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.scratch import cut


def numbered(rows: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """Adds the place of each row in the order, from 0; nulls come first, rows that tie in all of `order` take any fixed order.

    Rows are range-partitioned, sorted and written once with their place in the
    partition; the partitions' sizes, one row each, give the offsets.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(sorted_).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # A row a partition of the rows.
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    here = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + here).drop("_part", "_at", "_before")


def joined(frames: DataFrame, segment: str, frame: str, source: Column) -> DataFrame:
    """segment, frame, source, ordinal, fault: all segments' frames as one sequence, keyed by (segment, frame).

    source: the frame's number in the whole. A fault is how a frame goes on from the one before: `repeat`
    (the same key again), `overlap` (a source frame that was there or lies back), `gap` (frames missing), else null.
    """
    rows = cut(numbered(frames.select(segment, frame, source.alias("source")), [segment, frame, "source"]))
    last = rows.select((F.col("ordinal") + 1).alias("ordinal"), F.col(segment).alias("_s"), F.col(frame).alias("_f"), F.col("source").alias("_n"))
    again = (F.col(segment) == F.col("_s")) & (F.col(frame) == F.col("_f"))
    fault = F.when(again, "repeat").when(F.col("source") <= F.col("_n"), "overlap").when(F.col("source") > F.col("_n") + 1, "gap")
    return rows.join(last, "ordinal", "left").select(segment, frame, "source", "ordinal", fault.alias("fault"))
