"""Consecutive row numbers without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postpulse.session import cut_lineage

_PLACE_BITS = 33  # monotonically_increasing_id: partition number above, place in the partition below


def number_rows(df: DataFrame, *order: Column | str, name: str = "row_number", first: int = 0) -> DataFrame:
    """``df`` with ``name``: the place of each row in the given order, counted from ``first``.

    Rows are range-partitioned and sorted once and stored; the rows of each
    partition are counted, and a partition's rows are numbered from the sum of
    the counts before it.  The window sees one row per partition.  Rows that are
    equal in ``order`` are numbered in no defined order: end it with a key.
    """
    at = F.monotonically_increasing_id()
    placed = cut_lineage(df.orderBy(*order).withColumn("_at", at), "numbered")
    task = F.shiftright("_at", _PLACE_BITS)
    counts = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    # one row per sorted partition
    joined = placed.join(F.broadcast(offsets), task == F.col("_task"))
    return joined.withColumn(name, F.col("_before") + place + F.lit(first)).drop("_at", "_task", "_before")
