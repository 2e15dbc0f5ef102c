"""Global order without a global sort in one task: rows are cut into sorted ranges, whose sums are added up apart."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinmap.session import checkpointed

#: Rows of a range (about).
RANGE_ROWS = 200_000


def running_sum(df: DataFrame, key: str, ties: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before this one in order of ``key`` (nulls first), then ``ties``.

    Ranges are cut by the key and the ties, so that a run of one key may be many ranges; they are written, so that every later step sees
    the same ones. A window adds up within a range, and the ranges' sums, a row each, are added up first.
    """
    order = [F.col(key).asc_nulls_first(), *ties]
    ranges = max(1, math.ceil(df.count() / RANGE_ROWS))
    dealt = df.withColumn("_value", value).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = checkpointed(dealt.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))  # the number of the partition
    sums = placed.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    added = placed.withColumn("_in", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(before, "_range")
    return added.withColumn(name, F.col("_in") + F.col("_before")).drop("_value", "_at", "_range", "_in", "_before")


def dense_ids(df: DataFrame, key: str, ties: list[str], name: str) -> DataFrame:
    """Adds ``name``: gapless ids from 0 in order of ``key``, then ``ties``."""
    return running_sum(df, key, ties, F.lit(1), name)
