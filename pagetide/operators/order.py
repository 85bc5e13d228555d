"""Places in an order over all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .crawl import settled

IN_PART = (1 << 33) - 1  # the bits of monotonically_increasing_id() that count within a partition


def numbered(rows: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """rows with their places from 1 in the given order, which should have no ties (tied rows come in any order).

    Spark sorts by ranges, so a partition's rows begin where those of the partitions before it end: only the sizes of
    partitions, one row each, meet in one task. The sorted rows are checkpointed, as ranges may differ in another run of the plan.
    """
    placed = settled(rows.sort(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = sizes.select("_part", before.alias("_start"))
    place = F.col("_start") + F.col("_row").bitwiseAND(F.lit(IN_PART)) + 1
    return placed.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_part", "_row", "_start")  # starts: a row for each partition
