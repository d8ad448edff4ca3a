"""Numbers 1 to n in a stated order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import staged


def numbered(rows: DataFrame, order: list[str | Column], start: int = 0, name: str = "id") -> DataFrame:
    """With ``name``: start + 1, start + 2 … in this order.

    The rows are range-partitioned once and written with the number of their range; the counts of the ranges and
    the rows are both read from there, so they can't disagree.  Each range is numbered from the rows before it.
    """
    ranged = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    number = F.col("_local") + F.col("_before") + start
    return ranged.withColumn("_local", local).join(offsets, "_part").withColumn(name, number).drop("_part", "_local", "_before")
