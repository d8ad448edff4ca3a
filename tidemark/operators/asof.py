"""As-of joins: for every row the last known row of the other side at or before its time.

Time is cut into blocks.  The last row of each block, carried over the blocks behind it, seeds every block, so a block is
complete by itself: its rows of both sides are merged in order of time and the last known one is taken down by a window.  Blocks
spread a key over many tasks, and each different time of a key is matched once, however many rows have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, block: Column | None = None, before_first: bool = False) -> DataFrame:
    """``left`` with ``value`` of the last row of ``right`` (by, on, value) at or before its ``on``; null before the first one.

    ``block`` is a column of ``on`` that never falls as time goes on (its month by default).  ``before_first``: times before a key's first
    row get that row's value.  Of right rows of one key and time the largest value counts; a null key or time on either side matches
    nothing, and its left rows keep a null.
    """
    block = F.trunc(on, "month") if block is None else block
    keyed = lambda df: df.where(F.expr(" and ".join(f"`{c}` is not null" for c in [*by, on])))
    known = keyed(right.select(*by, on, value)).groupBy(*by, on).agg(F.max(value).alias("_v")).withColumn("_b", block)
    asked = keyed(left.select(*by, on)).distinct().withColumn("_b", block)
    # One row for each key and block: what was last known when it began.
    ends = known.groupBy(*by, "_b").agg(F.max_by("_v", on).alias("_end"))
    blocks = asked.select(*by, "_b").distinct().join(ends, [*by, "_b"], "full")
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    seeds = blocks.select(*by, "_b", F.last("_end", ignorenulls=True).over(earlier).alias("_seed"))
    merged = known.select(*by, on, "_b", "_v", F.lit(0).alias("_side")).unionByName(asked.select(*by, on, "_b", F.lit(None).cast(known.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_side")))
    so_far = Window.partitionBy(*by, "_b").orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = merged.withColumn("_v", F.last("_v", ignorenulls=True).over(so_far)).where("_side = 1")
    matched = matched.join(seeds, [*by, "_b"]).select(*by, on, F.coalesce("_v", "_seed").alias(value))
    if before_first:
        first = known.groupBy(*by).agg(F.min_by("_v", on).alias("_first"))
        matched = matched.join(first, by, "left").withColumn(value, F.coalesce(value, "_first")).drop("_first")
    return left.join(matched, [*by, on], "left")
