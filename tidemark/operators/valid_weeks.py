"""Weeks that count: a chart's repeated "everything is new" publications are left out.

A week is a phantom if at least 95 % (in whole numbers) of its entries are new in their first week.  Of
the phantoms of a chart the one with the smallest id is its real first week.  All charts are judged in
one pass: one aggregate by week and a window over a chart's calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.projection import Tables

PHANTOM_PERCENT = 95


def judged_weeks(entries: DataFrame, percent: int = PHANTOM_PERCENT) -> DataFrame:
    """(chart_id, week_id, entries, fresh, phantom, first_real, valid)."""
    fresh = F.count_if(F.col("is_new") & (F.col("weeks_on_chart") == 1))
    weekly = entries.groupBy("chart_id", "week_id").agg(F.count("*").alias("entries"), fresh.alias("fresh"))
    weekly = weekly.withColumn("phantom", F.expr(f"fresh >= entries * {percent} div 100"))
    of_chart = Window.partitionBy("chart_id")
    first = F.min(F.when(F.col("phantom"), F.col("week_id"))).over(of_chart)
    weekly = weekly.withColumn("first_real", F.coalesce(F.col("week_id") == first, F.lit(False)))
    return weekly.withColumn("valid", ~F.col("phantom") | F.col("first_real"))


def valid_weeks(entries: DataFrame, charts: list[int] | None = None) -> DataFrame:
    """(chart_id, week_id) of the weeks that count; of some charts or, with None, of all."""
    if charts is not None:
        entries = entries.where(F.col("chart_id").isin(charts)) if charts else entries.where("false")
    return judged_weeks(entries).where("valid").select("chart_id", "week_id")


def valid_entries(t: Tables, charts: list[int] | None = None) -> DataFrame:
    """The entries of the weeks that count."""
    entries = t.entries
    if charts is not None:
        entries = entries.where(F.col("chart_id").isin(charts)) if charts else entries.where("false")
    kept = valid_weeks(entries)
    return entries.join(F.broadcast(kept), ["chart_id", "week_id"], "left_semi")  # a row for each chart and week: a calendar


def chart_named(t: Tables, slug: str) -> dict:
    """The registry row of a slug; a ValueError for an unknown one."""
    found = t.charts.where(F.col("slug") == slug).head()
    if found is None:
        raise ValueError(f"no chart has the slug {slug!r}")
    return found.asDict()
