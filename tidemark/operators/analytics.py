"""Comparison, presence by year and the same week in history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import era, iso_week
from tidemark.operators.charts import entity_charts
from tidemark.operators.valid_weeks import valid_entries, valid_weeks
from tidemark.sources.projection import Tables
from tidemark.sources.shared import staged


def entity_metrics(t: Tables, kind: str, ids: list[int] | None = None) -> DataFrame:
    """Peak, weeks, weeks at one and in the top ten, dates and era of items over all charts of their kind."""
    chosen = (lambda df: df) if ids is None else (lambda df: df.where(F.col("entity_id").isin(ids)))
    charts = F.broadcast(t.charts.where(F.col("entity_kind") == kind).select(F.col("id").alias("chart_id")))
    own = chosen(valid_entries(t)).join(charts, "chart_id", "left_semi")
    metrics = own.groupBy("entity_id").agg(
        F.min("rank").alias("peak"), F.count("*").cast("int").alias("weeks_on_chart"),
        F.count_if(F.col("rank") == 1).cast("int").alias("weeks_at_number_one"), F.count_if(F.col("rank") <= 10).cast("int").alias("top_ten_weeks"),
        F.min("chart_date").alias("first_date"), F.max("chart_date").alias("last_date"),
    )
    slugs = chosen(entity_charts(t).where(F.col("entity_kind") == kind)).groupBy("entity_id").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("slug"))).alias("charts")  # at most the registry
    )
    items = t.by_kind[kind][0].select(F.col("id").alias("entity_id"), F.col("title").alias("label"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("weeks_on_chart", "weeks_at_number_one", "top_ten_weeks")]
    return chosen(items).join(slugs, "entity_id", "left").join(metrics, "entity_id", "left").select(
        "entity_id", "label", F.coalesce("charts", F.lit("")).alias("charts"), "peak", *zero, "first_date", "last_date", era(F.col("first_date"), F.col("last_date")).alias("active_era")
    )


def presence_by_year(t: Tables) -> DataFrame:
    """(chart_id, entity_id, year, weeks) of every item."""
    by_year = valid_entries(t).groupBy("chart_id", "entity_id", F.year("chart_date").alias("year"))
    return by_year.agg(F.count("*").cast("int").alias("weeks"))


def presence_overlay(t: Tables, chart_id: int, left_id: int, right_id: int) -> DataFrame:
    """(year, left_weeks, right_weeks): two items' years side by side, null where one has none."""
    years = presence_by_year(t).where(F.col("chart_id") == chart_id)
    side = lambda i, name: years.where(F.col("entity_id") == i).select("year", F.col("weeks").alias(name))
    return side(left_id, "left_weeks").join(side(right_id, "right_weeks"), "year", "full")


def this_week_in_history(t: Tables, chart_id: int, kind: str, target: str, top_n: int = 10) -> DataFrame:
    """The entries of the target's ISO week in earlier years; a row with charted = false for a year without one.

    A year holds two dates of one ISO week when both its ends fall into it; each keeps its own date.
    """
    day = F.lit(target).cast("date")
    # The chart's calendar is judged once; of the entries only those of the wanted weeks and ranks are read again.
    judged = t.weeks.where(F.col("chart_id") == chart_id).join(
        F.broadcast(valid_weeks(t.entries, [chart_id]).select(F.col("week_id").alias("id"))), "id", "left_semi"
    ).select("chart_id", F.col("id").alias("week_id"), "chart_date", F.year("chart_date").alias("year"))
    weeks = staged(judged, "weeks")  # a calendar
    years = weeks.agg(F.min("year").alias("a"), (F.year(day) - 1).alias("b")).where("a <= b")
    years = years.select(F.explode(F.sequence("a", "b")).alias("year"))
    hits = weeks.where((iso_week(F.col("chart_date")) == iso_week(day)) & (F.col("chart_date") < day)).select("chart_id", "week_id", "year")
    entries = t.entries.where((F.col("chart_id") == chart_id) & (F.col("rank") <= top_n)).join(F.broadcast(hits), ["chart_id", "week_id"])
    named = entries.join(t.by_kind[kind][0].withColumnRenamed("id", "entity_id"), "entity_id").select("year", "chart_date", "rank", "title", "artist_credit")
    return years.join(named, "year", "left").withColumn("charted", F.col("chart_date").isNotNull())
