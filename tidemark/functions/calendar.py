"""Chart weeks: publication days are Saturdays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def saturday_on_or_after(day: Column) -> Column:
    return F.date_add(day, 7 - F.dayofweek(day))


def saturday_on_or_before(day: Column) -> Column:
    return F.date_sub(day, F.dayofweek(day) % 7)


def is_saturday(day: Column) -> Column:
    return F.dayofweek(day) == 7


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def valid_iso_date(text: Column) -> Column:
    """Whether a text is a real calendar date written as YYYY-MM-DD."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def saturdays(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(chart_date): the Saturdays of a closed range."""
    ends = spark.range(1).select(saturday_on_or_after(F.lit(first).cast("date")).alias("a"), F.lit(last).cast("date").alias("b"))
    return ends.where("a <= b").select(F.explode(F.sequence("a", "b", F.expr("interval 7 day"))).alias("chart_date"))


def era(first: Column, last: Column) -> Column:
    """'1991–2004', or one year when both are the same."""
    a, b = F.year(first).cast("string"), F.year(last).cast("string")
    return F.when(a.isNull() & b.isNull(), "").when(a == b, a).otherwise(F.concat_ws("–", a, b))
