"""Custom records for many requests at once: a table of requests, one scan of the entries.

A request is a row (request_id, chart_id, rank_by, position, year_from, year_to, peak_max, debut_max, weeks_min, ascending, top); its
filters are null where it has none.  Entries are summed to items, years and ranks once; what different requests ask for meets these
sums by chart and years and is ranked by windows of its own, of which each request keeps ``top`` rows.

Defined results: an unknown ``rank_by`` and a chart without entries give no rows; null ``top`` is 50 (1,000 at most) and null ``ascending``
false; requests of one identifier are one request each, told apart by nothing, so identifiers should differ; ties go
by title, then id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.records import LIMIT, MOST_ROWS
from tidemark.operators.valid_weeks import valid_entries
from tidemark.sources.projection import Tables
from tidemark.sources.shared import staged

REQUEST = "request_id long, chart_id int, rank_by string, position int, year_from int, year_to int, peak_max int, debut_max int, weeks_min int, ascending boolean, top int"
_SCOPE, _FILTERS = ["chart_id", "rank_by", "position", "year_from", "year_to"], ["peak_max", "debut_max", "weeks_min", "ascending"]
#: Most scopes that are sent to all tasks; more are shuffled.
FEW_SCOPES = 100_000
#: Rows of items that a task is meant to sum or to rank.
TASK_ROWS = 1 << 20


def _value() -> Column:
    """What an item's rows (rank, n) count for in a request."""
    by, rank, at = F.col("rank_by"), F.col("rank"), F.col("position")
    counts = F.when(by == "total-weeks", True).when(by == "weeks-at-number-one", rank == 1).when(by == "weeks-at-position", rank == at).when(by == "weeks-in-top-n", rank <= at)
    return F.sum(F.when(counts, F.col("n")).otherwise(0))


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def _identified(rows: DataFrame, name: str) -> DataFrame:
    """The different ``rows``, staged with an identifier, so that what follows carries a number in place of them."""
    return staged(rows.distinct().withColumn(name, F.monotonically_increasing_id()), name)


def _same(columns: list[str], left: DataFrame, right: DataFrame) -> Column:
    return reduce(Column.__and__, [left[c].eqNullSafe(right[c]) for c in columns])


def _titles(t: Tables, items: DataFrame) -> DataFrame:
    """(chart_id, entity_id, title, artist_credit) of the items (chart_id, entity_id) that charts have."""
    kinds = F.broadcast(t.charts.select(F.col("id").alias("chart_id"), "entity_kind"))  # the registry
    parts = [rows.select(F.lit(kind).alias("entity_kind"), F.col("id").alias("entity_id"), "title", "artist_credit") for kind, (rows, _) in t.by_kind.items()]
    return items.join(kinds, "chart_id").join(reduce(DataFrame.unionByName, parts), ["entity_kind", "entity_id"]).drop("entity_kind")


def requested_records(t: Tables, requests: DataFrame) -> DataFrame:
    """(request_id, rank, id, title, artist_credit, value): the list of every request.

    Requests that share chart, years and what is counted share one sum (a scope), and those that share the filters too share
    one list (a question); a task holds about ``TASK_ROWS`` rows of either, however many requests there are.
    """
    spark, names = requests.sparkSession, [c.split()[0] for c in REQUEST.split(", ")]
    asked = requests.select(*names).where(F.col("rank_by").isin("total-weeks", "weeks-at-number-one", "weeks-at-position", "weeks-in-top-n"))
    position = F.when(F.col("rank_by").isin("weeks-at-position", "weeks-in-top-n"), F.coalesce("position", F.lit(10)))
    asked = asked.withColumns({"position": position, "ascending": F.coalesce("ascending", F.lit(False)), "top": F.least(F.coalesce("top", F.lit(LIMIT)), F.lit(MOST_ROWS))})
    scopes = _identified(asked.select(*_SCOPE), "scope")
    few = scopes.count()
    # The only scan of entries.  An item's rows lie in one task, so it is summed by year, then by scope, without another exchange.
    entries = valid_entries(t).select("chart_id", "entity_id", "chart_date", "rank")
    dealt = entries.repartition(_tasks(spark, t.entries.count() * few), "chart_id", "entity_id")
    by_year = dealt.groupBy("chart_id", "entity_id", F.year("chart_date").alias("year"), "rank").agg(F.count("*").alias("n"), F.min("chart_date").alias("first"))
    inside = F.coalesce(F.col("year") >= F.col("year_from"), F.lit(True)) & F.coalesce(F.col("year") <= F.col("year_to"), F.lit(True))
    met = by_year.join(F.broadcast(scopes) if few <= FEW_SCOPES else scopes, "chart_id").where(inside)
    sums = met.groupBy("chart_id", "entity_id", "scope").agg(
        F.sum("n").alias("total_weeks"), F.min("rank").alias("peak"), F.min_by("rank", F.struct("first", "rank")).alias("debut"),
        F.any_value("rank_by").alias("rank_by"), F.any_value("position").alias("position"), _value().alias("value"),
    ).where("value > 0").drop("rank_by", "position")
    named = staged(_titles(t, entries.select("chart_id", "entity_id").distinct()), "titles")
    items = staged(sums.join(named.drop("artist_credit"), ["chart_id", "entity_id"]), "items")

    chosen = [*_SCOPE, *_FILTERS]
    questions = _identified(asked.select(*chosen), "question")
    questions = staged(questions.join(scopes, _same(_SCOPE, questions, scopes)).select(*[questions[c] for c in chosen], "question", "scope"), "questions")
    of_scope = lambda rows, n: rows.groupBy("scope").agg(F.count("*").alias(n))
    pairs = of_scope(items, "a").join(of_scope(questions, "b"), "scope").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]
    fits = lambda test: F.coalesce(test, F.lit(True))
    held = items.join(questions.select("question", "scope", *_FILTERS), "scope").where(
        fits(F.col("peak") <= F.col("peak_max")) & fits(F.col("debut") <= F.col("debut_max")) & fits(F.col("total_weeks") >= F.col("weeks_min"))
    )
    signed = F.when(F.col("ascending"), F.col("value")).otherwise(-F.col("value"))
    place = Window.partitionBy("question").orderBy("signed", "title", "entity_id")
    held = held.select("question", "chart_id", "entity_id", "value", signed.alias("signed"), "title").repartition(_tasks(spark, pairs), "question")
    ranked = held.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= MOST_ROWS).select("question", "rank", "chart_id", "entity_id", "value")
    own = asked.join(questions, _same(chosen, asked, questions)).select("request_id", "top", "question")
    listed = own.join(ranked, "question").where("rank <= top").join(named, ["chart_id", "entity_id"])
    return listed.select("request_id", "rank", F.col("entity_id").alias("id"), "title", "artist_credit", "value")
