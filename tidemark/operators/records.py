"""Leaderboards: the fixed records, custom ones, genders, and what stands behind an artist's record.

Every list is ordered by value, then name, then id, and numbered from one; of a limited list only the listed rows
are numbered, and a list without a limit is numbered by ranges, so no window sorts more than ``limit`` rows in one task.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.numbering import numbered
from tidemark.operators.stats import album_stats, artist_stats, item_stats, song_stats
from tidemark.operators.valid_weeks import valid_entries
from tidemark.sources.projection import Tables

LIMIT, MOST_ROWS = 50, 1000
PRESETS = (
    "weeks_at_number_one", "longest_chart_runs", "top10_weeks", "number_one_songs_by_artist", "number_one_albums_by_artist",
    "entries_by_artist", "total_chart_weeks_by_artist", "simultaneous_entries",
)
#: Records that read career statistics, which exist for the core charts only.
_CAREER = set(PRESETS) - {"top10_weeks", "simultaneous_entries"}
_KIND_OF = {"number_one_songs_by_artist": "song", "number_one_albums_by_artist": "album", "simultaneous_entries": "song"}


def unsupported(record: str, entity_kind: str, category: str) -> str | None:
    """Why a chart has no such record, or None."""
    if record not in PRESETS:
        return f"There is no record {record!r}."
    if entity_kind == "artist":
        return "Charts of artists have no records of songs or albums."
    if record in _CAREER and category != "core":
        return "This record is kept for the core charts."
    if _KIND_OF.get(record, entity_kind) != entity_kind:
        return f"This record is kept for {_KIND_OF[record]} charts."
    return None


def listed(rows: DataFrame, order: list[Column], limit: int | None = LIMIT) -> DataFrame:
    """The first rows in this order, numbered by ``rank``."""
    if limit is None:
        return numbered(rows, order, name="rank")
    rows = rows.orderBy(*order).limit(max(1, min(limit, MOST_ROWS)))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def split_names(text: str | None) -> list[str]:
    """The names of a filter written as one text: cut at commas, blanks dropped."""
    return [name for part in (text or "").split(",") if (name := part.strip())]


#: Columns that a catalog can be sorted by.
CATALOG_ORDER = ("title", "peak_position", "total_weeks", "weeks_at_number_one", "debut_date", "last_date")


def sorted_catalog(rows: DataFrame, by: str, ascending: bool = True) -> DataFrame:
    """(position, …) by any column: no number counts as endless and no date as the earliest; ties of numbers go by title."""
    if by not in CATALOG_ORDER:
        raise ValueError(f"a catalog can't be sorted by {by!r}")
    absent = F.asc(F.col(by).isNull()) if ascending else F.desc(F.col(by).isNull())
    value = F.asc(by) if ascending else F.desc(by)
    if by == "title":
        order = [value]
    elif by.endswith("_date"):
        order = [F.desc(F.col(by).isNull()) if ascending else F.asc(F.col(by).isNull()), value]
    else:
        order = [absent, value, F.asc("title")]
    return numbered(rows, [*order, F.asc("entity_id")], name="position")


def _best(rows: DataFrame, limit: int | None = LIMIT, ascending: bool = False) -> DataFrame:
    value = F.asc("value") if ascending else F.desc("value")
    return listed(rows, [value, F.asc("title"), F.asc("id")], limit).select("rank", "id", "title", "artist_credit", "value")


def _named(t: Tables, kind: str, values: DataFrame) -> DataFrame:
    """(id, title, artist_credit, …) for rows with an entity_id."""
    items = t.by_kind[kind][0].select("id", "title", "artist_credit")
    return values.withColumnRenamed("entity_id", "id").join(items, "id")


def _links(t: Tables, kind: str, scope: str) -> DataFrame:
    links = t.by_kind[kind][1]
    return links.where("role = 'primary'") if scope == "lead" else links


def career(t: Tables, kind: str) -> DataFrame:
    return song_stats(t) if kind == "song" else album_stats(t)


# -- fixed records ----------------------------------------------------------------------------


def weeks_at_number_one(t: Tables, kind: str, limit: int = LIMIT) -> DataFrame:
    values = career(t, kind).where("weeks_at_number_one > 0").select("entity_id", F.col("weeks_at_number_one").alias("value"))
    return _best(_named(t, kind, values), limit)


def longest_chart_runs(t: Tables, kind: str, limit: int = LIMIT) -> DataFrame:
    return _best(_named(t, kind, career(t, kind).select("entity_id", F.col("total_weeks").alias("value"))), limit)


def top10_weeks(t: Tables, chart_id: int, kind: str, limit: int = LIMIT) -> DataFrame:
    counts = valid_entries(t, [chart_id]).where("rank <= 10").groupBy("entity_id").agg(F.count("*").alias("value"))
    return _best(_named(t, kind, counts), limit)


def number_ones_by_artist(t: Tables, kind: str, scope: str = "all", limit: int = LIMIT) -> DataFrame:
    """Artists by their different items that were first."""
    first = career(t, kind).where("weeks_at_number_one > 0").select("entity_id")
    counts = first.join(_links(t, kind, scope), "entity_id").groupBy("artist_id").agg(F.count_distinct("entity_id").alias("value"))
    return _best(_named(t, "artist", counts.withColumnRenamed("artist_id", "entity_id")), limit)


def _by_artist(t: Tables, column: str, limit: int) -> DataFrame:
    values = artist_stats(t).where(F.col(column) > 0).select(F.col("artist_id").alias("entity_id"), F.col(column).alias("value"))
    return _best(_named(t, "artist", values), limit)


def entries_by_artist(t: Tables, kind: str, limit: int = LIMIT) -> DataFrame:
    return _by_artist(t, f"total_{kind}s", limit)


def total_chart_weeks_by_artist(t: Tables, kind: str, limit: int = LIMIT) -> DataFrame:
    return _by_artist(t, f"{kind}_total_weeks", limit)


def weekly_entries_by_artist(t: Tables, chart_id: int, kind: str = "song", scope: str = "all") -> DataFrame:
    """(artist_id, chart_date, value): how many entries an artist had in a week."""
    linked = valid_entries(t, [chart_id]).join(_links(t, kind, scope), "entity_id")
    return linked.groupBy("artist_id", "chart_date").agg(F.count("*").alias("value"))


def simultaneous_entries(t: Tables, chart_id: int, scope: str = "all", limit: int = LIMIT) -> DataFrame:
    rows = _named(t, "artist", weekly_entries_by_artist(t, chart_id, scope=scope).withColumnRenamed("artist_id", "entity_id"))
    order = [F.desc("value"), F.desc("chart_date"), F.asc("title"), F.asc("id")]
    return listed(rows, order, limit).select("rank", "id", "title", "value", "chart_date")


def simultaneous_personal_bests(t: Tables, chart_id: int, limit: int = LIMIT) -> DataFrame:
    """The same, only weeks that tie the artist's own highest number."""
    weekly = weekly_entries_by_artist(t, chart_id)
    most = F.max("value").over(Window.partitionBy("artist_id"))
    best = weekly.withColumn("_most", most).where("value = _most").drop("_most").withColumnRenamed("artist_id", "entity_id")
    order = [F.desc("value"), F.asc("title"), F.asc("chart_date"), F.asc("id")]
    return listed(_named(t, "artist", best), order, limit).select("rank", "id", "title", "value", "chart_date")


def biggest_debuts(t: Tables, kind: str, limit: int = 25) -> DataFrame:
    rows = _named(t, kind, career(t, kind).select("entity_id", "total_weeks", F.col("debut_position").alias("value")))
    return listed(rows, [F.asc("value"), F.desc("total_weeks"), F.asc("id")], limit).select("rank", "id", "title", "artist_credit", "value")


def fastest_to_number_one(t: Tables, chart_id: int, kind: str, limit: int = 25) -> DataFrame:
    """Weeks from the first entry to the first one at the top; phantom weeks count here."""
    first = t.entries.where(F.col("chart_id") == chart_id).groupBy("entity_id").agg(
        F.min(F.when(F.col("rank") == 1, F.col("chart_date"))).alias("top"), F.min("chart_date").alias("debut")
    )
    weeks = F.floor(F.datediff("top", "debut") / 7).cast("int") + 1
    return _best(_named(t, kind, first.where("top is not null").select("entity_id", weeks.alias("value"))), limit, ascending=True)


def preset(t: Tables, record: str, chart: dict, scope: str = "all", limit: int = LIMIT) -> DataFrame:
    """A record by name for a row of the registry; a ValueError says why there is none."""
    if message := unsupported(record, chart["entity_kind"], chart["category"]):
        raise ValueError(message)
    kind, chart_id = chart["entity_kind"], chart["id"]
    return {
        "weeks_at_number_one": lambda: weeks_at_number_one(t, kind, limit),
        "longest_chart_runs": lambda: longest_chart_runs(t, kind, limit),
        "top10_weeks": lambda: top10_weeks(t, chart_id, kind, limit),
        "number_one_songs_by_artist": lambda: number_ones_by_artist(t, "song", scope, limit),
        "number_one_albums_by_artist": lambda: number_ones_by_artist(t, "album", scope, limit),
        "entries_by_artist": lambda: entries_by_artist(t, kind, limit),
        "total_chart_weeks_by_artist": lambda: total_chart_weeks_by_artist(t, kind, limit),
        "simultaneous_entries": lambda: simultaneous_entries(t, chart_id, scope, limit),
    }[record]()


def paged(rows: DataFrame, page: int, size: int = 10) -> DataFrame:
    """A page (from 0) of a numbered list."""
    return rows.where(F.col("rank").between(page * size + 1, (page + 1) * size))


# -- genders ----------------------------------------------------------------------------------


def weeks_by_gender(t: Tables, chart_id: int, kind: str) -> DataFrame:
    """(artist_id, name, gender, value): weeks of an artist's items; an unnamed gender is unknown."""
    linked = valid_entries(t, [chart_id]).join(t.by_kind[kind][1], "entity_id").groupBy("artist_id").agg(F.count("*").alias("value"))
    people = t.artists.select(F.col("id").alias("artist_id"), "name", "gender")
    return linked.join(people, "artist_id", "left").select("artist_id", "name", F.coalesce("gender", F.lit("unknown")).alias("gender"), "value")


def gender_coverage_of(rows: DataFrame) -> DataFrame:
    """One row: all artists, those with a gender, those without, and the share with one."""
    counts = rows.agg(F.count("*").alias("total_artists"), F.count_if(F.col("gender") != "unknown").alias("matched_artists"), F.count_if(F.col("gender") == "unknown").alias("unknown_artists"))
    share = F.when(F.col("total_artists") > 0, F.col("matched_artists") / F.col("total_artists")).otherwise(F.lit(0.0))
    return counts.withColumn("coverage", share)


def gender_leaderboard(t: Tables, chart_id: int, kind: str, gender: str = "all", limit: int = LIMIT) -> DataFrame:
    """Artists of a gender by weeks; the coverage on every row is that of all artists, whatever the filter."""
    rows = weeks_by_gender(t, chart_id, kind)
    chosen = rows if gender == "all" else rows.where(F.col("gender") == gender)
    best = listed(chosen, [F.desc("value"), F.asc("name"), F.asc("artist_id")], limit)
    return best.crossJoin(F.broadcast(gender_coverage_of(rows)))  # one row


# -- custom records ---------------------------------------------------------------------------


@dataclass
class Custom:
    """A custom record: what is ranked, by what, and which filters hold.

    ``rank_by``: total-weeks, weeks-at-number-one, weeks-at-position, weeks-in-top-n, most-entries or
    number-one-entries.  With a year, all statistics are those of the years alone.
    """

    entity: str  # songs, albums or artists; songs and albums follow the chart's kind
    chart_id: int
    kind: str
    rank_by: str = "total-weeks"
    position: int = 10
    ascending: bool = False
    peak: tuple[int | None, int | None] = (None, None)
    debut: tuple[int | None, int | None] = (None, None)
    weeks_min: int | None = None
    years: tuple[int | None, int | None] = (None, None)
    artist_names: list[str] = field(default_factory=list)
    scope: str = "all"
    limit: int = LIMIT


def _between(column: str, bounds: tuple[int | None, int | None]) -> list[Column]:
    low, high = bounds
    return [F.col(column) >= low] * (low is not None) + [F.col(column) <= high] * (high is not None)


def _all(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def _any_name(column: str, names: list[str]) -> list[Column]:
    return [reduce(Column.__or__, [F.col(column).ilike(f"%{n}%") for n in names])] if names else []


def _entries_of_years(t: Tables, q: Custom) -> DataFrame:
    days = [None if y is None else dt.date(y, m, d) for y, m, d in zip(q.years, (1, 12), (1, 31), strict=True)]
    return valid_entries(t, [q.chart_id]).where(_all(_between("chart_date", tuple(days))))


def custom(t: Tables, q: Custom) -> DataFrame:
    in_years = q.years != (None, None)
    entries = _entries_of_years(t, q)
    stats = item_stats(entries) if in_years else career(t, q.kind)
    if q.entity == "artists":
        return _custom_artists(t, q, stats)
    held = _between("peak_position", q.peak) + _between("debut_position", q.debut) + _between("total_weeks", (q.weeks_min, None))
    named = _named(t, q.kind, stats.where(_all(held))).where(_all(_any_name("artist_credit", q.artist_names)))
    if q.rank_by in ("total-weeks", "weeks-at-number-one"):
        column = q.rank_by.replace("-", "_")
        rows = named.withColumn("value", F.col(column))
        return _best(rows.where("value > 0") if q.rank_by == "weeks-at-number-one" else rows, q.limit, q.ascending)
    at = F.col("rank") == q.position if q.rank_by == "weeks-at-position" else F.col("rank") <= q.position
    counts = entries.where(at).groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("value"))
    return _best(named.join(counts, "id"), q.limit, q.ascending)


def _custom_artists(t: Tables, q: Custom, stats: DataFrame) -> DataFrame:
    """Artists by the statistics of their items; of the filters only the weeks and the names hold."""
    value = {"total-weeks": "total_weeks", "most-entries": "entry_count"}.get(q.rank_by, "number_one_count")
    sums = stats.join(_links(t, q.kind, q.scope), "entity_id").groupBy(F.col("artist_id").alias("id")).agg(
        F.count_distinct("entity_id").cast("int").alias("entry_count"),
        F.coalesce(F.sum("total_weeks"), F.lit(0)).cast("int").alias("total_weeks"),
        F.count_if(F.col("weeks_at_number_one") > 0).cast("int").alias("number_one_count"),
    )
    held = [F.col(value) > 0, *_between("total_weeks", (q.weeks_min, None))]
    named = _named(t, "artist", sums.where(_all(held))).where(_all(_any_name("title", q.artist_names)))
    return _best(named.withColumn("value", F.col(value)), q.limit, q.ascending)


# -- behind an artist's record ----------------------------------------------------------------


def _of_artist(t: Tables, kind: str, artist_id: int, scope: str) -> DataFrame:
    return _links(t, kind, scope).where(F.col("artist_id") == artist_id).select("entity_id").distinct()


def number_one_items(t: Tables, kind: str, artist_id: int, scope: str = "all") -> DataFrame:
    values = career(t, kind).where("weeks_at_number_one > 0").select("entity_id", F.col("weeks_at_number_one").alias("value"))
    return _best(_named(t, kind, values.join(_of_artist(t, kind, artist_id, scope), "entity_id", "left_semi")), None)


def artist_items(t: Tables, kind: str, artist_id: int, scope: str = "all") -> DataFrame:
    values = career(t, kind).select("entity_id", F.col("total_weeks").alias("value"))
    return _best(_named(t, kind, values.join(_of_artist(t, kind, artist_id, scope), "entity_id", "left_semi")), None)


def simultaneous_weeks(t: Tables, chart_id: int, artist_id: int, chart_date: str | None = None, scope: str = "all") -> DataFrame:
    """An artist's entries by week, numbered within the week, with the week's count."""
    own = valid_entries(t, [chart_id]).join(_of_artist(t, "song", artist_id, scope), "entity_id", "left_semi")
    week = Window.partitionBy("chart_date")
    rows = own.withColumn("week_value", F.count("*").over(week)).withColumn("week_rank", F.row_number().over(week.orderBy("rank")))
    if chart_date is not None:
        rows = rows.where(F.col("chart_date") == F.lit(chart_date).cast("date"))
    return _named(t, "song", rows.withColumnRenamed("rank", "entry_rank")).select("chart_date", "week_value", "week_rank", "entry_rank", "id", "title", "artist_credit")
