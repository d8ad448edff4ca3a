"""Charts week by week: the registry, snapshots, navigation, movement and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import is_saturday
from tidemark.functions.registry import family
from tidemark.operators.stats import album_stats, artist_stats, credits, song_stats
from tidemark.operators.valid_weeks import valid_entries, valid_weeks
from tidemark.sources.projection import CORE_ALBUMS, CORE_SONGS, Tables


def active_charts(t: Tables) -> DataFrame:
    """The active charts in display order, with their family."""
    rows = t.charts.where("is_active").select("slug", "title", "entity_kind", "category", family(F.col("slug"), F.col("category")).alias("family"), "sort_order")
    return rows.orderBy("sort_order", "title")


def last_loaded(t: Tables, active_only: bool = True) -> DataFrame:
    """Every chart with its newest week; null for a chart without any."""
    newest = t.weeks.groupBy(F.col("chart_id").alias("id")).agg(F.max("chart_date").alias("last_loaded"))
    charts = t.charts.where("is_active") if active_only else t.charts
    return charts.join(newest, "id", "left").select("id", "slug", "entity_kind", "last_loaded", "sort_order")


def available_dates(t: Tables) -> DataFrame:
    """(chart_id, chart_date): the weeks that count, of every chart."""
    return t.weeks.join(valid_weeks(t.entries).withColumnRenamed("week_id", "id"), ["chart_id", "id"], "left_semi").select("chart_id", "chart_date")


def navigation(t: Tables) -> DataFrame:
    """The week before and the week after each one that counts."""
    in_chart = Window.partitionBy("chart_id").orderBy("chart_date")
    dates = available_dates(t)
    return dates.select("chart_id", "chart_date", F.lag("chart_date").over(in_chart).alias("previous_date"), F.lead("chart_date").over(in_chart).alias("next_date"))


def primary_artist(links: DataFrame) -> DataFrame:
    """(entity_id, artist_id): the primary artist of the smallest id, else the smallest of all."""
    order = F.struct(F.when(F.col("role") == "primary", 0).otherwise(1), "artist_id")
    return links.groupBy("entity_id").agg(F.min_by("artist_id", order).alias("artist_id"))


def weekly_chart(t: Tables, chart_id: int, kind: str, chart_date: str | None = None) -> DataFrame:
    """A week's entries by rank; the newest week if the date is not one that counts."""
    entries = valid_entries(t, [chart_id])
    wanted = F.lit(chart_date).cast("date")
    week = available_dates(t).where(F.col("chart_id") == chart_id).agg(
        F.coalesce(F.max(F.when(F.col("chart_date") == wanted, F.col("chart_date"))), F.max("chart_date")).alias("chart_date")
    )
    rows = entries.join(F.broadcast(week), "chart_date", "left_semi")  # one row
    items, links = t.by_kind[kind]
    named = rows.join(items.withColumnRenamed("id", "entity_id"), "entity_id")
    if links is None:
        named = named.withColumn("artist_id", F.col("entity_id"))
    else:
        named = named.join(primary_artist(links.join(rows.select("entity_id").distinct(), "entity_id", "left_semi")), "entity_id", "left")
    return named.select("rank", "title", "artist_credit", "artist_id", "peak_pos", "last_pos", "weeks_on_chart", "is_new", "entity_id", "chart_date")


def chart_date_for(t: Tables, chart_id: int, text: str) -> DataFrame:
    """(chart_date) that a typed date or year stands for: the newest of a year; the newest at or before a date, else the oldest."""
    dates = available_dates(t).where(F.col("chart_id") == chart_id)
    text = text.strip()
    if len(text) == 4 and text.isdigit():
        return dates.where(F.year("chart_date") == int(text)).agg(F.max("chart_date").alias("chart_date"))
    day = F.try_to_date(F.lit(text))
    found = F.coalesce(F.max(F.when(F.col("chart_date") <= day, F.col("chart_date"))), F.min("chart_date"))
    return dates.agg(F.when(day.isNotNull(), found).alias("chart_date"))


# -- movement ---------------------------------------------------------------------------------


def movement(rank: Column, last_pos: Column, is_new: Column) -> Column:
    """NEW, RE, ▲n, ▼n or •."""
    moved = last_pos - rank
    return (
        F.when(is_new, "NEW").when(last_pos.isNull() | (last_pos <= 0), "RE")
        .when(moved > 0, F.concat(F.lit("▲"), moved.cast("string"))).when(moved < 0, F.concat(F.lit("▼"), F.abs(moved).cast("string"))).otherwise("•")
    )


def movement_signed(rank: Column, last_pos: Column, is_new: Column) -> Column:
    """NEW, RE, — (no position known), +n, -n or =."""
    moved = last_pos - rank
    off = F.when(is_new, "NEW").when(last_pos == 0, "RE").otherwise("—")
    return F.when(last_pos.isNull() | (last_pos == 0), off).when(moved > 0, F.concat(F.lit("+"), moved.cast("string"))).when(moved < 0, moved.cast("string")).otherwise("=")


def moved_entries(t: Tables) -> DataFrame:
    """All entries that count, with their movement in both notations."""
    args = F.col("rank"), F.col("last_pos"), F.col("is_new")
    return valid_entries(t).select("chart_id", "chart_date", "rank", "entity_id", movement(*args).alias("movement"), movement_signed(*args).alias("signed"))


# -- runs -------------------------------------------------------------------------------------


def runs(t: Tables, gap_days: int = 14, charts: list[int] | None = None) -> DataFrame:
    """(chart_id, entity_id, run, first_date, last_date, weeks, best): a run ends where more than ``gap_days`` follow."""
    by_item = Window.partitionBy("chart_id", "entity_id").orderBy("chart_date")
    new = F.coalesce((F.datediff("chart_date", F.lag("chart_date").over(by_item)) > gap_days).cast("int"), F.lit(0))
    entries = valid_entries(t, charts).withColumn("_new", new)
    numbered = entries.withColumn("run", F.sum("_new").over(by_item.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    return numbered.groupBy("chart_id", "entity_id", "run").agg(
        F.min("chart_date").alias("first_date"), F.max("chart_date").alias("last_date"), F.count("*").alias("weeks"), F.min("rank").alias("best")
    )


def segments(t: Tables, charts: list[int] | None = None) -> DataFrame:
    """Unbroken lines of weekly points: the same with no week left out."""
    return runs(t, 10, charts)  # rounded to weeks, a gap of up to ten days is one week


def run_by_chart(t: Tables, kind: str, entity_id: int) -> DataFrame:
    """The history of an item on every chart of its kind."""
    charts = t.charts.where(F.col("entity_kind") == kind).select(F.col("id").alias("chart_id"), "slug", "sort_order")
    own = valid_entries(t).where(F.col("entity_id") == entity_id)
    return own.join(F.broadcast(charts), "chart_id").select("sort_order", "slug", "chart_date", "rank", "last_pos", "is_new", "peak_pos", "weeks_on_chart")


# -- details ----------------------------------------------------------------------------------


def item_detail(t: Tables, kind: str) -> DataFrame:
    """Every item with its career statistics; nulls without any."""
    stats = song_stats(t) if kind == "song" else album_stats(t)
    return t.by_kind[kind][0].join(stats.withColumnRenamed("entity_id", "id"), "id", "left")


def entity_artists(t: Tables, kind: str) -> DataFrame:
    """(entity_id, position, artist_id, name, role): an item's artists by role and name."""
    people = t.artists.select(F.col("id").alias("artist_id"), "name")
    order = Window.partitionBy("entity_id").orderBy("role", "name", "artist_id")
    return t.by_kind[kind][1].join(people, "artist_id").withColumn("position", F.row_number().over(order)).select("entity_id", "position", "artist_id", "name", "role")


def entity_charts(t: Tables) -> DataFrame:
    """(entity_kind, entity_id, slug): the charts that an item has ever been on."""
    charts = t.charts.select(F.col("id").alias("chart_id"), "entity_kind", "slug")
    return t.entries.select("chart_id", "entity_id").distinct().join(F.broadcast(charts), "chart_id").select("entity_kind", "entity_id", "slug")


def catalog(t: Tables, kind: str, scope: str = "all") -> DataFrame:
    """(artist_id, id, title, slug, statistics): an artist's items, once for each chart that an item has been on."""
    links = t.by_kind[kind][1]
    if scope == "lead":
        links = links.where("role = 'primary'")
    on = entity_charts(t).where(F.col("entity_kind") == kind).select("entity_id", "slug")
    stats = (song_stats(t) if kind == "song" else album_stats(t)).select("entity_id", "peak_position", "total_weeks", "weeks_at_number_one", "debut_date", "debut_position")
    items = t.by_kind[kind][0].select(F.col("id").alias("entity_id"), "title")
    pairs = links.select("artist_id", "entity_id").distinct()
    return pairs.join(on, "entity_id").join(items, "entity_id").join(stats, "entity_id", "left")


def artist_timeline(t: Tables, artist_id: int) -> DataFrame:
    """Every entry of an artist's items on the two core charts."""
    own = credits(t).where(F.col("artist_id") == artist_id).select("chart_id", "entity_id")
    return valid_entries(t, [CORE_SONGS, CORE_ALBUMS]).join(own, ["chart_id", "entity_id"]).select("chart_id", "chart_date", "rank", "last_pos", "is_new")


def table_counts(t: Tables) -> DataFrame:
    """(relation, rows) of the stored and the derived relations."""
    relations = {
        "chart_weeks": t.weeks, "chart_entries": t.entries, "songs": t.songs, "albums": t.albums, "artists": t.artists,
        "song_stats": song_stats(t), "album_stats": album_stats(t), "artist_stats": artist_stats(t),
    }
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in relations.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def latest_dates(t: Tables, as_of: str) -> DataFrame:
    """(slug, latest_date): the newest Saturday of each chart that is not after ``as_of``."""
    charts = t.charts.select(F.col("id").alias("chart_id"), "slug")
    known = t.weeks.where((F.col("chart_date") <= F.lit(as_of).cast("date")) & is_saturday(F.col("chart_date")))
    return known.join(F.broadcast(charts), "chart_id").groupBy("slug").agg(F.max("chart_date").alias("latest_date"))
