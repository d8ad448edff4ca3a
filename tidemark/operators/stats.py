"""Career statistics: by item, by artist, by artist and chart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.valid_weeks import valid_entries
from tidemark.sources.projection import CORE_ALBUMS, CORE_SONGS, Tables


def item_stats(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Weeks, peak, weeks at the peak and at one, first and last date, first position of each item.

    Weeks at the peak come from a count by rank: one aggregate to (item, rank), a second one to the item,
    so no entry is sorted or joined back.
    """
    by = by or ["entity_id"]
    return careers(ranks_of(entries, by), by)


def ranks_of(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, rank, n, first, last): how often and when an item stood at each rank.  Two such states merge by sums and extremes."""
    return entries.groupBy(*by, "rank").agg(F.count("*").alias("n"), F.min("chart_date").alias("first"), F.max("chart_date").alias("last"))


def careers(by_rank: DataFrame, by: list[str]) -> DataFrame:
    """The statistics of each item from its ranks."""
    return by_rank.groupBy(*by).agg(
        F.sum("n").cast("int").alias("total_weeks"),
        F.min("rank").alias("peak_position"),
        F.min_by("n", "rank").cast("int").alias("weeks_at_peak"),
        F.coalesce(F.sum(F.when(F.col("rank") == 1, F.col("n"))), F.lit(0)).cast("int").alias("weeks_at_number_one"),
        F.min("first").alias("debut_date"),
        F.max("last").alias("last_date"),
        F.min_by("rank", F.struct("first", "rank")).alias("debut_position"),
    )


def song_stats(t: Tables) -> DataFrame:
    """The core song chart's items."""
    return item_stats(valid_entries(t, [CORE_SONGS]))


def album_stats(t: Tables) -> DataFrame:
    """The core album chart's items."""
    return item_stats(valid_entries(t, [CORE_ALBUMS]))


def debut_positions(t: Tables, chart_id: int = CORE_SONGS) -> DataFrame:
    """(entity_id, chart_date, rank): the first valid entry of each item."""
    first = Window.partitionBy("entity_id").orderBy("chart_date", "rank")
    entries = valid_entries(t, [chart_id]).withColumn("_n", F.row_number().over(first))
    return entries.where("_n = 1").select("entity_id", "chart_date", F.col("rank").alias("debut_position"))


def credits(t: Tables) -> DataFrame:
    """(chart_id, entity_id, artist_id, role): every chart's items with their artists; artists stand for themselves."""
    charts = F.broadcast(t.charts.select(F.col("id").alias("chart_id"), "entity_kind"))  # the registry
    links = (
        t.song_artists.withColumn("entity_kind", F.lit("song"))
        .unionByName(t.album_artists.withColumn("entity_kind", F.lit("album")))
        .unionByName(t.artists.select(F.col("id").alias("entity_id"), F.col("id").alias("artist_id"), F.lit("primary").alias("role"), F.lit("artist").alias("entity_kind")))
    )
    return links.join(charts, "entity_kind").select("chart_id", "entity_id", "artist_id", "role")


def artist_chart_stats(t: Tables, scope: str = "all", charts: list[int] | None = None, credited: DataFrame | None = None) -> DataFrame:
    """(artist_id, chart_id, …) over all charts, or some of them, in one pass; ``credited`` stands for ``credits(t)``.

    Items are summed first (by artist, chart and item), so different items are counted without expanding rows; links
    by artist and week give the most entries at once - a week has at most a chart's depth of entries.
    """
    links = credits(t) if credited is None else credited
    links = links if scope == "all" else links.where("role = 'primary'")
    linked = valid_entries(t, charts).join(links, ["chart_id", "entity_id"])
    weekly = linked.groupBy("artist_id", "chart_id", "week_id").agg(F.count("*").alias("n"))
    at_once = weekly.groupBy("artist_id", "chart_id").agg(F.max("n").cast("int").alias("max_simultaneous"))
    by_item = linked.groupBy("artist_id", "chart_id", "entity_id").agg(
        F.count("*").alias("n"), F.min("rank").alias("best"), F.min("chart_date").alias("first"), F.max("chart_date").alias("last")
    )
    return chart_totals(by_item).join(at_once, ["artist_id", "chart_id"])


def chart_totals(by_item: DataFrame) -> DataFrame:
    """(artist_id, chart_id, …) from an artist's items (artist_id, chart_id, entity_id, n, best, first, last)."""
    return by_item.groupBy("artist_id", "chart_id").agg(
        F.count("*").cast("int").alias("total_entries"),
        F.sum("n").cast("int").alias("total_weeks"),
        F.count_if(F.col("best") == 1).cast("int").alias("number_ones"),
        F.min("best").alias("best_peak"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
    )


def artist_stats(t: Tables) -> DataFrame:
    """A row for every artist: song and album totals, dates, most entries in a week; zeros and nulls without any.

    The numbers of songs and albums count credits of any chart; all else counts valid core weeks.
    """
    rollup = artist_chart_stats(t, charts=[CORE_SONGS, CORE_ALBUMS])

    def side(chart_id: int, column: str):
        return F.max(F.when(F.col("chart_id") == chart_id, F.col(column)))

    core = rollup.groupBy("artist_id").agg(
        *[side(c, x).alias(f"{name}_{x}") for c, name in ((CORE_SONGS, "song"), (CORE_ALBUMS, "album")) for x in ("total_weeks", "number_ones", "best_peak", "max_simultaneous")],
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )
    songs = t.song_artists.groupBy("artist_id").agg(F.count_distinct("entity_id").alias("total_songs"))
    albums = t.album_artists.groupBy("artist_id").agg(F.count_distinct("entity_id").alias("total_albums"))
    every = t.artists.select(F.col("id").alias("artist_id"))
    joined = every.join(songs, "artist_id", "left").join(albums, "artist_id", "left").join(core, "artist_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    return joined.select(
        "artist_id", zero("total_songs"), zero("total_albums"), zero("song_total_weeks"), zero("album_total_weeks"),
        zero("song_number_ones"), zero("album_number_ones"), "song_best_peak", "album_best_peak",
        zero("song_max_simultaneous"), zero("album_max_simultaneous"), "first_date", "last_date",
    )


def artist_career_totals(t: Tables, scope: str = "all") -> DataFrame:
    """Sums, extremes and the number of charts of each artist, aliases folded into one."""
    from tidemark.functions.names import canonical_name

    people = t.artists.select(F.col("id").alias("artist_id"), canonical_name(F.col("name")).alias("name"))
    return (
        artist_chart_stats(t, scope).join(people, "artist_id").groupBy("name").agg(
            F.sum("total_entries").cast("int").alias("total_entries"), F.sum("total_weeks").cast("int").alias("total_weeks"),
            F.sum("number_ones").cast("int").alias("number_ones"), F.min("best_peak").alias("best_peak"),
            F.max("max_simultaneous").alias("max_simultaneous"), F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"), F.count_distinct("chart_id").cast("int").alias("chart_count"),
        )
    )


def artist_chart_rollups(t: Tables, names: list[str]) -> DataFrame:
    """By chart, the sums over the ids of an identity group."""
    from tidemark.functions.names import identity_key

    wanted = [n.lower() for n in names]
    ids = t.artists.where(identity_key(F.col("name")).isin(wanted)).select(F.col("id").alias("artist_id"))
    charts = t.charts.select(F.col("id").alias("chart_id"), F.col("slug").alias("chart_slug"), "sort_order")
    return (
        artist_chart_stats(t).join(ids, "artist_id", "left_semi").join(F.broadcast(charts), "chart_id")
        .groupBy("chart_slug", "sort_order").agg(
            F.sum("total_entries").cast("int").alias("total_entries"), F.sum("total_weeks").cast("int").alias("total_weeks"),
            F.sum("number_ones").cast("int").alias("number_ones"), F.min("best_peak").alias("best_peak"),
            F.max("max_simultaneous").alias("max_simultaneous"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
        )
    )


def rollup_parity(t: Tables, rollup: DataFrame | None = None, career: DataFrame | None = None) -> DataFrame:
    """Artists whose rollup by chart disagrees with their career statistics; none should come back.

    Both sides may be given as they are stored; by default they are computed.
    """
    rollup = artist_chart_stats(t, charts=[CORE_SONGS, CORE_ALBUMS]) if rollup is None else rollup
    by_side = [F.max(F.when(F.col("chart_id") == c, F.col("total_weeks"))).alias(f"{s}_rollup") for c, s in ((CORE_SONGS, "song"), (CORE_ALBUMS, "album"))]
    sums = rollup.groupBy("artist_id").agg(*by_side)
    both = t.artists.select(F.col("id").alias("artist_id")).join(sums, "artist_id", "left").join(artist_stats(t) if career is None else career, "artist_id")
    differs = [F.coalesce(F.col(f"{s}_rollup"), F.lit(0)) != F.col(f"{s}_total_weeks") for s in ("song", "album")]
    return both.where(differs[0] | differs[1]).select("artist_id", "song_rollup", "album_rollup", "song_total_weeks", "album_total_weeks")
