"""All registered queries of the chart engine and their oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names, registry
from tidemark.functions.calendar import iso_week, saturday_on_or_before, saturdays, valid_iso_date
from tidemark.functions.credits import parse_credits
from tidemark.operators import analytics, charts, ingest, quality, records, search, stats
from tidemark.operators import valid_weeks as vw
from tidemark.operators.records import Custom
from tidemark.operators.title_index import TitleIndex
from tidemark.plans import stored
from tidemark.plans.oracle import board, sql, years
from tidemark.sources import week_files
from tidemark.sources.projection import Tables, project
from tidemark.sources.shared import fresh_path
from tidemark.streaming.incremental import weekly_activity

#: Parameters of the registered queries.
ARTIST, SONG, OTHER_SONG, TARGET = 7, 12, 30, "2001-03-15"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _add(name: str, over: Callable[[Tables], DataFrame], oracle: str | None) -> None:
    _QUERIES[name] = lambda spark, sf_dir: over(project(spark, sf_dir))
    if oracle:
        _ORACLES[name] = oracle


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# -- the model and the weeks that count ---------------------------------------------------------

_add("chart_weeks", lambda t: t.weeks, sql("SELECT * FROM chart_weeks"))
_add("chart_entries", lambda t: t.entries, sql("SELECT * FROM chart_entries"))
_add("phantom_weeks", lambda t: vw.judged_weeks(t.entries).select("chart_id", "week_id", "entries", "fresh", "phantom"), sql("SELECT * FROM phantoms"))
_add("first_real_week", lambda t: vw.judged_weeks(t.entries).where("first_real").select("chart_id", "week_id"), sql("SELECT * FROM real_first"))
_add("valid_weeks", lambda t: vw.valid_weeks(t.entries), sql("SELECT * FROM valid"))
_add("valid_weeks_multi", lambda t: vw.valid_weeks(t.entries, [1, 4]), sql("SELECT * FROM valid WHERE chart_id IN (1, 4)"))

_GENRES = ["country", "latin", "r-b-hip-hop", "rock", "other"]


def _data_charts(t: Tables) -> DataFrame:
    """Charts (slug, title, entity_kind, category, n) of the songs of each credit, named by a genre of its number, and of the albums of each."""
    number = F.coalesce(F.try_to_number(F.regexp_extract("artist_credit", r"(\d*)$", 1), F.lit("999999")).cast("int"), F.lit(0))
    genre = F.element_at(F.array(*map(F.lit, _GENRES)), number % 5 + 1)
    ends = lambda end: F.concat(F.lower(F.regexp_replace("artist_credit", "[^A-Za-z0-9]+", "-")), F.lit(end))
    rows = lambda items, kind, slug: items.select("artist_credit").distinct().select(slug.alias("slug"), F.col("artist_credit").alias("title"), F.lit(kind).alias("entity_kind"), F.lit("genre").alias("category"), number.alias("n"))
    return rows(t.songs, "song", F.concat(genre, F.lit("-"), ends("-songs"))).unionByName(rows(t.albums, "album", ends("-albums"))).unionByName(rows(t.albums, "album", ends("")))


_NUMBER = "coalesce(TRY_CAST(regexp_extract(artist_credit, '(\\d*)$', 1) AS INTEGER), 0)"
_SLUG = "lower(regexp_replace(artist_credit, '[^A-Za-z0-9]+', '-', 'g'))"
_DATA_CHARTS = f"""(SELECT DISTINCT ['country', 'latin', 'r-b-hip-hop', 'rock', 'other'][{_NUMBER} % 5 + 1] || '-' || {_SLUG} || '-songs' AS slug, artist_credit AS title, 'song' AS entity_kind, {_NUMBER} AS n, ['Country', 'Latin', 'R&B/Hip-Hop', 'Rock', 'Core'][{_NUMBER} % 5 + 1] AS family FROM songs
UNION ALL SELECT DISTINCT {_SLUG} || '-albums', artist_credit, 'album', {_NUMBER}, 'Core' FROM albums UNION ALL SELECT DISTINCT {_SLUG}, artist_credit, 'album', {_NUMBER}, 'Core' FROM albums)"""


def _wide_registry(t: Tables) -> Tables:
    """The registry and a chart of each of the data's: every third one is not active."""
    more = _data_charts(t).select(F.lit(99).alias("id"), "slug", "title", "entity_kind", "category", (F.col("n") % 3 > 0).alias("is_active"), (F.col("n") * 2).alias("sort_order"), F.lit(50).alias("depth"))
    return replace(t, charts=t.charts.unionByName(more))


_add(
    "active_charts", lambda t: charts.active_charts(_wide_registry(t)),
    sql(f"""SELECT slug, title, entity_kind, category, CASE id WHEN 3 THEN 'Artist' WHEN 4 THEN 'Rock' ELSE 'Core' END AS family, sort_order FROM charts
UNION ALL SELECT slug, title, entity_kind, 'genre', family, n * 2 FROM {_DATA_CHARTS} WHERE n % 3 > 0"""),
)
_add("registry_last_loaded", charts.last_loaded, sql("SELECT c.id, slug, entity_kind, MAX(chart_date) AS last_loaded, sort_order FROM charts c LEFT JOIN chart_weeks w ON w.chart_id = c.id GROUP BY ALL"))


def _known(t: Tables) -> DataFrame:
    """What is known of some charts: those of the albums of a credit, as half of them are."""
    return _data_charts(t).where("entity_kind = 'album' and length(title) % 2 = 0 and slug not like '%-albums'").select("slug", F.col("entity_kind").alias("kind"), F.lit(30).alias("depth"), "title")


_add(
    "chart_metadata", lambda t: registry.chart_metadata(_data_charts(t), _known(t)),
    sql(f"""SELECT slug, CASE WHEN known OR slug LIKE '%-albums' THEN 'album' ELSE 'song' END AS kind, CASE WHEN known THEN 30 WHEN slug LIKE '%-songs' OR slug LIKE '%-albums' THEN 50 ELSE 100 END AS depth,
CASE WHEN known THEN title ELSE 'this chart' END AS title FROM (SELECT *, entity_kind = 'album' AND length(title) % 2 = 0 AND slug NOT LIKE '%-albums' AS known FROM {_DATA_CHARTS})"""),
)
_add(
    "chart_families", lambda t: _data_charts(t).select("slug", registry.family_position(registry.family(F.col("slug"), F.col("category"))).cast("int").alias("place")),
    sql(f"SELECT slug, CASE family WHEN 'Core' THEN 1 WHEN 'Country' THEN 3 WHEN 'Latin' THEN 4 WHEN 'R&B/Hip-Hop' THEN 5 WHEN 'Rock' THEN 6 END AS place FROM {_DATA_CHARTS}"),
)

# -- statistics ---------------------------------------------------------------------------------

_add("song_stats", stats.song_stats, sql("SELECT * FROM song_stats"))
_add("album_stats", stats.album_stats, sql("SELECT * FROM album_stats"))
_add("debut_position", stats.debut_positions, sql("SELECT entity_id, chart_date, rank AS debut_position FROM ve WHERE chart_id = 1 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY chart_date) = 1"))
_add("artist_chart_stats", stats.artist_chart_stats, sql("SELECT * FROM artist_chart_stats"))
_add("artist_stats", stats.artist_stats, sql("SELECT * FROM artist_stats"))
_SUMS = "CAST(SUM(total_entries) AS INTEGER) AS total_entries, CAST(SUM(total_weeks) AS INTEGER) AS total_weeks, CAST(SUM(number_ones) AS INTEGER) AS number_ones, MIN(best_peak) AS best_peak, MAX(max_simultaneous) AS max_simultaneous, MIN(first_date) AS first_date, MAX(last_date) AS last_date"
_add("artist_career_totals", stats.artist_career_totals, sql(f"SELECT name, {_SUMS}, COUNT(*) AS chart_count FROM artist_chart_stats s JOIN artists a ON a.id = s.artist_id GROUP BY name"))


def _with_aliases(t: Tables) -> Tables:
    """The artists 5 to 8 under two names of one artist, in different writing."""
    name = F.when(F.col("id").isin(5, 7), "janet").when(F.col("id").isin(6, 8), "Janet  Jackson").otherwise(F.col("name"))
    return replace(t, artists=t.artists.withColumn("name", name))


_ALIASED = "(SELECT id FROM artists WHERE id BETWEEN 5 AND 8)"
_add(
    "artist_chart_rollups", lambda t: stats.artist_chart_rollups(_with_aliases(t), names.identity_group("Janet")),
    sql(f"SELECT slug AS chart_slug, sort_order, {_SUMS} FROM artist_chart_stats s JOIN charts c ON c.id = chart_id WHERE artist_id IN {_ALIASED} GROUP BY slug, sort_order"),
)
# Disagreements are planted on both sides: every seventh rollup has a week more, every eleventh career row a week less.
_add(
    "rollup_parity",
    lambda t: stats.rollup_parity(
        t, stats.artist_chart_stats(t).withColumn("total_weeks", F.col("total_weeks") + F.when(F.col("artist_id") % 7 == 0, 1).otherwise(0)),
        stats.artist_stats(t).withColumn("album_total_weeks", F.col("album_total_weeks") - F.when(F.col("artist_id") % 11 == 0, 1).otherwise(0)),
    ),
    sql("""SELECT artist_id, song_rollup, album_rollup, song_total_weeks, album_total_weeks FROM (
SELECT a.artist_id, x.total_weeks + CASE WHEN a.artist_id % 7 = 0 THEN 1 ELSE 0 END AS song_rollup, y.total_weeks + CASE WHEN a.artist_id % 7 = 0 THEN 1 ELSE 0 END AS album_rollup,
song_total_weeks, album_total_weeks - CASE WHEN a.artist_id % 11 = 0 THEN 1 ELSE 0 END AS album_total_weeks
FROM artist_stats a LEFT JOIN (SELECT * FROM artist_chart_stats WHERE chart_id = 1) x ON x.artist_id = a.artist_id LEFT JOIN (SELECT * FROM artist_chart_stats WHERE chart_id = 2) y ON y.artist_id = a.artist_id)
WHERE coalesce(song_rollup, 0) <> song_total_weeks OR coalesce(album_rollup, 0) <> album_total_weeks"""),
)
_add("rollup_parity_of_own", stats.rollup_parity, sql("SELECT artist_id, total_weeks AS song_rollup, total_weeks AS album_rollup, song_total_weeks, album_total_weeks FROM artist_stats JOIN artist_chart_stats USING (artist_id) WHERE chart_id = 1 AND total_weeks <> song_total_weeks"))

# -- records ------------------------------------------------------------------------------------

for _kind, _items in (("song", "songs"), ("album", "albums")):
    _chart = 1 if _kind == "song" else 2
    _add(f"most_weeks_at_number_one_{_items}", lambda t, k=_kind: records.weeks_at_number_one(t, k), board(f"SELECT entity_id AS id, weeks_at_number_one AS value FROM {_kind}_stats WHERE weeks_at_number_one > 0", _items))
    _add(f"longest_chart_runs_{_items}", lambda t, k=_kind: records.longest_chart_runs(t, k), board(f"SELECT entity_id AS id, total_weeks AS value FROM {_kind}_stats", _items))
    _add(f"most_number_one_{_items}_by_artist", lambda t, k=_kind: records.number_ones_by_artist(t, k), board(f"SELECT artist_id AS id, COUNT(DISTINCT entity_id) AS value FROM {_kind}_stats JOIN {_kind}_artists USING (entity_id) WHERE weeks_at_number_one > 0 GROUP BY 1", "people"))
    _add(f"most_entries_by_artist_{_items}", lambda t, k=_kind: records.entries_by_artist(t, k), board(f"SELECT artist_id AS id, total_{_items} AS value FROM artist_stats WHERE value > 0", "people"))
    _add(f"most_total_chart_weeks_by_artist_{_items}", lambda t, k=_kind: records.total_chart_weeks_by_artist(t, k), board(f"SELECT artist_id AS id, {_kind}_total_weeks AS value FROM artist_stats WHERE value > 0", "people"))
    _add(
        f"biggest_debuts_{_items}", lambda t, k=_kind: records.biggest_debuts(t, k),
        sql(f"SELECT row_number() OVER (ORDER BY debut_position, total_weeks DESC, id) AS rank, id, title, artist_credit, debut_position AS value FROM {_kind}_stats JOIN {_items} ON id = entity_id QUALIFY rank <= 25"),
    )
    _add(
        f"fastest_to_number_one_{_items}", lambda t, k=_kind, c=_chart: records.fastest_to_number_one(t, c, k),
        board(f"SELECT entity_id AS id, (MIN(chart_date) FILTER (rank = 1) - MIN(chart_date)) // 7 + 1 AS value FROM chart_entries WHERE chart_id = {_chart} GROUP BY 1 HAVING MIN(rank) = 1", _items, 25, "ASC"),
    )
    _add(
        f"drilldown_number_one_{_items}", lambda t, k=_kind: records.number_one_items(t, k, ARTIST),
        board(f"SELECT entity_id AS id, weeks_at_number_one AS value FROM {_kind}_stats WHERE value > 0 AND entity_id IN (SELECT entity_id FROM {_kind}_artists WHERE artist_id = {ARTIST})", _items, None),
    )
    _add(
        f"drilldown_artist_{_items}", lambda t, k=_kind: records.artist_items(t, k, ARTIST),
        board(f"SELECT entity_id AS id, total_weeks AS value FROM {_kind}_stats WHERE entity_id IN (SELECT entity_id FROM {_kind}_artists WHERE artist_id = {ARTIST})", _items, None),
    )
_add("most_top10_weeks", lambda t: records.top10_weeks(t, 1, "song"), board("SELECT entity_id AS id, COUNT(*) AS value FROM ve WHERE chart_id = 1 AND rank <= 10 GROUP BY 1", "songs"))
_add("most_top10_weeks_genre", lambda t: records.preset(t, "top10_weeks", vw.chart_named(t, "rock-songs")), board("SELECT entity_id AS id, COUNT(*) AS value FROM ve WHERE chart_id = 4 AND rank <= 10 GROUP BY 1", "songs"))
_add(
    "most_number_one_songs_by_lead_artist", lambda t: records.number_ones_by_artist(t, "song", "lead"),
    board("SELECT artist_id AS id, COUNT(DISTINCT entity_id) AS value FROM song_stats JOIN song_artists USING (entity_id) WHERE weeks_at_number_one > 0 AND role = 'primary' GROUP BY 1", "people"),
)
_WEEKLY = "(SELECT artist_id, chart_date, COUNT(*) AS value FROM ve JOIN song_artists USING (entity_id) WHERE chart_id = 1 GROUP BY ALL)"
_add(
    "most_simultaneous_entries", lambda t: records.simultaneous_entries(t, 1),
    sql(f"SELECT row_number() OVER (ORDER BY value DESC, chart_date DESC, name, id) AS rank, id, name AS title, value, chart_date FROM {_WEEKLY} JOIN artists ON id = artist_id QUALIFY rank <= 50"),
)
_add(
    "most_simultaneous_entries_personal_max", lambda t: records.simultaneous_personal_bests(t, 1),
    sql(f"SELECT row_number() OVER (ORDER BY value DESC, name, chart_date, id) AS rank, id, name AS title, value, chart_date FROM (SELECT * FROM {_WEEKLY} QUALIFY value = MAX(value) OVER (PARTITION BY artist_id)) JOIN artists ON id = artist_id QUALIFY rank <= 50"),
)
_add(
    "drilldown_simultaneous", lambda t: records.simultaneous_weeks(t, 1, ARTIST),
    sql(f"""SELECT chart_date, COUNT(*) OVER w AS week_value, row_number() OVER (PARTITION BY chart_date ORDER BY rank) AS week_rank, rank AS entry_rank, id, title, artist_credit
FROM ve JOIN songs ON id = entity_id WHERE chart_id = 1 AND entity_id IN (SELECT entity_id FROM song_artists WHERE artist_id = {ARTIST}) WINDOW w AS (PARTITION BY chart_date)"""),
)
_add("paged_records", lambda t: records.paged(records.longest_chart_runs(t, "song", 200), 2), board("SELECT entity_id AS id, total_weeks AS value FROM song_stats", "songs", 200) + " AND rank BETWEEN 21 AND 30")
_GENDER = "(SELECT a.id AS artist_id, name, coalesce(gender, 'unknown') AS gender, COUNT(*) AS value FROM ve JOIN song_artists USING (entity_id) JOIN artists a ON a.id = artist_id WHERE chart_id = 1 GROUP BY ALL)"
_COVER = f"(SELECT COUNT(*) AS total_artists, COUNT(*) FILTER (gender <> 'unknown') AS matched_artists, COUNT(*) FILTER (gender = 'unknown') AS unknown_artists, COUNT(*) FILTER (gender <> 'unknown') / COUNT(*) AS coverage FROM {_GENDER})"
_add("gender_leaderboard", lambda t: records.gender_leaderboard(t, 1, "song", "female"), sql(f"SELECT *, row_number() OVER (ORDER BY value DESC, name, artist_id) AS rank FROM {_GENDER}, {_COVER} WHERE gender = 'female' QUALIFY rank <= 50"))
_add("gender_leaderboard_coverage", lambda t: records.gender_coverage_of(records.weeks_by_gender(t, 1, "song")), sql(f"SELECT * FROM {_COVER}"))

# -- custom records -----------------------------------------------------------------------------

_add("custom_total_weeks", lambda t: records.custom(t, Custom("songs", 1, "song", peak=(2, 20), weeks_min=2)), board("SELECT entity_id AS id, total_weeks AS value FROM song_stats WHERE peak_position BETWEEN 2 AND 20 AND total_weeks >= 2", "songs"))
_add("custom_weeks_at_number_one", lambda t: records.custom(t, Custom("albums", 2, "album", "weeks-at-number-one", artist_names=["build", "house"])), board("SELECT entity_id AS id, weeks_at_number_one AS value FROM album_stats JOIN albums ON id = entity_id WHERE weeks_at_number_one > 0 AND (artist_credit ILIKE '%build%' OR artist_credit ILIKE '%house%')", "albums"))
_add("custom_weeks_at_position", lambda t: records.custom(t, Custom("songs", 1, "song", "weeks-at-position", 3)), board("SELECT entity_id AS id, COUNT(*) AS value FROM ve JOIN song_stats USING (entity_id) WHERE chart_id = 1 AND rank = 3 GROUP BY 1", "songs"))
_add("custom_weeks_in_top_n", lambda t: records.custom(t, Custom("songs", 4, "song", "weeks-in-top-n", 5, debut=(5, 40))), board("SELECT entity_id AS id, COUNT(*) AS value FROM ve JOIN song_stats USING (entity_id) WHERE chart_id = 4 AND rank <= 5 AND debut_position BETWEEN 5 AND 40 GROUP BY 1", "songs"))
_add("custom_fewest_weeks", lambda t: records.custom(t, Custom("songs", 1, "song", ascending=True, limit=20)), board("SELECT entity_id AS id, total_weeks AS value FROM song_stats", "songs", 20, "ASC"))
_add("custom_year_total_weeks", lambda t: records.custom(t, Custom("songs", 1, "song", years=(1996, 1998), peak=(None, 10))), board(f"SELECT entity_id AS id, total_weeks AS value FROM {years(1996, 1998)} WHERE peak_position <= 10", "songs"))
_add("custom_year_top_n", lambda t: records.custom(t, Custom("songs", 1, "song", "weeks-in-top-n", 10, years=(1997, None))), board("SELECT entity_id AS id, COUNT(*) AS value FROM ve WHERE chart_id = 1 AND rank <= 10 AND year(chart_date) >= 1997 GROUP BY 1", "songs"))
_SUM_ARTISTS = "SELECT artist_id AS id, {0} AS value FROM {1} s JOIN {2} USING (entity_id) {3} GROUP BY 1 HAVING value > 0"
_add("custom_artists", lambda t: records.custom(t, Custom("artists", 1, "song")), board(_SUM_ARTISTS.format("SUM(total_weeks)", "song_stats", "song_artists", ""), "people"))
_add("custom_artists_entries", lambda t: records.custom(t, Custom("artists", 1, "song", "most-entries", scope="lead")), board(_SUM_ARTISTS.format("COUNT(DISTINCT entity_id)", "song_stats", "song_artists", "WHERE role = 'primary'"), "people"))
_add("custom_artists_year", lambda t: records.custom(t, Custom("artists", 2, "album", "number-one-entries", years=(None, 1999))), board(_SUM_ARTISTS.format("COUNT(*) FILTER (weeks_at_number_one > 0)", years(1900, 1999, 2), "album_artists", ""), "people"))

# -- charts by week -----------------------------------------------------------------------------

_DATES = "(SELECT w.chart_id, w.chart_date FROM chart_weeks w JOIN valid v ON v.week_id = w.id)"
_add("available_dates", charts.available_dates, sql(f"SELECT * FROM {_DATES}"))
_add("chart_week_navigation", charts.navigation, sql(f"SELECT *, lag(chart_date) OVER w AS previous_date, lead(chart_date) OVER w AS next_date FROM {_DATES} WINDOW w AS (PARTITION BY chart_id ORDER BY chart_date)"))
_FIRST = "(SELECT entity_id, arg_min(artist_id, (CASE role WHEN 'primary' THEN 0 ELSE 1 END) * 1000000000 + artist_id) AS artist_id FROM {0} GROUP BY 1)"
_add("primary_artist", lambda t: charts.primary_artist(t.song_artists), sql(f"SELECT * FROM {_FIRST.format('song_artists')}"))
for _kind, _items, _chart in (("song", "songs", 1), ("album", "albums", 2), ("artist", "people", 3)):
    _lead = _FIRST.format(f"{_kind}_artists") if _kind != "artist" else "(SELECT id AS entity_id, id AS artist_id FROM artists)"
    _add(
        f"weekly_chart_{_kind}", lambda t, k=_kind, c=_chart: charts.weekly_chart(t, c, k, "1998-05-16" if c == 1 else None),
        sql(f"""SELECT rank, title, artist_credit, artist_id, peak_pos, last_pos, weeks_on_chart, is_new, e.entity_id, chart_date
FROM ve e JOIN {_items} i ON i.id = e.entity_id LEFT JOIN {_lead} l ON l.entity_id = e.entity_id WHERE chart_id = {_chart}
AND chart_date = (SELECT coalesce(MAX(chart_date) FILTER (chart_date = {"DATE '1998-05-16'" if _chart == 1 else 'NULL'}), MAX(chart_date)) FROM {_DATES} WHERE chart_id = {_chart})"""),
    )
_add("asof_chart_date", lambda t: charts.chart_date_for(t, 1, "1999-02-03"), sql(f"SELECT coalesce(MAX(chart_date) FILTER (chart_date <= DATE '1999-02-03'), MIN(chart_date)) AS chart_date FROM {_DATES} WHERE chart_id = 1"))
_add("asof_chart_year", lambda t: charts.chart_date_for(t, 2, "1997"), sql(f"SELECT MAX(chart_date) AS chart_date FROM {_DATES} WHERE chart_id = 2 AND year(chart_date) = 1997"))
_add(
    "chart_movement", charts.moved_entries,
    sql("""SELECT chart_id, chart_date, rank, entity_id,
CASE WHEN is_new THEN 'NEW' WHEN last_pos <= 0 THEN 'RE' WHEN last_pos > rank THEN '▲' || (last_pos - rank) WHEN last_pos < rank THEN '▼' || (rank - last_pos) ELSE '•' END AS movement,
CASE WHEN last_pos = 0 THEN CASE WHEN is_new THEN 'NEW' ELSE 'RE' END WHEN last_pos > rank THEN '+' || (last_pos - rank) WHEN last_pos < rank THEN '' || (last_pos - rank) ELSE '=' END AS signed FROM ve"""),
)
for _name, _gap in (("chart_runs_14d", 14), ("chart_run_segments", 10)):
    _add(
        _name, lambda t, g=_gap: charts.runs(t, g),
        sql(f"""SELECT chart_id, entity_id, CAST(run AS INTEGER) AS run, MIN(chart_date) AS first_date, MAX(chart_date) AS last_date, COUNT(*) AS weeks, MIN(rank) AS best FROM (
SELECT *, SUM(new) OVER (PARTITION BY chart_id, entity_id ORDER BY chart_date) AS run FROM (
SELECT *, CASE WHEN chart_date - lag(chart_date) OVER (PARTITION BY chart_id, entity_id ORDER BY chart_date) > {_gap} THEN 1 ELSE 0 END AS new FROM ve)) GROUP BY chart_id, entity_id, run"""),
    )
for _kind, _id, _charts in (("song", SONG, "1, 4"), ("album", 5, "2")):
    _add(
        f"{_kind}_run_by_chart", lambda t, k=_kind, i=_id: charts.run_by_chart(t, k, i),
        sql(f"SELECT sort_order, slug, chart_date, rank, last_pos, is_new, peak_pos, weeks_on_chart FROM ve JOIN charts c ON c.id = chart_id WHERE entity_id = {_id} AND chart_id IN ({_charts})"),
    )
    _add(f"{_kind}_detail", lambda t, k=_kind: charts.item_detail(t, k), sql(f"SELECT i.*, s.* EXCLUDE (entity_id) FROM {_kind}s i LEFT JOIN {_kind}_stats s ON s.entity_id = i.id"))
    _add(
        f"artist_{_kind}_catalog", lambda t, k=_kind: charts.catalog(t, k),
        sql(f"""SELECT l.artist_id, l.entity_id, o.slug, i.title, peak_position, total_weeks, weeks_at_number_one, debut_date, debut_position
FROM (SELECT DISTINCT artist_id, entity_id FROM {_kind}_artists) l JOIN (SELECT DISTINCT entity_id, slug FROM chart_entries JOIN charts c ON c.id = chart_id WHERE entity_kind = '{_kind}') o ON o.entity_id = l.entity_id
JOIN {_kind}s i ON i.id = l.entity_id LEFT JOIN {_kind}_stats s ON s.entity_id = l.entity_id"""),
    )
_add("entity_artists", lambda t: charts.entity_artists(t, "song"), sql("SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY role, name, artist_id) AS position, artist_id, name, role FROM song_artists JOIN artists ON id = artist_id"))
_add("entity_charts", charts.entity_charts, sql("SELECT DISTINCT entity_kind, entity_id, slug FROM chart_entries JOIN charts c ON c.id = chart_id"))
_add("artist_timeline", lambda t: charts.artist_timeline(t, ARTIST), sql(f"SELECT chart_id, chart_date, rank, last_pos, is_new FROM linked WHERE artist_id = {ARTIST} AND chart_id IN (1, 2)"))
_add("table_counts", charts.table_counts, sql(" UNION ALL ".join(f"SELECT '{n}' AS relation, COUNT(*) AS n FROM {n}" for n in ("chart_weeks", "chart_entries", "songs", "albums", "artists", "song_stats", "album_stats", "artist_stats"))))
_add("latest_chart_dates", lambda t: charts.latest_dates(t, TARGET), sql(f"SELECT slug, MAX(chart_date) AS latest_date FROM chart_weeks JOIN charts c ON c.id = chart_id WHERE chart_date <= DATE '{TARGET}' AND dayofweek(chart_date) = 6 GROUP BY slug"))

# -- analytics ----------------------------------------------------------------------------------

_add(
    "entity_comparison", lambda t: analytics.entity_metrics(t, "song", [SONG, OTHER_SONG]),
    sql(f"""SELECT i.id AS entity_id, i.title AS label, coalesce(c.charts, '') AS charts, peak, coalesce(w, 0) AS weeks_on_chart, coalesce(o, 0) AS weeks_at_number_one, coalesce(n, 0) AS top_ten_weeks, a AS first_date, b AS last_date,
CASE WHEN a IS NULL THEN '' WHEN year(a) = year(b) THEN '' || year(a) ELSE year(a) || '–' || year(b) END AS active_era FROM songs i
LEFT JOIN (SELECT entity_id, string_agg(slug, ',' ORDER BY slug) AS charts FROM (SELECT DISTINCT entity_id, slug FROM chart_entries JOIN charts c ON c.id = chart_id WHERE entity_kind = 'song') GROUP BY 1) c ON c.entity_id = i.id
LEFT JOIN (SELECT entity_id, MIN(rank) AS peak, COUNT(*) AS w, COUNT(*) FILTER (rank = 1) AS o, COUNT(*) FILTER (rank <= 10) AS n, MIN(chart_date) AS a, MAX(chart_date) AS b FROM ve WHERE chart_id IN (1, 4) GROUP BY 1) m ON m.entity_id = i.id
WHERE i.id IN ({SONG}, {OTHER_SONG})"""),
)
_add("presence_by_year", analytics.presence_by_year, sql("SELECT chart_id, entity_id, year(chart_date) AS year, COUNT(*) AS weeks FROM ve GROUP BY ALL"))
_SIDE = "(SELECT year(chart_date) AS year, COUNT(*) AS {1} FROM ve WHERE chart_id = 1 AND entity_id = {0} GROUP BY 1)"
_add("presence_overlay", lambda t: analytics.presence_overlay(t, 1, SONG, OTHER_SONG), sql(f"SELECT year, left_weeks, right_weeks FROM {_SIDE.format(SONG, 'left_weeks')} FULL JOIN {_SIDE.format(OTHER_SONG, 'right_weeks')} USING (year)"))
_add(
    "this_week_in_history", lambda t: analytics.this_week_in_history(t, 1, "song", TARGET),
    sql(f"""SELECT y.year, e.chart_date, e.rank, e.title, e.artist_credit, e.chart_date IS NOT NULL AS charted
FROM (SELECT CAST(unnest(range((SELECT MIN(year(chart_date)) FROM {_DATES} WHERE chart_id = 1), year(DATE '{TARGET}'))) AS INTEGER) AS year) y
LEFT JOIN (SELECT chart_date, rank, title, artist_credit FROM ve JOIN songs ON id = entity_id WHERE chart_id = 1 AND rank <= 10 AND week(chart_date) = week(DATE '{TARGET}') AND chart_date < DATE '{TARGET}') e ON year(e.chart_date) = y.year"""),
)

# -- search -------------------------------------------------------------------------------------

_TRI = r"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _similar(column: str, query: str) -> str:
    a, b = _TRI.format(column), _TRI.format(f"'{query}'")
    both = f"len(list_intersect({a}, {b}))"
    return f"({both} / (len({a}) + len({b}) - {both}))"


for _kind, _query in (("song", "small widget"), ("album", "customer 000000012")):
    _add(
        f"search_{_kind}s", lambda t, k=_kind, q=_query: search.search_items(t, k, q),
        sql(f"""SELECT f.*, peak_position, total_weeks, weeks_at_peak FROM (SELECT *, row_number() OVER (ORDER BY sim DESC, title, id) AS rank FROM (SELECT *, {_similar('title', _query)} AS sim FROM {_kind}s) WHERE sim >= 0.3 QUALIFY rank <= 50) f LEFT JOIN {_kind}_stats s ON s.entity_id = f.id"""),
    )


def _indexed_in_two_loads(t: Tables) -> DataFrame:
    """The search over an index that first holds other titles for some songs and lacks others, and then the songs as they are."""
    index = TitleIndex(t.songs.sparkSession, fresh_path(t.songs.sparkSession, "title_index"))
    index.upsert(t.songs.where("id % 3 > 0").select("id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("small widget "), "title")).otherwise(F.col("title")).alias("title")))
    index.upsert(t.songs.select("id", "title"))
    return search.search_items(t, "song", "small widget", index=index)


_add("search_songs_indexed", _indexed_in_two_loads, _ORACLES["search_songs"])
# Every title that is alike to a query, not only the best ones.
_add(
    "similar_titles", lambda t: search.title_index(t, "album").alike("customer 000000012"),
    sql(f"SELECT id, sim FROM (SELECT id, {_similar('title', 'customer 000000012')} AS sim FROM albums) WHERE sim >= 0.3"),
)
_add(
    "search_artists", lambda t: search.search_artists(t, "supplier 000000007"),
    sql(f"""SELECT row_number() OVER (ORDER BY sim DESC, name, id) AS rank, name AS artist, id, total_songs, total_albums, song_number_ones, album_number_ones, sim
FROM (SELECT id, name, {_similar('name', 'supplier 000000007')} AS sim FROM artists) JOIN artist_stats ON artist_id = id WHERE sim >= 0.3 QUALIFY rank <= 50"""),
)
_add("artist_identity", lambda t: search.identity_ids(_with_aliases(t), ARTIST), sql("SELECT id, CASE WHEN id % 2 = 1 THEN 'janet' ELSE 'Janet  Jackson' END AS name, 'Janet Jackson' AS canonical FROM artists WHERE id BETWEEN 5 AND 8"))

# -- quality ------------------------------------------------------------------------------------

_MISSING = f"(SELECT chart_id, CAST(d AS DATE) AS chart_date FROM (SELECT chart_id, unnest(generate_series(MIN(chart_date), MAX(chart_date), INTERVAL 7 DAY)) AS d FROM {_DATES} GROUP BY 1) EXCEPT SELECT * FROM {_DATES})"
_add("missing_weeks", quality.missing_weeks, sql(f"SELECT * FROM {_MISSING}"))
_add(
    "missing_week_ranges", lambda t: quality.week_ranges(quality.missing_weeks(t)),
    sql(f"SELECT chart_id, MIN(chart_date) AS first_date, MAX(chart_date) AS last_date, COUNT(*) AS weeks FROM (SELECT *, chart_date - CAST(7 * row_number() OVER (PARTITION BY chart_id ORDER BY chart_date) AS INTEGER) AS island FROM {_MISSING}) GROUP BY chart_id, island"),
)
_add("chart_completeness", quality.completeness, sql(f"SELECT chart_id, n AS expected, n - p AS missing, p / n * 100 AS percent FROM (SELECT chart_id, COUNT(*) AS p, (MAX(chart_date) - MIN(chart_date)) // 7 + 1 AS n FROM {_DATES} GROUP BY 1)"))
_add(
    "integrity_counts", quality.integrity_counts,
    sql("""SELECT unnest(['entries without a rank', 'ranks twice in a week', 'dates twice in a chart', 'entries without a week', 'song links without an artist', 'album links without an artist', 'artists of an unlisted gender']) AS rule, 0 AS n
UNION ALL SELECT role || ' song links', COUNT(*) FROM song_artists GROUP BY 1"""),
)
_add("gender_coverage", quality.gender_coverage, sql("SELECT gender, COUNT(*) AS n, COUNT(*) / (SELECT COUNT(*) FROM artists) AS share FROM artists GROUP BY 1"))
_add("gender_coverage_by_source", quality.gender_coverage_by_source, sql("SELECT coalesce(gender_source, 'none') AS source, COUNT(*) AS n, COUNT(*) / (SELECT COUNT(*) FROM artists) AS share FROM artists GROUP BY 1"))
_add("gender_coverage_weighted", quality.gender_coverage_weighted, sql("SELECT CAST(SUM(total_weeks) AS BIGINT) AS total_weight, CAST(SUM(total_weeks) FILTER (gender <> 'unknown') AS BIGINT) AS matched_weight, SUM(total_weeks) FILTER (gender <> 'unknown') / SUM(total_weeks) AS share FROM artist_chart_stats JOIN artists ON id = artist_id"))
_TYPES = ["Person", " group", "Orchestra", "character", "Other"]
_SEXES = ["Female", "male ", "non-binary"]


def _gender_rows(t: Tables) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("id") % n + 1).cast("int"))
    return t.artists.select("id", pick(_TYPES, 5).alias("type"), pick(_SEXES, 3).alias("sex"))


_add(
    "map_gender_mb", lambda t: _gender_rows(t).select("id", quality.gender_of_type(F.col("type"), F.col("sex")).alias("gender")),
    sql("SELECT id, CASE WHEN id % 5 IN (1, 2) THEN 'group' WHEN id % 5 IN (0, 3) AND id % 3 = 0 THEN 'female' WHEN id % 5 IN (0, 3) AND id % 3 = 1 THEN 'male' ELSE 'unknown' END AS gender FROM artists"),
)
_add(
    "map_gender_wikidata",
    lambda t: t.artists.select("id", quality.gender_of_classes(F.when(F.col("id") % 4 == 0, F.array(F.lit("Q5"), F.lit("Q215380"))).when(F.col("id") % 4 == 3, F.array(F.lit("Q1"))).otherwise(F.array(F.lit("Q5"))), F.when(F.col("id") % 3 == 0, quality.MALE).when(F.col("id") % 3 == 1, quality.FEMALE), ["Q215380"]).alias("gender")),
    sql("SELECT id, CASE WHEN id % 4 = 0 THEN 'group' WHEN id % 4 = 3 THEN 'unknown' WHEN id % 3 = 0 THEN 'male' WHEN id % 3 = 1 THEN 'female' ELSE 'unknown' END AS gender FROM artists"),
)


def _candidates(t: Tables) -> DataFrame:
    """Two candidates for each artist, their scores and types by the id."""
    rows = t.artists.select("name", F.col("id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    kind = F.when((F.col("k") == 1) & (F.col("id") % 2 == 0), "Group").otherwise("Person")
    score = F.lit(85) + (F.col("id") * (F.col("k") * 2 + 1)) % 16
    return rows.select("name", F.concat_ws("-", F.col("id").cast("string"), F.col("k").cast("string")).alias("candidate_id"), score.cast("int").alias("score"), kind.alias("type"), F.lit("Male").alias("gender"))


_add(
    "mb_candidate_resolution", lambda t: quality.best_candidates(_candidates(t)).select("name", "candidate_id", "gender"),
    sql("""SELECT name, candidate_id, CASE WHEN kind = 'Group' THEN 'group' ELSE 'male' END AS gender FROM (
SELECT *, lead(score) OVER w AS s2, lead(kind) OVER w AS k2, row_number() OVER w AS n FROM (
SELECT name, id || '-' || k AS candidate_id, 85 + (id * (k * 2 + 1)) % 16 AS score, CASE WHEN k = 1 AND id % 2 = 0 THEN 'Group' ELSE 'Person' END AS kind FROM artists, (VALUES (0), (1)) x(k))
WINDOW w AS (PARTITION BY name ORDER BY score DESC, candidate_id DESC)) WHERE n = 1 AND score >= 90 AND NOT (s2 >= 90 AND score - s2 <= 5 AND kind <> k2)"""),
)

# -- calendar, credits, files, loading ----------------------------------------------------------



def _between_orders(t: Tables) -> DataFrame:
    """The Saturdays from the first album week to the last one, the ends a day inside."""
    a, b = t.weeks.where("chart_id = 2").agg(F.date_add(F.min("chart_date"), 1).cast("string"), F.date_sub(F.max("chart_date"), 1).cast("string")).first()
    return saturdays(t.charts.sparkSession, a, b)


_add("saturday_calendar", _between_orders, sql("SELECT CAST(unnest(generate_series(MIN(chart_date) + INTERVAL 7 DAY, MAX(chart_date) - INTERVAL 7 DAY, INTERVAL 7 DAY)) AS DATE) AS chart_date FROM chart_weeks WHERE chart_id = 2"))
_add(
    "week_calendar", lambda t: t.weeks.select("id", iso_week(F.col("chart_date")).alias("week"), saturday_on_or_before(F.date_sub("chart_date", 3)).alias("before")),
    sql("SELECT id, week(chart_date) AS week, CAST(chart_date - 7 AS DATE) AS before FROM chart_weeks"),
)


def _typed_dates(t: Tables) -> DataFrame:
    text = F.concat(F.date_format("chart_date", "yyyy-MM-"), F.lpad((F.col("id") % 40).cast("string"), 2, "0"))
    return t.weeks.select("id", text.alias("text"), valid_iso_date(text).alias("valid"))


_add("valid_iso_dates", _typed_dates, sql("SELECT id, text, TRY_CAST(text AS DATE) IS NOT NULL AS valid FROM (SELECT id, strftime(chart_date, '%Y-%m-') || lpad('' || id % 40, 2, '0') AS text FROM chart_weeks)"))


def _credit_rows(t: Tables) -> DataFrame:
    """Credits in four shapes, made of names and of an act whose name holds separators."""
    n, i = F.col("name"), F.col("id") % 4
    credit = F.when(i == 0, n).when(i == 1, F.concat(n, F.lit(" Featuring Blood, sweat & Tears"))).when(i == 2, F.concat(n, F.lit(" & Zed With  Hall & Oates and Ann"))).otherwise(F.concat(F.lit("Bo, "), n, F.lit(" X Cy ft. Di")))
    return t.artists.select("id", credit.alias("artist_credit"))


_add(
    "parse_artist_credit", lambda t: parse_credits(_credit_rows(t), "id"),
    sql("""SELECT id, CAST(p AS INTEGER) AS position, CASE WHEN n = '*' THEN name ELSE n END AS name, role FROM artists JOIN (VALUES
(0, 0, '*', 'primary'), (1, 0, '*', 'primary'), (1, 1, 'Blood, Sweat & Tears', 'featured'), (2, 0, '*', 'primary'), (2, 1, 'Zed', 'primary'), (2, 2, 'Hall & Oates', 'with'), (2, 3, 'Ann', 'with'),
(3, 0, 'Bo', 'primary'), (3, 1, '*', 'primary'), (3, 2, 'Cy', 'primary'), (3, 3, 'Di', 'featured')) x(i, p, n, role) ON i = id % 4"""),
)


def _links(t: Tables) -> DataFrame:
    return t.artists.where("id % 3 <> 0").select(F.col("id").alias("entity_id"), F.col("id").alias("artist_id"), F.lit("primary").alias("role")).unionByName(
        t.artists.where("id % 5 = 0").select(F.col("id").alias("entity_id"), F.when(F.col("id") == 1, 2).otherwise(1).cast("long").alias("artist_id"), F.lit("featured").alias("role"))
    )


_add(
    "reconcile_link_diff", lambda t: quality.link_changes(_credit_rows(t), _links(t), t.artists).select("entity_id", "key", "role", "artist_id", "change"),
    sql("""SELECT id AS entity_id, lower(CASE WHEN n = '*' THEN name ELSE n END) AS key, role, NULL AS artist_id, 'add' AS change FROM artists JOIN (VALUES
(0, '*', 'primary'), (1, '*', 'primary'), (1, 'Blood, Sweat & Tears', 'featured'), (2, '*', 'primary'), (2, 'Zed', 'primary'), (2, 'Hall & Oates', 'with'), (2, 'Ann', 'with'),
(3, 'Bo', 'primary'), (3, '*', 'primary'), (3, 'Cy', 'primary'), (3, 'Di', 'featured')) x(i, n, role) ON i = id % 4 WHERE n <> '*' OR id % 3 = 0
UNION ALL SELECT a.id, lower(b.name), NULL, b.id, 'remove' FROM artists a JOIN artists b ON b.id = 1 WHERE a.id % 5 = 0"""),
)
# Credits of every second artist only: whom no link keeps and no credit names can be deleted.
_add(
    "reconcile_orphans", lambda t: quality.orphans(t.artists, [(_credit_rows(t).where("id % 2 = 0"), _links(t).where("entity_id % 2 = 0"))]),
    sql("SELECT id, name, id % 2 = 1 AS deletable FROM artists WHERE id % 3 = 0 OR id % 2 = 1"),
)


def _reconciled(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, their links by key before a reconciliation, and after it."""
    items, links = _credit_rows(t), _links(t)
    before = links.join(t.artists.select(F.col("id").alias("artist_id"), names.name_key(F.col("name")).alias("key")), "artist_id").select("entity_id", "key")
    return items, before, quality.reconciled_links(items, links, t.artists)


_PARTS = """(VALUES (0, '*'), (1, '*'), (1, 'blood, sweat & tears'), (2, '*'), (2, 'zed'), (2, 'hall & oates'), (2, 'ann'), (3, 'bo'), (3, '*'), (3, 'cy'), (3, 'di')) x(i, n)"""
_add("reconciled_links", lambda t: _reconciled(t)[2], sql(f"SELECT id AS entity_id, CASE WHEN n = '*' THEN lower(name) ELSE n END AS key FROM artists JOIN {_PARTS} ON i = id % 4"))


def _broken(t: Tables) -> DataFrame:
    """What the invariants say of a reconciliation that loses the items of every tenth artist, names, and deletes artists."""
    items, before, after = _reconciled(t)
    wrong = after.where("entity_id % 10 <> 0 and not (key = 'zed' and entity_id % 3 = 0)").unionByName(t.artists.where("id % 9 = 1").select(F.col("id").alias("entity_id"), F.lit("stranger").alias("key")))
    deleted = t.artists.where("id % 25 = 3").select(names.name_key(F.col("name")).alias("key")).unionByName(t.artists.where("id = 1").select(F.lit("nobody").alias("key")))
    return quality.broken_invariants(items, before, wrong, deleted, t.artists)


_TARGET = f"(SELECT id, CASE WHEN n = '*' THEN lower(name) ELSE n END AS key FROM artists JOIN {_PARTS} ON i = id % 4)"
_add("reconcile_invariants_hold", lambda t: (lambda r: quality.broken_invariants(r[0], r[1], r[2], t.artists.where("false").select(F.lit("").alias("key")), t.artists))(_reconciled(t)), sql("SELECT '' AS rule, id AS entity_id, name AS key FROM artists WHERE false"))
_add(
    "reconcile_invariants", _broken,
    sql(f"""SELECT 'without artists' AS rule, id AS entity_id, NULL AS key FROM artists WHERE id % 10 = 0 AND (id % 3 <> 0 OR id % 5 = 0) AND NOT id % 9 = 1
UNION ALL SELECT 'missing', id, key FROM {_TARGET} WHERE id % 10 = 0 OR (key = 'zed' AND id % 3 = 0)
UNION ALL SELECT 'unexpected', id, 'stranger' FROM artists WHERE id % 9 = 1
UNION ALL SELECT 'deleted', NULL, lower(name) FROM artists WHERE id % 25 = 3"""),
)


def _named_entries(t: Tables) -> DataFrame:
    """The entries of all charts with what a file says of their items."""
    kinds = F.broadcast(t.charts.select(F.col("id").alias("chart_id"), "entity_kind"))  # the registry
    items = None
    for kind, (rows, _) in t.by_kind.items():
        part = rows.select(F.lit(kind).alias("entity_kind"), F.col("id").alias("entity_id"), "title", "artist_credit")
        items = part if items is None else items.unionByName(part)
    return t.entries.join(kinds, "chart_id").join(items, ["entity_kind", "entity_id"])


_NAMED_ENTRIES = "(SELECT e.*, title, artist_credit FROM chart_entries e JOIN (SELECT 1 AS c, * FROM songs UNION ALL SELECT 4, * FROM songs UNION ALL SELECT 2, * FROM albums UNION ALL SELECT 3, * FROM people) i(c, item, title, artist_credit) ON i.c = e.chart_id AND i.item = e.entity_id)"


def _files(t: Tables) -> DataFrame:
    """All charts as week files: a text for each week, of at most the chart's depth."""
    entry = F.struct("rank", "title", F.col("artist_credit").alias("artist"), F.col("peak_pos").alias("peakPos"), F.col("last_pos").alias("lastPos"), F.col("weeks_on_chart").alias("weeks"), F.col("is_new").alias("isNew"), F.lit(" data:x").alias("image"))
    return _named_entries(t).groupBy("chart_id", "chart_date").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("text"))


_add(
    "parse_chart_json", lambda t: week_files.parse(_files(t)),
    sql(f"SELECT chart_id, chart_date, rank - 1 AS position, rank, title, artist_credit AS artist, peak_pos, last_pos, weeks_on_chart AS weeks, is_new, CAST(NULL AS VARCHAR) AS image FROM {_NAMED_ENTRIES}"),
)


def _odd_files(t: Tables) -> DataFrame:
    """Those of all charts in one folder, the chart before the date's file: some months' files have odd names or texts."""
    month = F.month("chart_date")
    name = F.concat(F.col("chart_date").cast("string"), F.when(month == 2, "x").otherwise(""), F.lit(".json"))
    text = F.when(month == 3, F.lit("[{")).when(month == 4, F.lit("[]")).otherwise(F.col("text"))
    return _files(t).select("chart_id", name.alias("file_name"), F.length("text").alias("bytes"), text.alias("text"))


def _audit(t: Tables) -> DataFrame:
    charts_of = [r["id"] for r in t.charts.select("id").collect()]  # the registry
    audits = [week_files.audit(_odd_files(t).where(F.col("chart_id") == i).drop("chart_id"), "2001-01-06").select(F.lit(i).alias("chart_id"), "chart_date", "verdict") for i in charts_of]
    out = audits[0]
    for more in audits[1:]:
        out = out.unionByName(more)
    return out


_add(
    "integrity_audit", _audit,
    sql("SELECT chart_id, CASE WHEN month(chart_date) <> 2 THEN chart_date END AS chart_date, CASE WHEN month(chart_date) = 2 THEN 'bad name' WHEN chart_date > DATE '2001-01-06' THEN 'future' WHEN month(chart_date) = 3 THEN 'invalid json' WHEN month(chart_date) = 4 THEN 'invalid payload' ELSE 'ok' END AS verdict FROM chart_weeks"),
)
_add(
    "upsert_chart_weeks", lambda t: ingest.upsert_weeks(t.weeks.where("chart_date < '1999-01-01'"), t.weeks),
    sql("""SELECT id, chart_id, chart_date FROM chart_weeks WHERE chart_date < DATE '1999-01-01'
UNION ALL SELECT (SELECT MAX(id) FROM chart_weeks WHERE chart_date < DATE '1999-01-01') + row_number() OVER (ORDER BY chart_id, chart_date), chart_id, chart_date FROM chart_weeks WHERE chart_date >= DATE '1999-01-01'"""),
)
_add(
    "load_chart_entries", lambda t: ingest.load_entries(t.entries.where("rank % 2 = 0").select("week_id", "rank", "entity_id"), t.entries.select("week_id", (F.col("rank") / 3).cast("int").alias("rank"), "entity_id", F.col("rank").alias("position"))),
    sql("""SELECT week_id, rank, entity_id FROM chart_entries WHERE rank % 2 = 0
UNION ALL SELECT week_id, rank // 3, entity_id FROM (SELECT * FROM chart_entries QUALIFY row_number() OVER (PARTITION BY week_id, rank // 3 ORDER BY rank) = 1) n
WHERE NOT EXISTS (SELECT 1 FROM chart_entries e WHERE e.rank % 2 = 0 AND e.week_id = n.week_id AND e.rank = n.rank // 3)"""),
)
_add("incremental_new_weeks", lambda t: ingest.new_weeks(t.weeks, t.weeks.where("chart_date < '2000-01-01' and chart_id <> 3"), TARGET).select("chart_id", "chart_date"), sql(f"SELECT chart_id, chart_date FROM chart_weeks WHERE chart_id <> 3 AND chart_date >= DATE '2000-01-01' AND chart_date <= DATE '{TARGET}'"))
_add("new_artist_delta", lambda t: ingest.upsert_artists(t.artists.where("id % 2 = 0").select("id", "name"), t.artists), sql("SELECT id, name FROM artists WHERE id % 2 = 0 UNION ALL SELECT (SELECT MAX(id) FROM artists WHERE id % 2 = 0) + row_number() OVER (ORDER BY name), name FROM artists WHERE id % 2 = 1"))



# -- what a loader keeps ------------------------------------------------------------------------

# The first load of all songs into an empty table, and one into a table that has every third of them.
_PARSED = """(SELECT title, artist_credit, MIN(chart_date) AS d, arg_min(rank, chart_date) AS p FROM chart_entries JOIN songs ON id = entity_id WHERE chart_id = 1 GROUP BY title, artist_credit)"""


def _parsed_songs(t: Tables) -> DataFrame:
    rows = t.entries.where("chart_id = 1").join(t.songs.withColumnRenamed("id", "entity_id"), "entity_id")
    return rows.select("chart_date", F.col("rank").alias("position"), "title", F.col("artist_credit").alias("artist"), F.when(F.col("rank") % 2 == 0, F.concat(F.lit("i"), F.col("rank").cast("string"))).alias("image"))


def _stored_songs(t: Tables) -> DataFrame:
    return t.songs.where("id % 3 = 0").select("id", "title", "artist_credit", F.lit("old").alias("image"))


_add(
    "upsert_entities", lambda t: ingest.upsert_items(_stored_songs(t), _parsed_songs(t)),
    sql(f"""SELECT s.id, s.title, s.artist_credit, coalesce(CASE WHEN p % 2 = 0 THEN 'i' || p END, 'old') AS image FROM songs s LEFT JOIN {_PARSED} n ON n.title = s.title AND n.artist_credit = s.artist_credit WHERE s.id % 3 = 0
UNION ALL SELECT (SELECT MAX(id) FROM songs WHERE id % 3 = 0) + row_number() OVER (ORDER BY d, p, n.title, n.artist_credit), n.title, n.artist_credit, CASE WHEN p % 2 = 0 THEN 'i' || p END
FROM {_PARSED} n JOIN songs s ON s.title = n.title AND s.artist_credit = n.artist_credit WHERE s.id % 3 <> 0"""),
)
_add(
    "artist_links", lambda t: ingest.artist_links(_credit_rows(t), t.artists),
    sql("SELECT id AS entity_id, id AS artist_id, 'primary' AS role FROM artists"),
)


def _double_credits(t: Tables) -> DataFrame:
    """Items that credit an artist twice, first as featured after the neighbour, so the first role counts."""
    after = t.artists.select((F.col("id") - 1).alias("id"), F.col("name").alias("_next"))
    return t.artists.join(after, "id").select("id", F.concat("name", F.lit(" Featuring "), "_next", F.lit(", "), "name").alias("artist_credit"))


_add(
    "artist_links_first_role", lambda t: ingest.artist_links(_double_credits(t), t.artists),
    sql("SELECT id AS entity_id, id AS artist_id, 'primary' AS role FROM artists WHERE id < (SELECT MAX(id) FROM artists) UNION ALL SELECT id, id + 1, 'featured' FROM artists WHERE id < (SELECT MAX(id) FROM artists)"),
)
_add(
    "register_charts", lambda t: ingest.register_charts(ingest.register_charts(t.charts, _curated(t)), _curated(t)),
    sql(f"""SELECT * FROM charts UNION ALL SELECT 4 + row_number() OVER (ORDER BY slug), slug, title, entity_kind, 'genre', true, 40, NULL FROM {_DATA_CHARTS}"""),
)


def _curated(t: Tables) -> DataFrame:
    """The charts of the data, once more with other titles for those that the registry has."""
    known = t.charts.select("slug", F.lit("Other title").alias("title"), "entity_kind", "category")
    return _data_charts(t).drop("n").unionByName(known)


def _fallback(t: Tables) -> DataFrame:
    """What the second catalogue says: an ensemble, a woman or nothing, by the id."""
    classes = F.when(F.col("id") % 3 == 0, F.array(F.lit("Q215380"))).when(F.col("id") % 3 == 1, F.array(F.lit("Q5"))).otherwise(F.array(F.lit("Q1")))
    return t.artists.select("name", F.concat(F.lit("Q"), F.col("id").cast("string")).alias("source_id"), classes.alias("classes"), F.lit(quality.FEMALE).alias("sex"))


def _first_candidates(t: Tables) -> DataFrame:
    """The candidates of ``_candidates``; every fourth artist's have a sex that is no gender of the model."""
    return _candidates(t).withColumn("gender", F.when(F.regexp_extract("candidate_id", r"^(\d+)-", 1).cast("long") % 4 == 1, "non-binary").otherwise(F.col("gender")))


_RESOLVED = """(SELECT a.id, a.name, CASE WHEN c.id IS NOT NULL THEN c.gender WHEN a.id % 3 = 0 THEN 'group' WHEN a.id % 3 = 1 THEN 'female' END AS gender,
CASE WHEN c.id IS NOT NULL THEN 'first' WHEN a.id % 3 < 2 THEN 'second' END AS source, coalesce(c.candidate_id, 'Q' || a.id) AS source_id
FROM artists a LEFT JOIN (SELECT id, candidate_id, CASE WHEN kind = 'Group' THEN 'group' WHEN id % 4 = 1 THEN 'unknown' ELSE 'male' END AS gender FROM (
SELECT *, lead(score) OVER w AS s2, lead(kind) OVER w AS k2, row_number() OVER w AS n FROM (
SELECT id, id || '-' || k AS candidate_id, 85 + (id * (k * 2 + 1)) % 16 AS score, CASE WHEN k = 1 AND id % 2 = 0 THEN 'Group' ELSE 'Person' END AS kind FROM artists, (VALUES (0), (1)) x(k))
WINDOW w AS (PARTITION BY id ORDER BY score DESC, candidate_id DESC)) WHERE n = 1 AND score >= 90 AND NOT (s2 >= 90 AND score - s2 <= 5 AND kind <> k2)) c ON c.id = a.id)"""
_add("gender_resolution", lambda t: quality.resolved_genders(t.artists, _first_candidates(t), _fallback(t), ["Q215380"]), sql(f"SELECT name, gender, source, source_id FROM {_RESOLVED} WHERE source IS NOT NULL"))
_add(
    "gender_update", lambda t: ingest.set_genders(t.artists, quality.resolved_genders(t.artists.where("gender = 'unknown'"), _first_candidates(t), _fallback(t), ["Q215380"])),
    sql(f"SELECT a.id, a.name, CASE WHEN a.gender = 'unknown' THEN coalesce(r.gender, 'unknown') ELSE a.gender END AS gender, CASE WHEN a.gender = 'unknown' THEN coalesce(r.source, a.gender_source) ELSE a.gender_source END AS gender_source FROM artists a JOIN {_RESOLVED} r ON r.id = a.id"),
)
_add(
    "gap_repair", lambda t: ingest.repaired_weeks(t.weeks.select("chart_id", "chart_date", (F.col("id") % 300).alias("bytes")), t.weeks.where("id % 2 = 0"), [1, 2], 1997, TARGET),
    sql(f"SELECT chart_id, chart_date, id % 300 AS bytes FROM chart_weeks WHERE id % 2 = 1 AND id % 300 >= 100 AND chart_id IN (1, 2) AND year(chart_date) >= 1997 AND chart_date <= DATE '{TARGET}'"),
)


def _audited(t: Tables) -> DataFrame:
    """Audited files of the core album chart, of which some weeks have none, and some a bad name or text."""
    kept = t.weeks.where("chart_id = 2 and id % 5 <> 0").select("chart_date", F.concat(F.col("chart_date").cast("string"), F.when(F.month("chart_date") == 2, "x").otherwise(""), F.lit(".json")).alias("file_name"))
    text = F.when(F.month("chart_date") == 3, F.lit("[]")).otherwise(F.lit('[{"rank": 1, "title": "t", "artist": "a"}]'))
    size = F.when(F.month("chart_date") == 4, 20).otherwise(500).cast("long")
    return week_files.audit(kept.select("file_name", size.alias("bytes"), text.alias("text")), TARGET)


_NAMED = "(SELECT chart_date, month(chart_date) AS m FROM chart_weeks WHERE chart_id = 2 AND id % 5 <> 0)"
_SPAN = f"(SELECT CAST(unnest(generate_series((SELECT MIN(chart_date) FROM {_NAMED} WHERE m <> 2), (SELECT least(MAX(chart_date), DATE '{TARGET}') FROM {_NAMED} WHERE m <> 2 AND chart_date <= DATE '{TARGET}'), INTERVAL 7 DAY)) AS DATE) AS chart_date)"
_add(
    "repair_dates", lambda t: week_files.repair_dates(_audited(t), TARGET),
    sql(f"SELECT chart_date FROM {_SPAN} WHERE chart_date NOT IN (SELECT chart_date FROM {_NAMED} WHERE m <> 2) UNION SELECT chart_date FROM {_NAMED} WHERE m IN (3, 4) AND chart_date <= DATE '{TARGET}'"),
)
_add("repair_skipped_files", lambda t: week_files.skipped_files(_audited(t)), sql(f"SELECT chart_date || 'x.json' AS file_name FROM {_NAMED} WHERE m = 2"))
_add(
    "failed_downloads", lambda t: week_files.failed_downloads(t.charts.sparkSession, t.weeks.where("chart_id = 1").select("chart_date", (F.col("id") % 300).alias("bytes")), 1996, 1999),
    sql("SELECT CAST(d AS DATE) AS chart_date FROM (SELECT unnest(generate_series(DATE '1996-01-06', DATE '1999-12-25', INTERVAL 7 DAY)) AS d) WHERE CAST(d AS DATE) NOT IN (SELECT chart_date FROM chart_weeks WHERE chart_id = 1 AND id % 300 >= 100)"),
)


def _outcomes(t: Tables) -> DataFrame:
    """How each chart's weeks came out: three weeks without data in a row stand where a chart's id says."""
    hole = F.date_add(F.lit("1996-06-01").cast("date"), F.col("chart_id") * 70)
    outcome = F.when(F.col("id") % 7 == 0, "failed").when(F.col("id") % 3 == 0, "skipped").otherwise("saved")
    return t.weeks.where((F.col("chart_date") < hole) | (F.col("chart_date") >= F.date_add(hole, 21))).select("chart_id", "chart_date", outcome.alias("outcome"))


_add(
    "debut_walk", lambda t: week_files.debut_walk(_outcomes(t).where("chart_id <> 4 or chart_date > '1996-01-01'"), "2000-12-30", "1995-07-01", 3),
    sql("""SELECT c.chart_id, MIN(chart_date) FILTER (o IN ('saved', 'skipped')) AS earliest, COUNT(*) FILTER (o = 'saved') AS saved, COUNT(*) FILTER (o = 'skipped') AS skipped, COUNT(*) FILTER (o = 'failed') AS failed, 'debut' AS reason
FROM (SELECT chart_id, chart_date, CASE WHEN id % 7 = 0 THEN 'failed' WHEN id % 3 = 0 THEN 'skipped' ELSE 'saved' END AS o FROM chart_weeks
WHERE chart_date >= CAST(DATE '1996-06-01' + CAST(chart_id * 70 + 21 AS INTEGER) AS DATE) AND chart_date <= DATE '2000-12-30') c GROUP BY 1"""),
)
for _by, _up in (("total_weeks", True), ("total_weeks", False), ("debut_date", True), ("title", False)):
    _nulls = {("total_weeks", True): "NULLS LAST", ("total_weeks", False): "NULLS FIRST", ("debut_date", True): "NULLS FIRST"}.get((_by, _up), "")
    _add(
        f"catalog_by_{_by}_{'up' if _up else 'down'}", lambda t, b=_by, u=_up: records.sorted_catalog(charts.item_detail(t, "song").withColumnRenamed("id", "entity_id").select("entity_id", *records.CATALOG_ORDER), b, u),
        sql(f"SELECT row_number() OVER (ORDER BY {_by} {'ASC' if _up else 'DESC'} {_nulls}{', title' if _by == 'total_weeks' else ''}, id) AS position, id AS entity_id, title, peak_position, total_weeks, weeks_at_number_one, debut_date, last_date FROM songs LEFT JOIN song_stats ON id = entity_id"),
    )
_add(
    "custom_name_list", lambda t: records.custom(t, Custom("songs", 1, "song", artist_names=records.split_names(" brand#11, ,BRAND#23 ,"))),
    board("SELECT entity_id AS id, total_weeks AS value FROM song_stats JOIN songs ON id = entity_id WHERE artist_credit ILIKE '%brand#11%' OR artist_credit ILIKE '%brand#23%'", "songs"),
)


def _round_trip(t: Tables) -> DataFrame:
    """All charts written as week files and parsed again."""
    folder = fresh_path(t.charts.sparkSession, "week_files")
    rows = _named_entries(t).select("chart_id", "chart_date", "rank", "title", F.col("artist_credit").alias("artist"), F.col("weeks_on_chart").alias("weeks"))
    week_files.write_week_files(rows, folder, ("chart_id",))
    found = week_files.parse(week_files.with_dates(week_files.read_week_folders(t.charts.sparkSession, folder, "chart_id int")))
    return found.select("chart_id", "chart_date", "position", "rank", "title", "artist", "weeks")


_add("week_file_round_trip", _round_trip, sql(f"SELECT chart_id, chart_date, rank - 1 AS position, rank, title, artist_credit AS artist, weeks_on_chart AS weeks FROM {_NAMED_ENTRIES}"))


def _sidecar(t: Tables) -> DataFrame:
    """The registry's first weeks, written as a sidecar file and read again."""
    first = t.weeks.groupBy("chart_id").agg(F.min("chart_date").cast("string").alias("first_date")).join(t.charts.select(F.col("id").alias("chart_id"), "slug"), "chart_id")
    text = first.agg(F.to_json(F.collect_list(F.struct("slug", "first_date"))).alias("value"))  # a registry
    folder = fresh_path(t.charts.sparkSession, "sidecar")
    text.coalesce(1).write.text(folder)
    return week_files.verified_charts(t.charts.sparkSession, folder)


_add("verified_charts", _sidecar, sql("SELECT slug, MIN(chart_date) AS first_date FROM chart_weeks JOIN charts c ON c.id = chart_id GROUP BY slug"))

_QUERIES["weekly_activity"] = lambda spark, sf_dir: weekly_activity(spark.read.parquet(f"{sf_dir}/events.parquet"))
_ORACLES["weekly_activity"] = "SELECT CAST(CAST(ts AS DATE) + CAST(6 - dayofweek(CAST(ts AS DATE)) AS INTEGER) AS DATE) AS week, event_type, COUNT(*) AS n, SUM(CAST(value AS DECIMAL(18, 2))) AS total FROM events GROUP BY 1, 2"

# -- stores, bulk requests and streams ----------------------------------------------------------

for _name, _over in stored.QUERIES.items():
    _add(_name, _over, stored.ORACLES[_name])
_QUERIES["order_chart_weeks"] = lambda spark, sf_dir: stored._order_weeks(project(spark, sf_dir), spark.read.parquet(f"{sf_dir}/orders.parquet"))
_ORACLES["order_chart_weeks"] = stored._ORDER_WEEKS
