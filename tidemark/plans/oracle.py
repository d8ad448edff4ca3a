"""The chart model in DuckDB SQL: what the oracles of the registry select from.

Written from the definitions in ``FIXTURES.md``, with joins and windows of its own, so that the comparison
is between two implementations.
"""

from __future__ import annotations

_SAT = "CAST(CAST({0} AS DATE) + CAST(6 - dayofweek(CAST({0} AS DATE)) AS INTEGER) AS DATE)"

PRELUDE = f"""
WITH charts(id, slug, title, entity_kind, category, is_active, sort_order, depth) AS (VALUES
  (1, 'song-core', 'Core Songs', 'song', 'core', true, 10, 40), (2, 'album-core', 'Core Albums', 'album', 'core', true, 20, 30),
  (3, 'artist-core', 'Core Artists', 'artist', 'artist', true, 30, 20), (4, 'rock-songs', 'Rock Songs', 'song', 'genre', true, 40, 20)),
units AS (
  SELECT 1 AS chart_id, {_SAT.format('l_shipdate')} AS chart_date, l_partkey + 1 AS entity_id, SUM(CAST(l_quantity AS BIGINT)) AS units FROM lineitem GROUP BY ALL
  UNION ALL SELECT 2, {_SAT.format('o_orderdate')}, o_custkey + 1, COUNT(*) FROM orders GROUP BY ALL
  UNION ALL SELECT 3, {_SAT.format('l_shipdate')}, l_suppkey + 1, SUM(CAST(l_quantity AS BIGINT)) FROM lineitem GROUP BY ALL
  UNION ALL SELECT 4, {_SAT.format('l_shipdate')}, l_partkey + 1, SUM(CAST(l_quantity AS BIGINT)) FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
kept AS (
  SELECT u.chart_id, chart_date, entity_id, row_number() OVER (PARTITION BY u.chart_id, chart_date ORDER BY units DESC, entity_id) AS rank, depth
  FROM units u JOIN charts c ON c.id = u.chart_id QUALIFY rank <= depth),
chart_weeks AS (
  SELECT CAST(chart_id * 10000 + ((row_number() OVER (PARTITION BY chart_id ORDER BY chart_date) - 1) * 7919) % 10000 AS INTEGER) AS id, chart_id, chart_date
  FROM (SELECT DISTINCT chart_id, chart_date FROM kept)),
chart_entries AS (
  SELECT k.chart_id, w.id AS week_id, k.chart_date, entity_id, rank, min(rank) OVER run AS peak_pos,
         CASE WHEN k.chart_date - lag(k.chart_date) OVER run = 7 THEN lag(rank) OVER run ELSE 0 END AS last_pos,
         row_number() OVER run AS weeks_on_chart, row_number() OVER run = 1 AS is_new
  FROM kept k JOIN chart_weeks w ON w.chart_id = k.chart_id AND w.chart_date = k.chart_date
  WINDOW run AS (PARTITION BY k.chart_id, entity_id ORDER BY k.chart_date)),
phantoms AS (
  SELECT chart_id, week_id, COUNT(*) AS entries, COUNT(*) FILTER (is_new AND weeks_on_chart = 1) AS fresh,
         COUNT(*) FILTER (is_new AND weeks_on_chart = 1) >= (COUNT(*) * 95) // 100 AS phantom
  FROM chart_entries GROUP BY chart_id, week_id),
real_first AS (SELECT chart_id, MIN(week_id) AS week_id FROM phantoms WHERE phantom GROUP BY chart_id),
valid AS (
  SELECT chart_id, week_id FROM phantoms WHERE NOT phantom UNION SELECT chart_id, week_id FROM real_first),
ve AS (SELECT e.* FROM chart_entries e WHERE week_id IN (SELECT week_id FROM valid)),
n_artists AS (SELECT COUNT(*) AS n FROM supplier),
artists AS (
  SELECT s_suppkey + 1 AS id, s_name AS name, ['female', 'male', 'group', 'mixed', 'unknown'][CAST(s_suppkey % 5 + 1 AS INTEGER)] AS gender,
         CASE WHEN s_suppkey % 5 = 4 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'catalogue' ELSE 'manual' END AS gender_source FROM supplier),
song_artists AS (
  SELECT p_partkey + 1 AS entity_id, p_partkey % n + 1 AS artist_id, 'primary' AS role FROM part, n_artists
  UNION ALL SELECT p_partkey + 1, (p_partkey * 7 + 3) % n + 1, 'featured' FROM part, n_artists
  WHERE p_partkey % 3 = 0 AND (p_partkey * 7 + 3) % n <> p_partkey % n),
album_artists AS (SELECT c_custkey + 1 AS entity_id, c_custkey % n + 1 AS artist_id, 'primary' AS role FROM customer, n_artists),
songs AS (SELECT p_partkey + 1 AS id, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS title, p_brand AS artist_credit FROM part),
albums AS (SELECT c_custkey + 1 AS id, c_name AS title, c_mktsegment AS artist_credit FROM customer),
people AS (SELECT id, name AS title, name AS artist_credit FROM artists),
credits AS (
  SELECT c.id AS chart_id, l.entity_id, l.artist_id, l.role FROM song_artists l, charts c WHERE entity_kind = 'song'
  UNION ALL SELECT c.id, l.entity_id, l.artist_id, l.role FROM album_artists l, charts c WHERE entity_kind = 'album'
  UNION ALL SELECT c.id, a.id, a.id, 'primary' FROM artists a, charts c WHERE entity_kind = 'artist'),
item_stats AS (
  SELECT chart_id, entity_id, COUNT(*) AS total_weeks, MIN(rank) AS peak_position, COUNT(*) FILTER (rank = best) AS weeks_at_peak,
         COUNT(*) FILTER (rank = 1) AS weeks_at_number_one, MIN(chart_date) AS debut_date, MAX(chart_date) AS last_date,
         arg_min(rank, chart_date) AS debut_position
  FROM (SELECT *, MIN(rank) OVER (PARTITION BY chart_id, entity_id) AS best FROM ve) GROUP BY chart_id, entity_id),
song_stats AS (SELECT * EXCLUDE (chart_id) FROM item_stats WHERE chart_id = 1),
album_stats AS (SELECT * EXCLUDE (chart_id) FROM item_stats WHERE chart_id = 2),
linked AS (SELECT artist_id, role, e.* FROM ve e JOIN credits c USING (chart_id, entity_id)),
at_once AS (SELECT artist_id, chart_id, MAX(n) AS max_simultaneous FROM (SELECT artist_id, chart_id, week_id, COUNT(*) AS n FROM linked GROUP BY ALL) GROUP BY ALL),
artist_chart_stats AS (
  SELECT artist_id, chart_id, COUNT(DISTINCT entity_id) AS total_entries, COUNT(*) AS total_weeks,
         COUNT(DISTINCT entity_id) FILTER (rank = 1) AS number_ones, MIN(rank) AS best_peak, MIN(chart_date) AS first_date, MAX(chart_date) AS last_date,
         ANY_VALUE(max_simultaneous) AS max_simultaneous
  FROM linked JOIN at_once USING (artist_id, chart_id) GROUP BY artist_id, chart_id),
artist_stats AS (
  SELECT a.id AS artist_id, (SELECT COUNT(DISTINCT entity_id) FROM song_artists s WHERE s.artist_id = a.id) AS total_songs,
         (SELECT COUNT(DISTINCT entity_id) FROM album_artists s WHERE s.artist_id = a.id) AS total_albums,
         coalesce(x.total_weeks, 0) AS song_total_weeks, coalesce(y.total_weeks, 0) AS album_total_weeks,
         coalesce(x.number_ones, 0) AS song_number_ones, coalesce(y.number_ones, 0) AS album_number_ones,
         x.best_peak AS song_best_peak, y.best_peak AS album_best_peak,
         coalesce(x.max_simultaneous, 0) AS song_max_simultaneous, coalesce(y.max_simultaneous, 0) AS album_max_simultaneous,
         least(x.first_date, y.first_date) AS first_date, greatest(x.last_date, y.last_date) AS last_date
  FROM artists a LEFT JOIN (SELECT * FROM artist_chart_stats WHERE chart_id = 1) x ON x.artist_id = a.id
  LEFT JOIN (SELECT * FROM artist_chart_stats WHERE chart_id = 2) y ON y.artist_id = a.id)
"""


def sql(tail: str) -> str:
    """A query over the chart model."""
    return PRELUDE + tail


def board(values: str, items: str, limit: int | None = 50, direction: str = "DESC") -> str:
    """The leaderboard of rows (id, value): numbered by value, title and id."""
    cut = "" if limit is None else f" QUALIFY rank <= {limit}"
    return sql(
        f"SELECT row_number() OVER (ORDER BY value {direction}, i.title, i.id) AS rank, i.id, i.title, i.artist_credit, CAST(value AS BIGINT) AS value "
        f"FROM ({values}) v JOIN {items} i ON i.id = v.id{cut}"
    )


def years(first: int, last: int, chart_id: int = 1) -> str:
    """A subquery like song_stats, of some years alone."""
    return f"""(
  SELECT entity_id, COUNT(*) AS total_weeks, MIN(rank) AS peak_position, COUNT(*) FILTER (rank = 1) AS weeks_at_number_one, arg_min(rank, chart_date) AS debut_position
  FROM ve WHERE chart_id = {chart_id} AND year(chart_date) BETWEEN {first} AND {last} GROUP BY entity_id)"""
