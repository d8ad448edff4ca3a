"""Fuzzy search of titles and names by trigrams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import SIMILAR, canonical_name, similarity, trigrams
from tidemark.operators.records import listed
from tidemark.operators.stats import artist_stats, item_stats
from tidemark.operators.title_index import TitleIndex
from tidemark.operators.valid_weeks import valid_entries
from tidemark.sources.projection import CORE_ALBUMS, CORE_SONGS, Tables
from tidemark.sources.shared import staged

LIMIT, LEAST_LETTERS = 50, 2


def alike(rows: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose text is similar to the query, with ``sim``; a query of one letter finds nothing."""
    query = query.strip()
    if len(query) < LEAST_LETTERS:
        return rows.where("false").withColumn("sim", F.lit(0.0))
    wanted = F.lit(query)
    return rows.withColumn("sim", similarity(trigrams(F.col(column)), trigrams(wanted))).where(F.col("sim") >= SIMILAR)


def title_index(t: Tables, kind: str) -> TitleIndex:
    """The stored index of a kind's titles; made when it is asked for first."""
    index = TitleIndex(t.songs.sparkSession, f"{t.home}/{kind}")
    if index.is_empty:
        index.upsert(t.by_kind[kind][0].select("id", "title"))
    return index


def search_items(t: Tables, kind: str, query: str, limit: int = LIMIT, index: TitleIndex | None = None) -> DataFrame:
    """Items with a title like the query, and the career of these alone: their ids reduce the entries before any sum.

    Titles are found by an index (the stored one by default), so none is compared that shares no trigram with the query.
    """
    items, query = t.by_kind[kind][0], query.strip()
    if len(query) < LEAST_LETTERS:
        found = alike(items, "title", query).withColumn("rank", F.lit(0))
    else:
        best = listed((index or title_index(t, kind)).best(query, limit), [F.desc("sim"), F.asc("title"), F.asc("id")], limit)
        best = F.broadcast(staged(best.select("id", "sim", "rank"), "found"))  # at most records.MOST_ROWS
        found = items.join(best, "id")
    ids = F.broadcast(found.select(F.col("id").alias("entity_id")))  # at most records.MOST_ROWS
    entries = valid_entries(t, [CORE_SONGS if kind == "song" else CORE_ALBUMS]).join(ids, "entity_id", "left_semi")
    stats = item_stats(entries).select(F.col("entity_id").alias("id"), "peak_position", "total_weeks", "weeks_at_peak")
    return found.join(F.broadcast(stats), "id", "left")  # at most a row for each one found


def search_artists(t: Tables, query: str, limit: int = LIMIT) -> DataFrame:
    """Artists, the names of one artist folded: sums of the statistics of those found, the best similarity."""
    found = listed(alike(t.artists.select("id", "name"), "name", query), [F.desc("sim"), F.asc("name"), F.asc("id")], limit).drop("rank")
    found = staged(found, "found")  # compared once
    ids = F.broadcast(found.select(F.col("id").alias("artist_id")))  # at most records.MOST_ROWS
    # Statistics of the found artists alone: links and, through them, entries are reduced before any sum.
    own = replace(
        t, artists=t.artists.join(ids.withColumnRenamed("artist_id", "id"), "id", "left_semi"),
        song_artists=t.song_artists.join(ids, "artist_id", "left_semi"), album_artists=t.album_artists.join(ids, "artist_id", "left_semi"),
    )
    stats = artist_stats(own).select(F.col("artist_id").alias("id"), "total_songs", "total_albums", "song_number_ones", "album_number_ones")
    canonical = canonical_name(F.col("name"))
    folded = found.join(stats, "id", "left").groupBy(canonical.alias("artist")).agg(
        F.min_by("id", F.struct(F.when(F.col("name") == canonical, 0).otherwise(1), -F.col("sim"), "id")).alias("id"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("int").alias(c) for c in ("total_songs", "total_albums", "song_number_ones", "album_number_ones")],
        F.max("sim").alias("sim"),
    )
    return listed(folded, [F.desc("sim"), F.asc("artist"), F.asc("id")], limit)


def identity_ids(t: Tables, artist_id: int) -> DataFrame:
    """(id, name, canonical): all ids of the artist who has this one."""
    people = t.artists.select("id", "name", canonical_name(F.col("name")).alias("canonical"))
    return people.join(F.broadcast(people.where(F.col("id") == artist_id).select("canonical")), "canonical", "left_semi")  # one row
