"""Golden rows for the chart operators: small hand-made relations."""

import datetime as dt

import pytest

from tidemark.functions.credits import parse_credits
from tidemark.functions.names import canonical_name, identity_group, similarity, trigrams
from tidemark.operators import quality, records, stats
from tidemark.operators.valid_weeks import chart_named, judged_weeks, valid_weeks
from tidemark.sources.projection import CHART_COLUMNS, Tables

ENTRY = "chart_id int, week_id int, chart_date date, entity_id long, rank int, peak_pos int, last_pos int, weeks_on_chart int, is_new boolean"


def entry(chart, week, day, entity, rank, new=False, weeks=None):
    return (chart, week, dt.date.fromisoformat(day), entity, rank, rank, 0, weeks or (1 if new else 2), new)


@pytest.fixture
def tables(spark):
    """A song chart whose phantom with the smaller id comes later, an album chart, links and artists."""
    entries = [
        entry(1, 1, "2020-01-11", 10, 1), entry(1, 1, "2020-01-11", 11, 2), entry(1, 2, "2020-01-18", 10, 1, True), entry(1, 2, "2020-01-18", 12, 3, True),
        entry(1, 3, "2020-01-04", 10, 1, True), entry(1, 3, "2020-01-04", 11, 2, True), entry(2, 10, "2020-02-01", 20, 1), entry(2, 10, "2020-02-01", 21, 2),
        entry(2, 11, "2020-02-08", 20, 1),
    ]
    e = spark.createDataFrame(entries, ENTRY)
    items = lambda rows: spark.createDataFrame(rows, "id long, title string, artist_credit string")
    links = lambda rows: spark.createDataFrame([(a, b, "primary") for a, b in rows], "entity_id long, artist_id long, role string")
    charts = [(1, "songs", "S", "song", "core", True, 1, 100), (2, "albums", "A", "album", "core", True, 2, 200)]
    return Tables(
        spark.createDataFrame(charts, CHART_COLUMNS), e.selectExpr("week_id as id", "chart_id", "chart_date").distinct(), e,
        items([(10, "Ten", "P"), (11, "Eleven", "Q"), (12, "Twelve", "P")]), items([(20, "Twenty", "P"), (21, "Twenty-one", "R")]),
        spark.createDataFrame([(100, "P", "male", None), (101, "Q", "unknown", None), (102, "R", None, None)], "id long, name string, gender string, gender_source string"),
        links([(10, 100), (11, 101), (12, 100)]), links([(20, 100), (21, 102)]),
    )


def test_phantom_with_the_smallest_id_stays(tables):
    judged = {r["week_id"]: (r["phantom"], r["valid"]) for r in judged_weeks(tables.entries).collect()}
    assert judged == {1: (False, True), 2: (True, True), 3: (True, False), 10: (False, True), 11: (True, True)}  # one entry: 0 >= 0
    assert valid_weeks(tables.entries, []).count() == 0


def test_item_and_artist_statistics(tables):
    song = {r["entity_id"]: r for r in stats.song_stats(tables).collect()}
    ten = song[10]
    assert (ten["total_weeks"], ten["peak_position"], ten["weeks_at_peak"], ten["weeks_at_number_one"]) == (2, 1, 2, 2)
    assert (str(ten["debut_date"]), str(ten["last_date"]), ten["debut_position"]) == ("2020-01-11", "2020-01-18", 1)
    assert song[11]["total_weeks"] == song[12]["total_weeks"] == 1
    album = {r["entity_id"]: (r["total_weeks"], r["peak_position"]) for r in stats.album_stats(tables).collect()}
    assert album == {20: (2, 1), 21: (1, 2)}
    artist = {r["artist_id"]: r for r in stats.artist_stats(tables).collect()}
    assert (artist[100]["song_total_weeks"], artist[100]["album_total_weeks"], artist[100]["song_number_ones"], artist[100]["album_number_ones"]) == (3, 2, 1, 1)
    assert artist[100]["song_max_simultaneous"] == 2 and artist[102]["song_total_weeks"] == 0
    assert stats.rollup_parity(tables).count() == 0


def test_records_and_their_limits(tables):
    assert [(r["rank"], r["id"], r["value"]) for r in records.longest_chart_runs(tables, "song").collect()] == [(1, 10, 2), (2, 11, 1), (3, 12, 1)]
    genders = records.gender_leaderboard(tables, 2, "album", "male").collect()
    assert [(r["name"], r["value"], r["total_artists"], r["matched_artists"], r["coverage"]) for r in genders] == [("P", 2, 2, 1, 0.5)]
    assert records.unsupported("simultaneous_entries", "album", "core")
    assert records.unsupported("longest_chart_runs", "song", "genre") and not records.unsupported("top10_weeks", "song", "genre")
    with pytest.raises(ValueError, match="artists"):
        records.preset(tables, "top10_weeks", {"id": 3, "entity_kind": "artist", "category": "artist"})
    with pytest.raises(ValueError, match="nowhere"):
        chart_named(tables, "nowhere")


CREDITS = {
    "Drake": [("Drake", "primary")],
    "Future & Drake": [("Future", "primary"), ("Drake", "primary")],
    "DJ K Featuring Drake, Lil W & Rick R": [("DJ K", "primary"), ("Drake", "featured"), ("Lil W", "featured"), ("Rick R", "featured")],
    "Post M With Doja": [("Post M", "primary"), ("Doja", "with")],
    "A With B Featuring C": [("A With B", "primary"), ("C", "featured")],
    "Bey X Shak": [("Bey", "primary"), ("Shak", "primary")],
    "Max and Alex": [("Max", "primary"), ("Alex", "primary")],
    "earth, wind & fire": [("Earth, Wind & Fire", "primary")],
    "Crosby, Stills, Nash & Young feat. Hall & Oates": [("Crosby, Stills, Nash & Young", "primary"), ("Hall & Oates", "featured")],
    "Ann & Simon & Garfunkel": [("Ann", "primary"), ("Simon & Garfunkel", "primary")],
    "Tyler, The Creator ft Ann": [("Tyler, The Creator", "primary"), ("Ann", "featured")],
    "A,, B": [("A", "primary"), ("B", "primary")],
    "  ": [],
    None: [],
}


def test_credits(spark):
    rows = spark.createDataFrame(list(enumerate(CREDITS)), "id int, artist_credit string")
    for known in (None, spark.createDataFrame([], "name string")):
        found = {i: [] for i in range(len(CREDITS))}
        for r in parse_credits(rows, "id", known).orderBy("id", "position").collect():
            found[r["id"]].append((r["name"], r["role"]))
        assert list(found.values()) == list(CREDITS.values())
    acts = spark.createDataFrame([("Future & Drake",), (None,)], "name string")
    assert [r["name"] for r in parse_credits(rows.where("id = 1"), "id", acts).collect()] == ["Future & Drake"]


def test_names(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    got = one.select(trigrams(F.lit("Cat")).alias("t"), similarity(trigrams(F.lit("cat")), trigrams(F.lit("cats"))).alias("s"), canonical_name(F.lit(" ke$HA ")).alias("c"), trigrams(F.lit("é")).alias("e")).first()
    assert set(got["t"]) == {"  c", " ca", "cat", "at "} and got["s"] == 0.5 and got["c"] == "Kesha" and got["e"] == ["  é", " é "]
    assert identity_group("janet") == ["Janet Jackson", "Janet"] and identity_group("Ann") == ["Ann"]


def test_reconciliation(spark, tables):
    artists = spark.createDataFrame([(1, "Earth"), (2, "Wind"), (3, "Fire"), (4, "Earth, Wind & Fire"), (5, "Solo")], "id long, name string")
    items = spark.createDataFrame([(1, "Earth, Wind & Fire"), (2, "Solo & New")], "id long, artist_credit string")
    links = spark.createDataFrame([(1, 1, "primary"), (1, 2, "primary"), (1, 3, "primary"), (2, 5, "primary")], "entity_id long, artist_id long, role string")
    changes = {(r["entity_id"], r["key"], r["change"]) for r in quality.link_changes(items, links, artists).collect()}
    assert changes == {(1, "earth, wind & fire", "add"), (1, "earth", "remove"), (1, "wind", "remove"), (1, "fire", "remove"), (2, "new", "add")}
    gone = {r["name"]: r["deletable"] for r in quality.orphans(artists, [(items, links)]).collect()}
    assert gone["Earth"] and gone["Wind"] and gone["Fire"] and "Solo" not in gone


def test_scratch_tables_go_and_kept_ones_stay(spark):
    from tidemark.sources.shared import exists, scratch, staged

    folder = lambda df: df.inputFiles()[0].rsplit("/", 1)[0]
    with scratch(spark):
        outer = staged(spark.range(3), "outer")
        with scratch(spark):
            inner, kept = staged(spark.range(4), "inner"), staged(spark.range(5), "kept", keep=True)
            paths = [folder(df) for df in (outer, inner, kept)]
        assert [exists(spark, p) for p in paths] == [True, False, True] and kept.count() == 5
        last = staged(spark.range(6), "last", keep=True)
    assert [exists(spark, p) for p in paths] == [False] * 3 and last.count() == 6
    with pytest.raises(ZeroDivisionError), scratch(spark):
        paths = [folder(staged(spark.range(2), "lost"))]
        _ = 1 / 0
    assert not exists(spark, paths[0]) and exists(spark, folder(staged(spark.range(2), "free")))
