"""Week files, loading and streaming."""

import datetime as dt
import json

import pytest

from tidemark.operators import ingest
from tidemark.sources.versions import Versions
from tidemark.sources import week_files
from tidemark.streaming import incremental

ROWS = [
    {"rank": 1, "title": " One ", "artist": "A", "peakPos": 1, "lastPos": 0, "weeks": 3, "isNew": False, "image": "http://x/i.jpg"},
    {"rank": "2", "album": "Two", "artist": "B", "peakPos": None, "lastPos": 5.7, "weeks": "x", "isNew": True, "image": "http://x/lazy-load.gif"},
    {"rank": "N/A", "title": "Bad rank", "artist": "C"},
    {"rank": 3, "title": "", "artist": "Only artist", "image": "data:abc"},
    {"rank": 4, "title": "No artist", "artist": ""},
]


@pytest.fixture
def folder(tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text)
    write("2022-08-06.json", json.dumps(ROWS))
    write("2022-08-20.json", "[]")
    write("2022-08-27.json", "[{" + "x" * 200)
    write("2022-09-03.json", '{"a": "' + "x" * 200 + '"}')
    write("notes.json", json.dumps(ROWS))
    write("2022-02-30.json", json.dumps(ROWS))
    write("2030-01-05.json", json.dumps(ROWS))
    write("other.txt", "no")
    return str(tmp_path)


def test_parse(spark, folder):
    files = week_files.with_dates(week_files.read_folder(spark, folder)).where("file_name = '2022-08-06.json'")
    rows = week_files.parse(files).orderBy("position").collect()
    assert [(r["rank"], r["title"], r["artist"], r["peak_pos"], r["last_pos"], r["weeks"], r["is_new"], r["image"]) for r in rows] == [
        (1, "One", "A", 1, 0, 3, False, "http://x/i.jpg"), (2, "Two", "B", None, 5, None, True, None),
    ]
    assert [r["artist"] for r in week_files.parse(files, "artist").orderBy("position").collect()] == ["A", "B", "Only artist"]


def test_audit(spark, folder):
    audited = week_files.audit(week_files.read_folder(spark, folder), "2022-09-10")
    assert {r["file_name"]: r["verdict"] for r in audited.collect()} == {
        "2022-08-06.json": "ok", "2022-08-20.json": "empty", "2022-08-27.json": "invalid json", "2022-09-03.json": "invalid payload",
        "notes.json": "bad name", "2022-02-30.json": "bad name", "2030-01-05.json": "future",
    }
    assert [str(r["chart_date"]) for r in week_files.missing_weeks(audited, "2022-09-10").collect()] == ["2022-08-13"]
    assert sorted(str(r["chart_date"]) for r in week_files.repair_dates(audited, "2022-09-10").collect()) == ["2022-08-13", "2022-08-20", "2022-08-27", "2022-09-03"]


def test_loading_twice_changes_nothing(spark, folder):
    files = week_files.with_dates(week_files.read_folder(spark, folder)).where("chart_date is not null")
    parsed = week_files.parse(files)
    items = spark.createDataFrame([(7, "One", "A", "old")], "id int, title string, artist_credit string, image string")
    once = ingest.upsert_items(items, parsed)
    assert sorted(map(tuple, once.collect())) == [(7, "One", "A", "http://x/i.jpg"), (8, "Two", "B", None)]
    assert sorted(map(tuple, ingest.upsert_items(once, parsed).collect())) == sorted(map(tuple, once.collect()))
    artists = ingest.upsert_artists(spark.createDataFrame([(3, "B")], "id int, name string"), parsed.selectExpr("artist as name"))
    assert sorted(map(tuple, artists.collect())) == [(3, "B"), (4, "A")]
    assert sorted(map(tuple, ingest.artist_links(once, artists).collect())) == [(7, 4, "primary"), (8, 3, "primary")]


def test_publishing_swaps_all_tables(spark, tmp_path):
    for n in (1, 2):
        ingest.publish(spark, {"a": spark.range(n), "b": spark.range(n + 10)}, str(tmp_path / "p"))
    assert ingest.published(spark, str(tmp_path / "p"), "a").count() == 2 and ingest.published(spark, str(tmp_path / "p"), "b").count() == 12


def test_a_version_counts_once_it_is_marked(spark, tmp_path):
    """A writer that stops half-way leaves readers where they were; numbers, not clocks, order the versions."""
    folder = str(tmp_path / "p")
    assert ingest.publish(spark, {"a": spark.range(3)}, folder) == 1
    (tmp_path / "p" / "log" / f"{2:012d}").touch()
    spark.range(9).write.parquet(f"{folder}/files/half/a")
    assert ingest.published(spark, folder, "a").count() == 3
    assert ingest.publish(spark, {"a": spark.range(5)}, folder) == 3 and ingest.published(spark, folder, "a").count() == 5


def test_a_slow_writer_is_not_lost(spark, tmp_path):
    """A builds on version 0 while B publishes: A's rows follow from B's, and both are there."""
    folder, seen = str(tmp_path / "p"), []

    def more(base):
        seen.append(base.number)
        if len(seen) == 1:
            ingest.publish(spark, {"a": spark.range(10)}, folder)
        old = Versions(spark, folder).read("a", base) if base.number else spark.range(0)
        return {"a": old.unionByName(spark.range(100, 103))}

    assert ingest.publish(spark, more, folder) == 2 and seen == [0, 1]
    assert ingest.published(spark, folder, "a").count() == 13
    files = Versions(spark, folder)
    files.clean(1)
    assert ingest.published(spark, folder, "a").count() == 13 and len(list((tmp_path / "p" / "files").iterdir())) == 1


def test_listing_and_failed_downloads(spark, folder):
    listed = week_files.list_chart_files(spark, folder).collect()
    assert [str(r["chart_date"]) for r in listed] == ["2022-08-06", "2022-08-20", "2022-08-27", "2022-09-03", "2030-01-05"]
    failed = {str(r["chart_date"]) for r in week_files.failed_downloads(spark, week_files.list_chart_files(spark, folder), 2022, 2022).collect()}
    assert len(failed) == 53 - 3 and "2022-08-20" in failed and "2022-08-06" not in failed
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        week_files.list_chart_files(spark, folder + "/nowhere").collect()


def test_rebuilt_once_and_only_after_a_load():
    done = []
    assert ingest.load_and_rebuild([lambda: 0, lambda: 0], lambda: done.append(1)) == 0 and not done
    assert ingest.load_and_rebuild([lambda: 2, lambda: 0, lambda: 1], lambda: done.append(1)) == 3 and done == [1]


def test_a_stream_of_files_loads_each_once(spark, folder, tmp_path):
    seen = []
    run = lambda: incremental.load_new(incremental.stream_folder(spark, folder), lambda rows, n: seen.extend(map(tuple, rows.select("chart_date", "rank").collect())), str(tmp_path / "c")).awaitTermination()
    run()
    assert sorted(seen) == sorted((dt.date.fromisoformat(d), r) for d in ("2022-08-06", "2030-01-05") for r in (1, 2))
    run()
    assert len(seen) == 4


def test_streamed_weeks_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = incremental.weekly_activity(stream).writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("weeks").collect())) == sorted(map(tuple, incremental.weekly_activity(events).collect()))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_million_new_items_get_gapless_ids(spark, adaptive):
    """Whatever the sizes of partitions, and without shared exchanges: each item once, ids 1 to n in order."""
    from pyspark.sql import functions as F

    keys = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.exchange.reuse": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        n = 1_000_000 if adaptive == "true" else 200_000
        parsed = spark.range(n).select(F.lit(dt.date(2020, 1, 4)).alias("chart_date"), F.col("id").alias("position"), F.concat(F.lit("t"), "id").alias("title"), F.lit("a").alias("artist"), F.lit(None).cast("string").alias("image"))
        empty = spark.createDataFrame([], "id long, title string, artist_credit string, image string")
        r = ingest.upsert_items(empty, parsed).agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id"), F.count_if(F.col("title") != F.concat(F.lit("t"), F.col("id") - 1))).first()
        assert tuple(r) == (n, n, 1, n, 0)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_casefolded_names(spark):
    from tidemark.functions.names import name_key
    from pyspark.sql import functions as F

    names = ["Straße", "STRASSE", "ΣΊΣΥΦΟΣ", "σίσυφος", " Ke$ha  B ", "ﬁn", "İ"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", name_key(F.col("n")).alias("k")).collect()
    assert [r["k"] for r in got] == [" ".join(n.split()).casefold() for n in names]
