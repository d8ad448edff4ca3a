"""Entries and credits in buckets by item: the same statistics, without an exchange of entries."""

import os
import re
from dataclasses import replace

import pytest

from tidemark.operators.stats import artist_chart_stats, credits, item_stats
from tidemark.operators.valid_weeks import valid_entries
from tidemark.sources import by_entity as placed
from tidemark.sources.by_entity import KEYS, bucket_count, by_entity
from tidemark.sources.projection import project
from tidemark.sources.shared import fresh_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return project(spark, SF)


@pytest.fixture
def no_broadcast_by_size(spark):
    """At 100 TB no side of entries or credits is small; only hints broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def rows(df):
    return sorted(map(str, (sorted(r.asDict().items()) for r in df.collect())))


def exchanged(df):
    """The columns of each hash exchange of the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [set(re.findall(r"(\w+)#", keys)) for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]


def test_bucket_count():
    assert [bucket_count(n) for n in (0, 1, placed.BUCKET_ROWS * 8, placed.BUCKET_ROWS * 8 + 1, placed.BUCKET_ROWS * 1000)] == [8, 8, 8, 16, 1024]


def test_same_rows_without_an_exchange_by_item(spark, tables, no_broadcast_by_size):
    t, credited = by_entity(tables, credits(tables), fresh_path(spark, "placed"))
    found = artist_chart_stats(t, credited=credited)
    assert all("entity_id" not in keys for keys in exchanged(found))
    assert any("entity_id" in keys for keys in exchanged(artist_chart_stats(tables)))  # as it is without the buckets
    assert rows(found) == rows(artist_chart_stats(tables))
    items = item_stats(valid_entries(t), KEYS)
    assert all("entity_id" not in keys for keys in exchanged(items))
    assert rows(items) == rows(item_stats(valid_entries(tables), KEYS))
    assert rows(artist_chart_stats(t, "primary", credited=credited)) == rows(artist_chart_stats(tables, "primary"))


def test_written_once_and_again_if_cut_short(spark, tables):
    home = fresh_path(spark, "placed")
    t, credited = by_entity(tables, credits(tables), home)
    files = sorted(t.entries.inputFiles())
    again, _ = by_entity(tables, credits(tables), home)
    assert sorted(again.entries.inputFiles()) == files
    folder = home.removeprefix("file://")
    (n,) = os.listdir(folder)
    os.remove(f"{folder}/{n}/credits/_SUCCESS")
    t, credited = by_entity(tables, credits(tables), home)
    assert not set(t.entries.inputFiles()) & set(files)
    assert t.entries.count() == tables.entries.count() and credited.count() == credits(tables).count()


def test_found_by_another_session(spark, tables):
    home = fresh_path(spark, "placed")
    t, credited = by_entity(tables, credits(tables), home)
    wanted = rows(artist_chart_stats(t, credited=credited))
    for name in [r.name for r in spark.catalog.listTables() if r.name.startswith("tidemark_")]:
        spark.sql(f"DROP TABLE {name}")  # external: only the catalog forgets it, as a new session has never known it
    t, credited = by_entity(tables, credits(tables), home)
    assert rows(artist_chart_stats(t, credited=credited)) == wanted


def test_nulls_repeated_rows_and_empty_tables(spark, tables):
    one = tables.entries.limit(1)
    odd = tables.entries.unionByName(one).unionByName(one.selectExpr("chart_id", "week_id", "chart_date", "CAST(NULL AS LONG) AS entity_id", "rank", "peak_pos", "last_pos", "weeks_on_chart", "is_new"))
    own = replace(tables, entries=odd)
    t, credited = by_entity(own, credits(own), fresh_path(spark, "placed"))
    assert t.entries.count() == tables.entries.count() + 2 and t.entries.where("entity_id is null").count() == 1
    empty = replace(tables, entries=tables.entries.where("false"))
    t, credited = by_entity(empty, credits(empty), fresh_path(spark, "placed"))
    assert t.entries.count() == 0 and artist_chart_stats(t, credited=credited).collect() == []
