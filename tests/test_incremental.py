"""Loads in any order against a rebuild from all weeks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import incremental, stats
from tidemark.operators.incremental import ChartStore
from tidemark.operators.valid_weeks import valid_weeks
from tidemark.sources.projection import history
from tidemark.sources.shared import fresh_path
from tidemark.sources.versions import Version, Versions

FIRST = dt.date(2001, 1, 6)
PLACED = "chart_id int, week_id int, chart_date date, entity_id long, rank int"


def rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def placements(spark, seed, weeks=14, charts=(1, 2), churn=0.5):
    """Charts of four places; with much churn many weeks are all new, so phantoms come and go."""
    rng, out = random.Random(seed), []
    for chart in charts:
        numbers = rng.sample(range(1, 1000), weeks)
        for w in range(weeks):
            if rng.random() < 0.15:
                continue
            pool = range(1, 7) if rng.random() > churn else range(7, 60)
            out += [(chart, chart * 1000 + numbers[w], FIRST + dt.timedelta(7 * w), e, r + 1) for r, e in enumerate(rng.sample(pool, 4))]
    return spark.createDataFrame(out, PLACED)


def links(spark):
    return spark.createDataFrame([(c, e, a) for c in (1, 2) for e in range(1, 60) if e % 9 for a in {e % 5, e % 3}], "chart_id int, entity_id long, artist_id long")


def rebuilt(all_rows, link_rows):
    weeks = all_rows.select("week_id", "chart_id", "chart_date").distinct()
    entries = history(all_rows.drop("week_id"), weeks)
    counted = entries.join(valid_weeks(entries), ["chart_id", "week_id"], "left_semi")
    linked = counted.join(link_rows, ["chart_id", "entity_id"])
    by_item = linked.groupBy("artist_id", "chart_id", "entity_id").agg(F.count("*").alias("n"), F.min("rank").alias("best"), F.min("chart_date").alias("first"), F.max("chart_date").alias("last"))
    weekly = linked.groupBy("artist_id", "chart_id", "week_id").agg(F.count("*").alias("n")).groupBy("artist_id", "chart_id").agg(F.max("n").cast("int").alias("max_simultaneous"))
    return entries, stats.item_stats(counted, ["chart_id", "entity_id"]), stats.chart_totals(by_item).join(weekly, ["artist_id", "chart_id"])


def test_loads_in_any_order_equal_a_rebuild(spark):
    given, whose = placements(spark, 2, churn=0.6), links(spark)
    store = ChartStore(spark, fresh_path(spark, "store"), whose)
    batch = F.pmod(F.xxhash64("week_id"), F.lit(2))
    for n in range(2):
        store.load(given.where(batch == n))
        for found, wanted in zip((store.entries(), store.item_stats(), store.artist_chart_stats()), rebuilt(given.where(batch <= n), whose), strict=True):
            assert rows(found) == rows(wanted)
    assert store.versions.latest().number == 2 and store.load(given).number == 2  # nothing is new


def test_weeks_that_stop_counting_leave_the_statistics(spark):
    """An all new week of a smaller id takes the place of the first real week, whose items lose it."""
    week = lambda number, day, entities: [(1, number, FIRST + dt.timedelta(7 * day), e, r + 1) for r, e in enumerate(entities)]
    first = spark.createDataFrame(week(50, 0, [1, 2, 3, 4]) + week(60, 1, [2, 1, 3, 4]), PLACED)
    late = spark.createDataFrame(week(20, 5, [11, 12, 13, 14]), PLACED)
    store, whose = ChartStore(spark, fresh_path(spark, "store"), links(spark)), links(spark)
    before = store.entries(store.load(first))
    after = store.entries(store.load(late))
    assert {r["sign"]: r["n"] for r in incremental.signed_placements(before, after).groupBy("sign").agg(F.count("*").alias("n")).collect()} == {1: 4, -1: 4}
    for found, wanted in zip((after, store.item_stats(), store.artist_chart_stats()), rebuilt(first.unionByName(late), whose), strict=True):
        assert rows(found) == rows(wanted)


def test_only_hit_parts_are_written(spark):
    given, whose = placements(spark, 5, weeks=120, charts=(1,), churn=0), links(spark)
    store = ChartStore(spark, fresh_path(spark, "store"), whose)
    late = F.col("chart_date") == given.agg(F.max("chart_date")).first()[0]  # four of the six items
    first = store.load(given.where(~late))
    second = store.load(given.where(late))
    kept = {p for p, folder in second.tables["entries"].items() if first.tables["entries"].get(p) == folder}
    assert kept == {"1-2001", "1-2002"} and set(second.tables["entries"]) == kept | {"1-2003"}
    same = [first.tables["item_ranks"].get(p) == f for p, f in second.tables["item_ranks"].items()]
    assert any(same) and not all(same)


def test_late_weeks_join_on_affected_items(spark):
    given = placements(spark, 6)
    entries = history(given.drop("week_id"), given.select("week_id", "chart_id", "chart_date").distinct())
    one = given.where("chart_id = 1 and rank = 1").limit(1)
    cut = entries.join(one.select("chart_id", "chart_date"), ["chart_id", "chart_date"], "left_anti")
    changed = incremental.rederived(cut, one).select("entity_id").distinct().collect()
    assert [r[0] for r in changed] == [one.first()["entity_id"]]


# -- versions ---------------------------------------------------------------------------------


def _add(spark, versions, base, value):
    old = [] if "t" not in base.schemas else [r["x"] for r in versions.read("t", base).collect()]
    return versions.written(base, "t", spark.createDataFrame([(v,) for v in [*old, value]], "x int"), F.lit("0"))


def test_interleaved_writers_lose_nothing(spark):
    """Another writer publishes while this one builds: it builds again, and both changes stand."""
    versions, built = Versions(spark, fresh_path(spark, "log")), []

    def slow(base):
        built.append(base.number)
        out = _add(spark, versions, base, 1)
        if len(built) == 1:
            Versions(spark, versions.folder).publish(lambda b: _add(spark, versions, b, 2))
        return out

    assert versions.publish(slow).number == 2 and built == [0, 1]
    assert sorted(r["x"] for r in versions.read("t").collect()) == [1, 2]


def test_lost_and_late_writers(spark, monkeypatch):
    """An entry that was never written is passed over, and its writer notices when it comes back."""
    monkeypatch.setattr("tidemark.sources.versions.LOOKS", 2)
    versions = Versions(spark, fresh_path(spark, "log"))
    versions.publish(lambda b: _add(spark, versions, b, 1))
    versions._fs.createNewFile(versions._path(f"{versions.folder}/log/{2:012d}"))
    assert versions.latest().number == 1
    assert versions.publish(lambda b: _add(spark, versions, b, 3)).number == 3 and versions.latest().base == 1

    late, create = [], versions._create

    def slow_create(version):
        """Creates its entry, is taken for lost, and writes it after another writer's."""
        if late:
            return create(version)
        late.append(version.number)
        path = versions._path(f"{versions.folder}/log/{version.number:012d}")
        versions._fs.createNewFile(path)
        Versions(spark, versions.folder).publish(lambda b: _add(spark, versions, b, 5))
        versions._fs.delete(path, False)
        return create(version)

    versions._create = slow_create
    assert versions.publish(lambda b: _add(spark, versions, b, 4)).number == 6 and late == [4]
    assert sorted(r["x"] for r in versions.read("t").collect()) == [1, 3, 4, 5]


def test_building_nothing_publishes_nothing(spark):
    versions = Versions(spark, fresh_path(spark, "log"))
    assert versions.publish(lambda b: b) == Version() and versions.latest().number == 0
    with pytest.raises(ValueError):
        versions.read("t")
