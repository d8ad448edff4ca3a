"""The chart model, and a projection of star-schema tables onto it.

A chart publishes ranked entries (songs, albums or artists) for a Saturday.  The projection ranks parts,
customers and suppliers by their weekly units, so every operator can run on any star-schema tables;
``FIXTURES.md`` has its definition.  The entries are stored once, as a loader would; all other relations
are lazy, and a query reads only the columns it needs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import saturday_on_or_after
from tidemark.sources.shared import exists, file_marks, shared_dir

#: id, slug, title, entity_kind, category, is_active, sort_order, depth: the registry of the projection.
CHARTS = [
    (1, "song-core", "Core Songs", "song", "core", True, 10, 40),
    (2, "album-core", "Core Albums", "album", "core", True, 20, 30),
    (3, "artist-core", "Core Artists", "artist", "artist", True, 30, 20),
    (4, "rock-songs", "Rock Songs", "song", "genre", True, 40, 20),
]
CHART_COLUMNS = "id int, slug string, title string, entity_kind string, category string, is_active boolean, sort_order int, depth int"
ENTRY_COLUMNS = "chart_id int, week_id int, chart_date date, entity_id long, rank int, peak_pos int, last_pos int, weeks_on_chart int, is_new boolean"
#: To be raised with every change to what is stored, so that no later session finds entries of another making.
LAYOUT = 2
CORE_SONGS, CORE_ALBUMS = 1, 2
#: Lines or orders that a task is meant to sum and rank.
TASK_ROWS = 1 << 20
GENDERS = ["female", "male", "group", "mixed", "unknown"]


@dataclass
class Tables:
    """The relations that every operator reads."""

    charts: DataFrame
    weeks: DataFrame  # id, chart_id, chart_date
    entries: DataFrame  # chart_id, week_id, chart_date, entity_id, rank, peak_pos, last_pos, weeks_on_chart, is_new
    songs: DataFrame  # id, title, artist_credit
    albums: DataFrame
    artists: DataFrame  # id, name, gender, gender_source
    song_artists: DataFrame  # entity_id, artist_id, role
    album_artists: DataFrame
    home: str | None = None  # the folder of what is kept of the titles of songs and albums
    placed_home: str | None = None  # and of entries and credits by item

    @cached_property
    def by_kind(self) -> dict[str, tuple[DataFrame, DataFrame | None]]:
        """The items of a kind and their links to artists."""
        people = self.artists.select("id", F.col("name").alias("title"), F.col("name").alias("artist_credit"))
        return {"song": (self.songs, self.song_artists), "album": (self.albums, self.album_artists), "artist": (people, None)}

    def views(self, prefix: str = "") -> None:
        """Registers the relations as temporary views."""
        for f in fields(self)[:-2]:
            getattr(self, f.name).createOrReplaceTempView(prefix + f.name)


def _week(day: str) -> Column:
    return saturday_on_or_after(F.col(day).cast("date")).alias("chart_date")


def _by_chart(rows: DataFrame, charts: dict[int, str], name: str) -> DataFrame:
    """A row (chart_id, …) for each chart whose column is neither null nor false; the column's value as ``name``."""
    kept = [c for c in rows.columns if c not in charts.values()]
    of_chart = F.explode(F.array(*[F.struct(F.lit(i).alias("chart_id"), F.col(c).alias(name)) for i, c in charts.items()])).alias("_c")
    out = rows.select(*kept, of_chart).select("_c.chart_id", *kept, f"_c.{name}")
    return out.where(name) if dict(out.dtypes)[name] == "boolean" else out.where(f"{name} is not null")


def _dealt(rows: DataFrame, counted: int, *by: str) -> DataFrame:
    """``rows`` dealt by columns to as many tasks as their number asks for: more rows make more tasks, not larger ones."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-counted // TASK_ROWS)), *by)


def weekly_units(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """(chart_id, chart_date, entity_id, units): a line counts for its part's chart, its supplier's and, if returned, the genre chart.

    Both song charts come out of one aggregate.  An item has few lines in a week, so sums within the reading tasks would hardly
    make fewer rows; the lines themselves are dealt by week and item, and a task holds the sums of about ``TASK_ROWS`` of them.
    """
    sold = lineitem.select(_week("l_shipdate"), (F.col("l_partkey") + 1).alias("song"), (F.col("l_suppkey") + 1).alias("artist"), F.col("l_quantity").cast("long").alias("n"), "l_returnflag")
    lines, ordered = lineitem.count(), orders.count()
    of_item = lambda rows, item, counted: _dealt(rows.where(f"{item} is not null").withColumnRenamed(item, "entity_id"), counted, "chart_date", "entity_id").groupBy("chart_date", "entity_id")
    songs = of_item(sold.drop("artist"), "song", lines).agg(F.sum("n").alias("core"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("n"))).alias("genre"))
    artists = of_item(sold.select("chart_date", "artist", "n"), "artist", lines).agg(F.sum("n").alias("units"))
    albums = of_item(orders.select(_week("o_orderdate"), (F.col("o_custkey") + 1).alias("album")), "album", ordered).agg(F.count("*").alias("units"))
    of_chart = lambda i, rows: rows.select(F.lit(i).alias("chart_id"), "chart_date", "entity_id", "units")
    return _by_chart(songs, {1: "core", 4: "genre"}, "units").unionByName(of_chart(2, albums)).unionByName(of_chart(3, artists))


def ranked_units(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """(chart_id, chart_date, entity_id, rank) within each chart's depth."""
    in_week = Window.partitionBy("chart_id", "chart_date").orderBy(F.desc("units"), "entity_id")
    depth = F.create_map(*[F.lit(x) for c in CHARTS for x in (c[0], c[7])])[F.col("chart_id")]
    # The constant bound lets each task drop what no chart lists before the shuffle; the chart's own depth follows.
    ranked = weekly_units(lineitem, orders).withColumn("rank", F.row_number().over(in_week)).where(F.col("rank") <= max(c[7] for c in CHARTS))
    return ranked.where(F.col("rank") <= depth).select("chart_id", "chart_date", "entity_id", "rank")


def calendar(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """(chart_id, chart_date) of every published week: the Saturdays of the rows that a chart counts.

    Each task reduces its rows to days before anything is shuffled; nothing is ranked for it.
    """
    part, counts = F.col("l_partkey").isNotNull(), F.col("l_quantity").isNotNull()
    of_day = lineitem.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(
        F.bool_or(part).alias("core"), F.bool_or(F.col("l_suppkey").isNotNull()).alias("artist"), F.bool_or(part & counts & (F.col("l_returnflag") == "R")).alias("genre")
    )
    ordered = orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.bool_or(F.col("o_custkey").isNotNull()).alias("album"))
    both = _by_chart(of_day, {1: "core", 3: "artist", 4: "genre"}, "published").unionByName(_by_chart(ordered, {2: "album"}, "published"))
    return both.select("chart_id", _week("day")).distinct()


def numbered_weeks(dates: DataFrame) -> DataFrame:
    """(week_id, chart_id, chart_date): numbering needs the calendar of a chart, never its entries."""
    number = F.row_number().over(Window.partitionBy("chart_id").orderBy("chart_date")) - 1
    return dates.select((F.col("chart_id") * 10000 + (number * 7919) % 10000).cast("int").alias("week_id"), "chart_id", "chart_date")


def history(ranked: DataFrame, weeks: DataFrame) -> DataFrame:
    """The entries with what each item has done so far, in numbered weeks (week_id, chart_id, chart_date)."""
    so_far = Window.partitionBy("chart_id", "entity_id").orderBy("chart_date")
    week_before = F.lag("chart_date").over(so_far)
    return (
        ranked.withColumn("weeks_on_chart", F.row_number().over(so_far))
        .withColumn("peak_pos", F.min("rank").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("last_pos", F.when(F.datediff("chart_date", week_before) == 7, F.lag("rank").over(so_far)).otherwise(0))
        .withColumn("is_new", F.col("weeks_on_chart") == 1)
        .join(F.broadcast(weeks), ["chart_id", "chart_date"])  # charts x weeks since the first: a calendar
        .select("chart_id", "week_id", "chart_date", "entity_id", "rank", "peak_pos", "last_pos", "weeks_on_chart", "is_new")
    )


def stored_path(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], name: str) -> str:
    """Where something made of a folder's tables is kept: another path for other files or another layout."""
    marks = repr((LAYOUT, CHARTS, ENTRY_COLUMNS, sf_dir, *(file_marks(spark, f"{sf_dir}/{t}.parquet") for t in tables)))
    return f"{shared_dir(spark)}/tidemark-{name}-{hashlib.sha256(marks.encode()).hexdigest()[:32]}"


def stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of a folder, written once to the shared folder: the fact table that a loader keeps.

    The table's name says which files it was made of, so later sessions find it again, and other contents get
    another table; one that has been cleaned away is written anew.
    """
    path = stored_path(spark, sf_dir, ("lineitem", "orders"), "entries")
    if not exists(spark, f"{path}/_SUCCESS"):
        lineitem, orders = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("lineitem", "orders"))
        entries = history(ranked_units(lineitem, orders), numbered_weeks(calendar(lineitem, orders)))
        entries.write.mode("overwrite").parquet(path)
    return spark.read.schema(ENTRY_COLUMNS).parquet(path)


def project(spark: SparkSession, sf_dir: str) -> Tables:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    charts = spark.createDataFrame(CHARTS, CHART_COLUMNS)
    entries = stored_entries(spark, sf_dir)
    weeks = entries.where("rank = 1").select(F.col("week_id").alias("id"), "chart_id", "chart_date")  # every week has a first one

    supplier, part, customer = read("supplier"), read("part"), read("customer")
    suppliers = F.broadcast(supplier.agg(F.count("*").alias("n")))  # one row
    gender = F.element_at(F.array(*map(F.lit, GENDERS)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    artists = supplier.select(
        (F.col("s_suppkey") + 1).alias("id"), F.col("s_name").alias("name"), gender.alias("gender"),
        F.when(gender != "unknown", F.when(F.col("s_suppkey") % 2 == 0, "catalogue").otherwise("manual")).alias("gender_source"),
    )
    first, second = F.col("p_partkey") % F.col("n") + 1, (F.col("p_partkey") * 7 + 3) % F.col("n") + 1
    entity = (F.col("p_partkey") + 1).alias("entity_id")
    credited = part.select("p_partkey").crossJoin(suppliers)
    song_artists = credited.select(entity, first.alias("artist_id"), F.lit("primary").alias("role")).unionByName(
        credited.where((F.col("p_partkey") % 3 == 0) & (first != second)).select(entity, second.alias("artist_id"), F.lit("featured").alias("role"))
    )
    album_artists = customer.select("c_custkey").crossJoin(suppliers).select(
        (F.col("c_custkey") + 1).alias("entity_id"), (F.col("c_custkey") % F.col("n") + 1).alias("artist_id"), F.lit("primary").alias("role")
    )
    songs = part.select(
        (F.col("p_partkey") + 1).alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"), F.col("p_brand").alias("artist_credit")
    )
    albums = customer.select((F.col("c_custkey") + 1).alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("artist_credit"))
    homes = stored_path(spark, sf_dir, ("part", "customer"), "titles"), stored_path(spark, sf_dir, ("lineitem", "orders", "part", "customer", "supplier"), "placed")
    return Tables(charts, weeks, entries, songs, albums, artists, song_artists, album_artists, *homes)
