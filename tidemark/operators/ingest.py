"""Loading parsed weeks into the relations: set operations in place of row-by-row upserts.

Surrogate ids continue from the largest one and follow a stated order, so that a repeated load changes
nothing.  Numbering needs one ordered pass over the new keys alone: their offsets come from counts by
range, never from one task that sorts all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.credits import parse_credits
from tidemark.operators.numbering import numbered
from tidemark.sources.versions import Version, Versions
from tidemark.sources.week_files import LEAST_BYTES


def _largest(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]


def upsert_weeks(weeks: DataFrame, dates: DataFrame) -> DataFrame:
    """``weeks`` (id, chart_id, chart_date) with those of ``dates`` (chart_id, chart_date) that it lacks."""
    new = dates.select("chart_id", "chart_date").distinct().join(weeks, ["chart_id", "chart_date"], "left_anti")
    added = numbered(new, ["chart_id", "chart_date"], _largest(weeks))
    return weeks.unionByName(added.select(F.col("id").cast(weeks.schema["id"].dataType).alias("id"), "chart_id", "chart_date"))


def upsert_items(items: DataFrame, parsed: DataFrame) -> DataFrame:
    """``items`` (id, title, artist_credit, image) with the parsed ones; a first parsed image replaces the stored one.

    ``parsed``: chart_date, position, title, artist, image.
    """
    order = F.struct("chart_date", "position")
    first = parsed.groupBy("title", F.col("artist").alias("artist_credit")).agg(F.min_by(F.struct("image"), order).alias("_f"), F.min(order).alias("_o"))
    both = first.join(items.withColumnRenamed("image", "_old"), ["title", "artist_credit"], "full")
    image = F.coalesce("_f.image", "_old").alias("image")
    known = both.where("id is not null").select("id", "title", "artist_credit", image)
    new = both.where("id is null").select("title", "artist_credit", image, F.col("_o.chart_date").alias("_d"), F.col("_o.position").alias("_p"))
    added = numbered(new, ["_d", "_p", "title", "artist_credit"], _largest(items))
    return known.unionByName(added.select(F.col("id").cast(items.schema["id"].dataType).alias("id"), "title", "artist_credit", "image"))


def upsert_artists(artists: DataFrame, names: DataFrame) -> DataFrame:
    """``artists`` (id, name) with the names that it lacks."""
    new = names.select("name").distinct().join(artists, "name", "left_anti")
    added = numbered(new, ["name"], _largest(artists))
    return artists.select("id", "name").unionByName(added.select(F.col("id").cast(artists.schema["id"].dataType).alias("id"), "name"))


def artist_links(items: DataFrame, artists: DataFrame) -> DataFrame:
    """(entity_id, artist_id, role) from the credits of items (id, artist_credit); an artist's first role counts."""
    parsed = parse_credits(items.select(F.col("id").alias("entity_id"), "artist_credit"), "entity_id")
    named = parsed.join(artists.select(F.col("id").alias("artist_id"), "name"), "name")
    return named.groupBy("entity_id", "artist_id").agg(F.min_by("role", "position").alias("role"))


def load_entries(entries: DataFrame, parsed: DataFrame) -> DataFrame:
    """``entries`` with the parsed ones; a rank that a week has already stays, and of equal ranks the first one counts.

    Both: week_id, rank and further columns; ``parsed`` has a position.
    """
    first = Window.partitionBy("week_id", "rank").orderBy("position")
    new = parsed.withColumn("_n", F.row_number().over(first)).where("_n = 1").join(entries.select("week_id", "rank"), ["week_id", "rank"], "left_anti")
    return entries.unionByName(new.select(entries.columns))


def new_weeks(files: DataFrame, weeks: DataFrame, latest: str) -> DataFrame:
    """Of dated files (chart_id, chart_date) those after a chart's last week and not after ``latest``; charts never loaded are skipped."""
    marks = weeks.groupBy("chart_id").agg(F.max("chart_date").alias("_mark"))
    return files.join(marks, "chart_id").where((F.col("chart_date") > F.col("_mark")) & (F.col("chart_date") <= F.lit(latest).cast("date"))).drop("_mark")


def register_charts(charts: DataFrame, curated: DataFrame) -> DataFrame:
    """``charts`` with the curated ones (slug, title, entity_kind, category) whose slug it lacks; new ones are active and come last."""
    new = curated.dropDuplicates(["slug"]).join(charts.select("slug"), "slug", "left_anti")
    last = charts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id"), F.coalesce(F.max("sort_order"), F.lit(0)).alias("at")).first()
    added = numbered(new.select("slug", "title", "entity_kind", "category"), ["slug"], last["id"])
    filled = added.withColumns({"is_active": F.lit(True), "sort_order": F.lit(last["at"])})
    kinds = {f.name: f.dataType for f in charts.schema}
    return charts.unionByName(filled.select(*[F.col(c).cast(kinds[c]).alias(c) if c in filled.columns else F.lit(None).cast(kinds[c]).alias(c) for c in charts.columns]))


def set_genders(artists: DataFrame, resolved: DataFrame) -> DataFrame:
    """``artists`` (id, gender, gender_source, …) with the genders of ``resolved`` (name, gender, source) in place of the unknown ones."""
    found = resolved.select(F.col("name").alias("_name"), F.col("gender").alias("_gender"), F.col("source").alias("_source")).dropDuplicates(["_name"])
    open_ = F.coalesce("gender", F.lit("unknown")) == "unknown"
    joined = artists.join(found, (F.col("name") == F.col("_name")) & open_, "left")
    return joined.withColumns({"gender": F.coalesce("_gender", "gender"), "gender_source": F.coalesce("_source", "gender_source")}).select(artists.columns)


def repaired_weeks(files: DataFrame, weeks: DataFrame, core: list[int], since_year: int, latest: str) -> DataFrame:
    """Of dated files (chart_id, chart_date, bytes) those that fill a gap: weeks of core charts that are not loaded, from a year on.

    Only whole files count; a week may be older than the chart's last one, which is why an older date can have a larger id.
    """
    whole = files.where(F.col("chart_id").isin(core) & (F.col("bytes") >= LEAST_BYTES))
    in_time = (F.year("chart_date") >= since_year) & (F.col("chart_date") <= F.lit(latest).cast("date"))
    return whole.where(in_time).join(weeks, ["chart_id", "chart_date"], "left_anti")


def load_and_rebuild(load: list[Callable[[], int]], rebuild: Callable[[], None]) -> int:
    """Runs all loads (each tells how many weeks it has added) and rebuilds what depends on them once, only if any was added."""
    added = sum(step() for step in load)
    if added:
        rebuild()
    return added


def publish(spark: SparkSession, tables: dict[str, DataFrame] | Callable[[Version], dict[str, DataFrame]], folder: str) -> int:
    """Writes all tables into a new version of a folder: readers see all of it or nothing.

    Versions are numbered in the order in which they are published.  Tables that follow from the version before are given as a
    function of it: if another writer publishes meanwhile, they are computed again from what that one has published.
    """
    versions = Versions(spark, folder)

    def build(base: Version) -> Version:
        built = base
        for name, df in (tables(base) if callable(tables) else tables).items():
            built = versions.written(built, name, df, F.lit("0"))
        return built

    return versions.publish(build).number


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the version that was published last."""
    return Versions(spark, folder).read(name)
