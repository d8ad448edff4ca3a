"""Week files: a folder for each chart, a JSON array of entries for each week, named YYYY-MM-DD.json."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import saturday_on_or_after, saturdays, valid_iso_date
from tidemark.functions.names import stripped

#: All fields are read as text: files mix numbers, texts and nulls.
ENTRY = "array<struct<rank:string, title:string, album:string, artist:string, peakPos:string, lastPos:string, weeks:string, isNew:string, image:string>>"
#: Fixed value: smaller files hold no chart.
LEAST_BYTES = 100


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, bytes, text) of the JSON files of a folder."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("text"))


def list_chart_files(spark: SparkSession, folder: str) -> DataFrame:
    """(chart_date, path, bytes) of the week files of a folder, by date; an error if there is no such folder.  No file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", F.col("length").alias("bytes"))
    dated = with_dates(files.withColumn("file_name", F.regexp_extract("path", r"([^/]*)$", 1)))
    return dated.where("chart_date is not null").select("chart_date", "path", "bytes").orderBy("chart_date", "path")


def verified_charts(spark: SparkSession, path: str) -> DataFrame:
    """(slug, first_date) of the charts that a sidecar file names: a JSON array; an error if there is no such file."""
    rows = spark.read.schema("slug string, first_date string").option("multiLine", True).json(path)
    return rows.select("slug", F.try_to_date("first_date").alias("first_date")).where("slug is not null")


def write_week_files(entries: DataFrame, folder: str, by: tuple[str, ...] = ()) -> None:
    """Writes entries (by, chart_date and the fields of a file) as one JSON array for each week, into a folder for each date (of each ``by``).

    A week has at most a chart's depth of entries; weeks are dealt out by their date.
    """
    keys = [*by, "chart_date"]
    fields = F.struct(*[F.col(c) for c in entries.columns if c not in keys])
    weeks = entries.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(fields))).alias("text"))
    weeks.repartition(*keys).write.partitionBy(*keys).option("lineSep", "\n").text(folder)


def read_week_folders(spark: SparkSession, folder: str, by: str = "") -> DataFrame:
    """(by, file_name, bytes, text) of what ``write_week_files`` has written: a file name for each date.  ``by`` names its columns and types."""
    files = spark.read.schema(f"text string, {by + ', ' if by else ''}chart_date date").text(folder)
    return files.select(*[c.split()[0] for c in by.split(", ") if c], _file_name(), F.octet_length("text").cast("long").alias("bytes"), "text")


def list_week_folders(spark: SparkSession, folder: str) -> DataFrame:
    """(by, chart_date, path, bytes) of the same files; none is opened."""
    files = spark.read.format("binaryFile").load(folder)
    by = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content", "chart_date")]
    found = files.where("length > 0").select(*by, F.col("chart_date").cast("date").alias("chart_date"), "path", (F.col("length") - 1).alias("bytes"))  # but the line's end
    return with_dates(found.withColumn("file_name", _file_name())).drop("file_name")


def _file_name() -> Column:
    return F.concat(F.col("chart_date").cast("string"), F.lit(".json")).alias("file_name")


def with_dates(files: DataFrame) -> DataFrame:
    """With ``chart_date``, null for a name that is not a date."""
    stem = F.regexp_extract("file_name", r"^(.*)\.json$", 1)
    return files.withColumn("chart_date", F.when(valid_iso_date(stem), F.try_to_date(stem)))


def tolerant_int(text: Column) -> Column:
    """A whole number, the whole part of a decimal one, null for anything else."""
    return F.when(text.rlike(r"^\s*[+-]?\d{1,9}(\.\d+)?\s*$"), F.trim(text).cast("double").cast("int"))


def clean_image(url: Column) -> Column:
    """A trimmed address; null for blanks, inline data and placeholders."""
    url = stripped(url)
    return F.when((url != "") & ~F.lower(url).contains("lazy-load") & ~url.startswith("data:"), url)


def parse(files: DataFrame, entity_kind: str | None = None) -> DataFrame:
    """(file columns but the text, position, rank, title, artist, …) of all valid entries, in the order of the file.

    An entry needs a rank above zero, an artist and, but on charts of artists, a title.
    """
    kept = [c for c in files.columns if c != "text"]
    items = files.select(*kept, F.posexplode(F.from_json("text", ENTRY)).alias("position", "e"))
    text = lambda c: F.coalesce(stripped(c), F.lit(""))
    entries = items.select(
        *kept, "position", F.coalesce(tolerant_int(F.col("e.rank")), F.lit(0)).alias("rank"),
        text(F.coalesce(F.nullif(F.col("e.title"), F.lit("")), F.col("e.album"))).alias("title"), text(F.col("e.artist")).alias("artist"),
        tolerant_int(F.col("e.peakPos")).alias("peak_pos"), tolerant_int(F.col("e.lastPos")).alias("last_pos"), tolerant_int(F.col("e.weeks")).alias("weeks"),
        (~F.coalesce("e.isNew", F.lit("")).isin("", "false", "0")).alias("is_new"), clean_image(F.col("e.image")).alias("image"),
    )
    return entries.where((F.col("rank") > 0) & (F.col("artist") != "") & ((F.col("title") != "") | F.lit(entity_kind == "artist")))


def audit(files: DataFrame, latest: str, entity_kind: str | None = None) -> DataFrame:
    """(file_name, chart_date, verdict): ok, bad name, future, empty, invalid json or invalid payload."""
    dated = with_dates(files)
    valid = parse(dated.select("file_name", "text"), entity_kind).select("file_name").distinct().withColumn("_parsed", F.lit(True))
    verdict = (
        F.when(F.col("chart_date").isNull(), "bad name").when(F.col("chart_date") > F.lit(latest).cast("date"), "future")
        .when(F.col("bytes") < LEAST_BYTES, "empty").when(F.try_parse_json("text").isNull(), "invalid json")
        .when(F.coalesce(F.json_array_length("text"), F.lit(0)) == 0, "invalid payload").when(F.col("_parsed").isNull(), "invalid payload").otherwise("ok")
    )
    return dated.join(valid, "file_name", "left").select("file_name", "chart_date", verdict.alias("verdict"))


def missing_weeks(audited: DataFrame, latest: str) -> DataFrame:
    """(chart_date): Saturdays between the first and the last file (not after ``latest``) that have none."""
    present = audited.where(~F.col("verdict").isin("bad name", "future")).select("chart_date")
    ends = present.agg(F.min("chart_date").alias("a"), F.least(F.max("chart_date"), F.lit(latest).cast("date")).alias("b"))
    days = ends.select(saturday_on_or_after(F.col("a")).alias("a"), "b").where("a <= b")
    return days.select(F.explode(F.sequence("a", "b", F.expr("interval 7 day"))).alias("chart_date")).join(present, "chart_date", "left_anti")


def repair_dates(audited: DataFrame, latest: str) -> DataFrame:
    """(chart_date): weeks to fetch again: missing ones and those of broken files."""
    broken = audited.where(F.col("verdict").isin("empty", "invalid json", "invalid payload")).select("chart_date")
    return missing_weeks(audited, latest).unionByName(broken).distinct()


def skipped_files(audited: DataFrame) -> DataFrame:
    """(file_name): files that can't be fetched again, as their name is no date."""
    return audited.where("verdict = 'bad name'").select("file_name")


def failed_downloads(spark: SparkSession, files: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """(chart_date): Saturdays of the years whose file (chart_date, bytes) is absent or too small to hold a chart."""
    calendar = saturdays(spark, f"{first_year}-01-01", f"{last_year}-12-31")
    whole = files.where(F.col("bytes") >= LEAST_BYTES).select("chart_date")
    return calendar.join(whole, "chart_date", "left_anti")


def debut_walk(outcomes: DataFrame, last: str, floor: str, tolerance: int, by: str = "chart_id") -> DataFrame:
    """(by, earliest, saved, skipped, failed, reason): a walk back from ``last`` week by week, for each chart.

    ``outcomes``: by, chart_date, outcome (saved, skipped, failed or empty; a week without a row is empty).  The walk ends
    at the first run of ``tolerance`` empty weeks (reason debut) or at ``floor`` (reason floor).  It is a cumulative
    count over a chart's calendar: an empty week's run is its distance from the last week that was not empty.
    """
    spark, back = outcomes.sparkSession, Window.partitionBy(by).orderBy(F.desc("chart_date"))
    weeks = saturdays(spark, floor, last).crossJoin(F.broadcast(outcomes.select(by).distinct()))  # a registry of charts
    walked = weeks.join(outcomes, [by, "chart_date"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("empty")))
    walked = walked.withColumn("_n", F.row_number().over(back))
    last_full = F.coalesce(F.max(F.when(F.col("outcome") != "empty", F.col("_n"))).over(back), F.lit(0))
    walked = walked.withColumn("_ends", F.col("_n") - last_full >= tolerance)
    ended = F.max("_ends").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = walked.withColumn("_ended", ended).where("not _ended or _ends")
    count = lambda name: F.count_if((F.col("outcome") == name) & ~F.col("_ended")).cast("int").alias(name)
    kept = F.col("outcome").isin("saved", "skipped") & ~F.col("_ended")
    return seen.groupBy(by).agg(
        F.min(F.when(kept, F.col("chart_date"))).alias("earliest"), count("saved"), count("skipped"), count("failed"),
        F.when(F.bool_or("_ends"), "debut").otherwise("floor").alias("reason"),
    )
