"""Incremental loading: week files and chart entries as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.versions import Version, Versions
from tidemark.sources.week_files import parse, with_dates


def stream_folder(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """The week files of a folder as they come."""
    files = (
        spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", files_a_batch).text(folder)
    )
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("text"))


def load_new(files: DataFrame, load: Callable[[DataFrame, int], None], checkpoint: str, entity_kind: str | None = None) -> StreamingQuery:
    """Parses all files that have come since the last run and hands them to ``load`` batch by batch; late weeks too."""

    def batch(rows: DataFrame, number: int) -> None:
        load(parse(with_dates(rows).where("chart_date is not null"), entity_kind), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_activity(events: DataFrame, late: str = "7 days") -> DataFrame:
    """(week, event_type, n, total) of a stream or table of events (ts, event_type, value), by the week that ends on a Saturday.

    As a stream, a week is closed when events are ``late`` later than its end.
    """
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    week = F.window("ts", "7 days", "7 days", "3 days")  # from 1970-01-04, a Sunday
    sums = marked.groupBy(week.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return sums.select(F.date_sub(F.col("w.end").cast("date"), 1).alias("week"), "event_type", "n", "total")


# -- high-water marks ---------------------------------------------------------------------------


def beyond_marks(weeks: DataFrame, by: str = "chart_id", on: str = "chart_date") -> DataFrame:
    """Of a stream of dated rows those after the newest date that earlier batches had of their chart.

    A chart's mark is keyed state, so a restarted stream goes on from it.  Rows without a key or a date are left out.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else ""
        newest = mark
        for part in parts:
            days = part[on].astype(str)  # ISO dates stand in order of time
            newest = max(newest, days.max())
            yield part[days > mark]
        state.update((newest,))

    known = weeks.where(F.col(by).isNotNull() & F.col(on).isNotNull())
    return known.groupBy(by).applyInPandasWithState(run, known.schema, "mark string", "append", GroupStateTimeout.NoTimeout)


def publish_batches(rows: DataFrame, folder: str, table: str, part: Callable[[], Column], checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Appends each batch of a stream to a versioned table, once: a version says which batch it was the last to take.

    A batch that is handed over again, because its sink was done but its checkpoint was not, publishes nothing.
    ``after`` is called behind each published batch.
    """
    versions = Versions(rows.sparkSession, folder)

    def take(batch: DataFrame, number: int) -> None:
        def build(base: Version) -> Version:
            if int(base.notes.get(table, -1)) >= number:
                return base
            built = versions.written(base, table, batch, F.concat_ws(".", part(), F.lit(str(number))), [])
            built.notes[table] = str(number)
            return built

        versions.publish(build)
        if after:
            after(number)

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- runs as sessions ---------------------------------------------------------------------------

#: Days at which an item's run goes on over a gap, and by which a week may be late.
GAP_DAYS, LATE = 14, "56 days"


def run_sessions(entries: DataFrame, gap_days: int = GAP_DAYS, late: str = LATE) -> DataFrame:
    """(chart_id, entity_id, first_date, last_date, weeks, best) of the runs in a stream or table of entries.

    A run is a session: it goes on until more than ``gap_days`` pass without an entry, and a late week within the gaps of two
    runs makes them one.  As a stream, a run is given out when the watermark has passed its end.
    """
    timed = entries.withColumn("ts", F.col("chart_date").cast("timestamp"))
    marked = timed.withWatermark("ts", late) if entries.isStreaming else timed
    # A session ends before its gap does; dates are whole days, so a second more lets a gap of exactly so many days go on.
    session = F.session_window("ts", f"{gap_days} days 1 second")
    runs = marked.groupBy(session.alias("s"), "chart_id", "entity_id").agg(
        F.min("chart_date").alias("first_date"), F.max("chart_date").alias("last_date"), F.count("*").alias("weeks"), F.min("rank").alias("best")
    )
    return runs.drop("s")


def numbered_runs(runs: DataFrame) -> DataFrame:
    """With ``run``: an item's runs from 0 in order of time."""
    return runs.withColumn("run", F.row_number().over(Window.partitionBy("chart_id", "entity_id").orderBy("first_date")) - 1)
