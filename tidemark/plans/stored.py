"""Registered queries that load, publish, stream and ask in bulk, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import charts, ingest
from tidemark.operators.asof import as_of
from tidemark.operators.incremental import PLACED, ChartStore
from tidemark.operators.requests import requested_records
from tidemark.operators.stats import artist_chart_stats, credits, item_stats
from tidemark.operators.valid_weeks import valid_entries
from tidemark.plans.oracle import sql
from tidemark.sources import week_files
from tidemark.sources.by_entity import KEYS, by_entity
from tidemark.sources.projection import Tables
from tidemark.sources.shared import fresh_path
from tidemark.sources.versions import Version, Versions
from tidemark.streaming.incremental import beyond_marks, numbered_runs, publish_batches, run_sessions

QUERIES, ORACLES = {}, {}


def _add(name: str, over, oracle: str) -> None:
    QUERIES[name], ORACLES[name] = over, oracle


def _spark(t: Tables):
    return t.charts.sparkSession


# -- loads in any order -------------------------------------------------------------------------


_STORES: dict[tuple, ChartStore] = {}


def _loaded(t: Tables) -> ChartStore:
    """The store of these entries; loaded when a session asks for it first."""
    key = _spark(t).sparkContext.applicationId, *t.entries.inputFiles()[:1]
    if key not in _STORES:
        _STORES[key] = _load(t)
    return _STORES[key]


def _load(t: Tables) -> ChartStore:
    """A store that gets the weeks in three loads: most of the early ones, then the later ones, then those left out."""
    store = ChartStore(_spark(t), fresh_path(_spark(t), "charts"), credits(t))
    placed = t.entries.select(*PLACED)
    late = F.pmod("week_id", F.lit(11)) == 3
    for weeks in (~late & (F.col("chart_date") < "1998-07-01"), ~late & (F.col("chart_date") >= "1998-07-01"), late):
        store.load(placed.where(weeks))
    store.load(placed)  # all of them again: nothing is new
    return store


_add("entries_by_loads", lambda t: _loaded(t).entries(), sql("SELECT * FROM chart_entries"))
_add("item_stats_by_loads", lambda t: _loaded(t).item_stats(), sql("SELECT * FROM item_stats"))
_add("artist_chart_stats_by_loads", lambda t: _loaded(t).artist_chart_stats(), sql("SELECT * FROM artist_chart_stats"))


# -- buckets by item ------------------------------------------------------------------------------


def _artists_by_entity(t: Tables) -> DataFrame:
    """Entries and credits meet bucket by bucket; what is exchanged is summed by artist already."""
    placed, credited = by_entity(t, credits(t), t.placed_home)
    return artist_chart_stats(placed, credited=credited)


def _items_by_entity(t: Tables) -> DataFrame:
    """The careers of all charts' items, without an exchange of entries."""
    placed, _ = by_entity(t, credits(t), t.placed_home)
    return item_stats(valid_entries(placed), KEYS)


_add("artist_chart_stats_by_entity", _artists_by_entity, sql("SELECT * FROM artist_chart_stats"))
_add("item_stats_by_entity", _items_by_entity, sql("SELECT * FROM item_stats"))


def _published(t: Tables) -> DataFrame:
    """Two writers who number songs: the second publishes while the first builds, which builds again on the other's rows."""
    folder, started = fresh_path(_spark(t), "published"), []
    versions = Versions(_spark(t), folder)
    ingest.publish(_spark(t), {"songs": t.songs.where("id % 3 = 0").select("id", "title")}, folder)

    def more(rest: int):
        def build(base: Version) -> dict[str, DataFrame]:
            if rest == 1 and not started:
                started.append(1)
                ingest.publish(_spark(t), more(2), folder)
            return {"songs": versions.read("songs", base).unionByName(t.songs.where(f"id % 3 = {rest}").select("id", "title"))}

        return build

    ingest.publish(_spark(t), more(1), folder)
    return ingest.published(_spark(t), folder, "songs")


_add("published_songs", _published, sql("SELECT id, title FROM songs"))


def _load_and_rebuild(t: Tables) -> DataFrame:
    """Each chart's weeks loaded by its own step; the list of newest weeks is rebuilt once, as some were added."""
    loaded, rebuilt = [t.weeks.where("chart_date < '1997-01-01'")], []

    def step(chart_id: int):
        def load() -> int:
            new = t.weeks.where((F.col("chart_id") == chart_id) & (F.col("chart_date") >= "1997-01-01"))
            loaded.append(new)
            return new.count()

        return load

    def rebuild() -> None:
        weeks = loaded[0]
        for more in loaded[1:]:
            weeks = weeks.unionByName(more)
        rebuilt.append(weeks.groupBy("chart_id").agg(F.count("*").alias("weeks"), F.max("chart_date").alias("newest")))

    ingest.load_and_rebuild([step(r["id"]) for r in t.charts.select("id").collect()], rebuild)  # the registry
    (found,) = rebuilt
    return found


_add("load_and_rebuild", _load_and_rebuild, sql("SELECT chart_id, COUNT(*) AS weeks, MAX(chart_date) AS newest FROM chart_weeks GROUP BY 1"))


def _listed_files(t: Tables) -> DataFrame:
    """The week files of all charts, a file for each week, listed by chart, date and size."""
    folder = fresh_path(_spark(t), "listed")
    week_files.write_week_files(t.entries.select("chart_id", "chart_date", "rank", "entity_id"), folder, ("chart_id",))
    return week_files.list_week_folders(_spark(t), folder).select("chart_id", "chart_date", "bytes")


_add(
    "list_chart_files", _listed_files,
    sql("""SELECT chart_id, chart_date, 1 + SUM(length('{"rank":' || rank || ',"entity_id":' || entity_id || '}') + 1) AS bytes FROM chart_entries GROUP BY chart_id, chart_date"""),
)

# -- many questions at once ---------------------------------------------------------------------


def _requests(t: Tables) -> DataFrame:
    """A request for each of the artists and, for each hundredth song, one more: what is asked follows from the id."""
    asked = t.artists.select(F.col("id").alias("request_id")).unionByName(t.songs.where("id % 100 = 0").select((F.col("id") + 1_000_000_000).alias("request_id")))
    n = F.col("request_id")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    return asked.select(
        "request_id", pick(1, 2, 4).alias("chart_id"), pick("total-weeks", "weeks-at-number-one", "weeks-at-position", "weeks-in-top-n", "nothing known").alias("rank_by"),
        pick(2, 3, 5, 10, 20, 1, 7).alias("position"), F.when(n % 3 > 0, 1995 + n % 4).cast("int").alias("year_from"), F.when(n % 2 > 0, 1997 + n % 5).cast("int").alias("year_to"),
        F.when(n % 7 == 1, 10).alias("peak_max"), F.when(n % 11 == 1, 20).alias("debut_max"), F.when(n % 5 == 2, 2).alias("weeks_min"), (n % 13 == 1).alias("ascending"), pick(5, 10, 20).alias("top"),
    )


_ASKED = """(SELECT r AS request_id, [1, 2, 4][CAST(r % 3 + 1 AS INTEGER)] AS chart_id, ['total-weeks', 'weeks-at-number-one', 'weeks-at-position', 'weeks-in-top-n', 'nothing known'][CAST(r % 5 + 1 AS INTEGER)] AS rank_by,
[2, 3, 5, 10, 20, 1, 7][CAST(r % 7 + 1 AS INTEGER)] AS position, CASE WHEN r % 3 > 0 THEN 1995 + r % 4 END AS year_from, CASE WHEN r % 2 > 0 THEN 1997 + r % 5 END AS year_to,
CASE WHEN r % 7 = 1 THEN 10 END AS peak_max, CASE WHEN r % 11 = 1 THEN 20 END AS debut_max, CASE WHEN r % 5 = 2 THEN 2 END AS weeks_min, r % 13 = 1 AS ascending, [5, 10, 20][CAST(r % 3 + 1 AS INTEGER)] AS top
FROM (SELECT id AS r FROM artists UNION ALL SELECT id + 1000000000 FROM songs WHERE id % 100 = 0))"""
_add(
    "requested_records", lambda t: requested_records(t, _requests(t)),
    sql(f"""SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN ascending THEN value ELSE -value END, title, id) AS rank, id, title, artist_credit, value
FROM (SELECT request_id, ascending, top, e.chart_id, entity_id AS id, COUNT(*) AS total_weeks, MIN(rank) AS peak, arg_min(rank, chart_date) AS debut, ANY_VALUE(peak_max) AS pm, ANY_VALUE(debut_max) AS dm, ANY_VALUE(weeks_min) AS wm,
  COUNT(*) FILTER (rank_by = 'total-weeks' OR (rank_by = 'weeks-at-number-one' AND rank = 1) OR (rank_by = 'weeks-at-position' AND rank = position) OR (rank_by = 'weeks-in-top-n' AND rank <= position)) AS value
  FROM {_ASKED} q JOIN ve e ON e.chart_id = q.chart_id AND year(chart_date) >= coalesce(year_from, 0) AND year(chart_date) <= coalesce(year_to, 9999) GROUP BY ALL) m
JOIN (SELECT 1 AS c, * FROM songs UNION ALL SELECT 4, * FROM songs UNION ALL SELECT 2, * FROM albums) i(c, item, title, artist_credit) ON i.c = m.chart_id AND i.item = m.id
WHERE value > 0 AND (pm IS NULL OR peak <= pm) AND (dm IS NULL OR debut <= dm) AND (wm IS NULL OR total_weeks >= wm) QUALIFY rank <= top"""),
)


def _order_weeks(t: Tables, orders: DataFrame) -> DataFrame:
    """For every order the week of each chart that its date stands for."""
    chart = t.charts.select(F.col("id").alias("chart_id"))
    asked = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")).join(F.broadcast(chart))  # a registry
    weeks = charts.available_dates(t).select("chart_id", F.col("chart_date").alias("day"), "chart_date")
    return as_of(asked, weeks, ["chart_id"], "day", "chart_date", before_first=True)


_DATES = "(SELECT w.chart_id, w.chart_date FROM chart_weeks w JOIN valid v ON v.week_id = w.id)"
_ORDER_WEEKS = sql(f"""SELECT q.o_orderkey, q.chart_id, q.day, coalesce(d.chart_date, f.first) AS chart_date
FROM (SELECT o_orderkey, c.id AS chart_id, CAST(o_orderdate AS DATE) AS day FROM orders, charts c) q
ASOF LEFT JOIN {_DATES} d ON q.chart_id = d.chart_id AND q.day >= d.chart_date JOIN (SELECT chart_id, MIN(chart_date) AS first FROM {_DATES} GROUP BY 1) f ON f.chart_id = q.chart_id""")

# -- streams ------------------------------------------------------------------------------------


def _in_batches(rows: DataFrame, batch: str, folder: str, n: int) -> None:
    """Rows as ``n`` files that a stream reads one after another."""
    for i in range(n):
        rows.where(f"{batch} = {i}").coalesce(1).write.mode("append").parquet(folder)


def _weeks_beyond_marks(t: Tables) -> DataFrame:
    """All weeks as a stream of three batches: a week is taken if it is newer than what earlier batches had of its chart."""
    spark, source = _spark(t), fresh_path(_spark(t), "week_stream")
    weeks = t.weeks.withColumn("batch", F.when(F.year("chart_date") < 1997, F.col("id") % 2).when(F.year("chart_date") < 1999, 1 + F.col("id") % 2).otherwise(2))
    _in_batches(weeks, "batch", source, 3)
    stream = spark.readStream.schema(weeks.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(source)
    folder = fresh_path(spark, "new_weeks")
    publish_batches(beyond_marks(stream), folder, "weeks", lambda: F.col("chart_id"), fresh_path(spark, "marks")).awaitTermination()
    return Versions(spark, folder).read("weeks")


_add(
    "weeks_beyond_marks", _weeks_beyond_marks,
    sql("""SELECT id, chart_id, chart_date FROM (SELECT *, CASE WHEN year(chart_date) < 1997 THEN id % 2 WHEN year(chart_date) < 1999 THEN 1 + id % 2 ELSE 2 END AS b FROM chart_weeks) w
WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, CASE WHEN year(chart_date) < 1997 THEN id % 2 WHEN year(chart_date) < 1999 THEN 1 + id % 2 ELSE 2 END AS b FROM chart_weeks) o WHERE o.chart_id = w.chart_id AND o.b < w.b AND o.chart_date >= w.chart_date)"""),
)


def _streamed_runs(t: Tables) -> DataFrame:
    """The runs of all entries from a stream: most weeks in order, some a few weeks late, and an end that closes the last runs."""
    from tidemark.operators.valid_weeks import valid_entries

    spark, source, out = _spark(t), fresh_path(_spark(t), "entry_stream"), fresh_path(_spark(t), "runs")
    entries = valid_entries(t).select("chart_id", "entity_id", "chart_date", "rank")
    half = F.date_trunc("quarter", "chart_date").cast("date")
    late = (F.pmod(F.xxhash64("chart_date"), F.lit(5)) == 0) & (F.datediff("chart_date", half) > 60)  # with the next quarter's
    quarter = F.add_months(half, F.when(late, 3).otherwise(0))
    dealt = entries.withColumn("batch", (F.datediff(quarter, F.lit("1990-01-01").cast("date")) / 360).cast("int"))
    first, last = dealt.agg(F.min("batch"), F.max("batch")).first()
    if first is None:
        return numbered_runs(run_sessions(entries)).select("chart_id", "entity_id", "run", "first_date", "last_date", "weeks", "best")
    _in_batches(dealt.withColumn("batch", F.col("batch") - first), "batch", source, last - first + 1)
    end = spark.range(1).select(F.lit(0).alias("chart_id"), F.lit(-1).cast("long").alias("entity_id"), F.lit("2999-01-05").cast("date").alias("chart_date"), F.lit(1).alias("rank"), F.lit(0).alias("batch"))
    end.select(*dealt.columns).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(source)
    sink = run_sessions(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "sessions"))
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(run_sessions(entries).schema).parquet(out)
    return numbered_runs(found).select("chart_id", "entity_id", "run", "first_date", "last_date", "weeks", "best")


_RUNS = """SELECT chart_id, entity_id, CAST(run AS INTEGER) AS run, MIN(chart_date) AS first_date, MAX(chart_date) AS last_date, COUNT(*) AS weeks, MIN(rank) AS best FROM (
SELECT *, SUM(new) OVER (PARTITION BY chart_id, entity_id ORDER BY chart_date) AS run FROM (
SELECT *, CASE WHEN chart_date - lag(chart_date) OVER (PARTITION BY chart_id, entity_id ORDER BY chart_date) > 14 THEN 1 ELSE 0 END AS new FROM ve)) GROUP BY chart_id, entity_id, run"""
_add("chart_runs_streamed", _streamed_runs, sql(_RUNS))
_add("chart_run_sessions", lambda t: numbered_runs(run_sessions(t.entries.join(F.broadcast(_counting(t)), ["chart_id", "week_id"], "left_semi"))), sql(_RUNS))


def _counting(t: Tables) -> DataFrame:
    from tidemark.operators.valid_weeks import valid_weeks

    return valid_weeks(t.entries)  # a calendar
