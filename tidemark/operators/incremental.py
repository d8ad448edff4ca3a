"""A stored chart history that loads keep up to date: entries, the state behind every statistic, and rollups by artist.

A load brings placements (who stood where in which week) of weeks that may come in any order.  What it costs follows from
what it changes:

* **Entries.**  A week that is put in before others changes what its items' later entries say (weeks so far, best
  position so far, position of the week before, whether it is the first one).  Only those suffixes are derived anew, from the
  state that each item had before them.
* **Weeks that count.**  A new or changed entry can make a week a phantom or end its being one.  The
  difference between the weeks that counted and those that count now gives signed placements: rows that enter the statistics and
  rows that leave them.
* **Statistics.**  Numbers of weeks add up, with signs.  Extremes (first and last date, best rank) merge where rows only
  come; for an item that loses rows they are taken from its entries again.  Most entries in a week and
  different items are not additive: they are derived for the affected artists alone, from the states by item and by week.

Every load is one version (``sources.versions``): its merges rewrite only the parts that its rows fall into, readers see all of
it or nothing, and a writer who meets another one builds on what that one has published.

Defined results: placements of weeks that are stored already change nothing, so a load can be repeated; of two
placements at one rank of a week the smaller entity stays; an empty load publishes nothing; items without links have statistics
of their own and none by artist.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.stats import careers, chart_totals, ranks_of
from tidemark.operators.valid_weeks import valid_weeks
from tidemark.sources.projection import ENTRY_COLUMNS
from tidemark.sources.shared import staged
from tidemark.sources.versions import Version, Versions

PLACED = ["chart_id", "week_id", "chart_date", "entity_id", "rank"]
ITEM, POSITION = ["chart_id", "entity_id"], ["chart_id", "week_id", "rank"]
#: Parts of the tables that are kept by artist, and of each chart's items.
ARTIST_PARTS, ITEM_PARTS = 32, 16


def rederived(entries: DataFrame, added: DataFrame) -> DataFrame:
    """The entries that placements ``added`` bring or change: each item's, from its first added one on.

    Everything joins on the affected items; entries before an item's first added one only give the state that it had.
    """
    since = added.groupBy(*ITEM).agg(F.min("chart_date").alias("_since"))
    touched = entries.join(since, ITEM)
    before = touched.where("chart_date < _since").groupBy(*ITEM).agg(
        F.count("*").cast("int").alias("_n"), F.min("rank").alias("_peak"), F.max("chart_date").alias("_date"), F.max_by("rank", "chart_date").alias("_rank")
    )
    suffix = touched.where("chart_date >= _since").select(*PLACED).unionByName(added.select(*PLACED)).join(before, ITEM, "left")
    so_far = Window.partitionBy(*ITEM).orderBy("chart_date")
    date, rank = (F.coalesce(F.lag(c).over(so_far), F.col(known)) for c, known in (("chart_date", "_date"), ("rank", "_rank")))
    weeks = F.coalesce("_n", F.lit(0)) + F.row_number().over(so_far)
    peak = F.least("_peak", F.min("rank").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = F.when(F.datediff("chart_date", date) == 7, rank).otherwise(0)
    found = suffix.withColumns({"peak_pos": peak, "last_pos": last, "weeks_on_chart": weeks}).withColumn("is_new", F.col("weeks_on_chart") == 1)
    return found.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in ENTRY_COLUMNS.split(", ")])


def with_changes(entries: DataFrame, changed: DataFrame) -> DataFrame:
    """``entries`` with changed and new ones in their places."""
    return entries.join(changed.select(*POSITION), POSITION, "left_anti").unionByName(changed)


def signed_placements(before: DataFrame, after: DataFrame) -> DataFrame:
    """Placements with a ``sign``: 1 for those that count after a change and did not before, -1 for the others that differ."""
    of = lambda entries, sign: entries.join(F.broadcast(valid_weeks(entries)), ["chart_id", "week_id"], "left_semi").select(*PLACED, F.lit(sign).alias("sign"))
    both = of(before, -1).unionByName(of(after, 1))
    return both.groupBy(*PLACED).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")


def merged_ranks(old: DataFrame, change: DataFrame) -> DataFrame:
    """The ranks of items after a change: sums and extremes; a ``whole`` row replaces what was there; nothing is left of a count of zero."""
    both = old.withColumn("whole", F.lit(False)).unionByName(change)
    whole = lambda c: F.max(F.when(F.col("whole"), F.col(c)))
    found = both.groupBy(*ITEM, "rank").agg(
        F.coalesce(whole("n"), F.sum("n")).alias("n"),
        F.coalesce(whole("first"), F.min("first")).alias("first"), F.coalesce(whole("last"), F.max("last")).alias("last"),
    )
    return found.where("n > 0")


def rank_changes(signed: DataFrame, counted: DataFrame) -> DataFrame:
    """Changes for ``merged_ranks``: increments where placements only come, whole rows for a rank of an item that loses some.

    ``counted`` has the entries that count now.
    """
    key = [*ITEM, "rank"]
    sums = signed.groupBy(*key).agg(
        F.sum("sign").alias("n"), F.min("chart_date").alias("first"), F.max("chart_date").alias("last"), F.bool_or(F.col("sign") < 0).alias("loses")
    )
    sums = staged(sums, "rank_sums")
    losing = sums.where("loses").select(*key)
    now = ranks_of(counted.join(losing, key, "left_semi"), ITEM)
    whole = losing.join(now, key, "left").select(*key, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "first", "last", F.lit(True).alias("whole"))
    return sums.where("not loses").select(*key, "n", "first", "last", F.lit(False).alias("whole")).unionByName(whole)


def entry_part() -> Column:
    return F.concat_ws("-", "chart_id", F.year("chart_date"))


def item_part() -> Column:
    return F.concat_ws("-", "chart_id", F.pmod(F.xxhash64("entity_id"), F.lit(ITEM_PARTS)))


def artist_part() -> Column:
    return F.pmod(F.xxhash64("artist_id"), F.lit(ARTIST_PARTS))


class ChartStore:
    """The stored history of charts and what is kept with it.

    ``links`` (chart_id, entity_id, artist_id) says whose an item is.  Tables: entries (by chart and year), item_ranks (by chart and
    item), artist_weeks and artist_chart_stats (by artist).
    """

    def __init__(self, spark: SparkSession, folder: str, links: DataFrame):
        self.spark, self.versions = spark, Versions(spark, folder)
        self._links = links

    @cached_property
    def links(self) -> DataFrame:
        return self._links.select("chart_id", "entity_id", "artist_id")

    # -- reading ------------------------------------------------------------------------------

    def entries(self, version: Version | None = None) -> DataFrame:
        version = version or self.versions.latest()
        if "entries" not in version.schemas:
            return self.spark.createDataFrame([], ENTRY_COLUMNS)
        return self.versions.read("entries", version)

    def item_stats(self) -> DataFrame:
        """(chart_id, entity_id, career statistics) of every chart's items: one aggregate over their ranks."""
        return careers(self.versions.read("item_ranks"), ITEM)

    def artist_chart_stats(self) -> DataFrame:
        return self.versions.read("artist_chart_stats")

    # -- loading ------------------------------------------------------------------------------

    def load(self, placements: DataFrame) -> Version:
        """Adds the weeks that are not stored yet, with all that follows from them, as one version."""
        placements = staged(placements.select(*PLACED), "placements")
        return self.versions.publish(lambda base: self._loaded(base, placements))

    def _of_charts(self, version: Version, charts: list[int]) -> DataFrame:
        """The entries of some charts: only their parts are read."""
        if "entries" not in version.schemas:
            return self.entries(version)
        parts = [p for p in version.tables["entries"] if int(p.split("-")[0]) in charts]
        return self.versions.read("entries", version, parts)

    def _loaded(self, base: Version, placements: DataFrame) -> Version:
        known = self.entries(base).select("chart_id", "chart_date").distinct()  # a calendar
        new = placements.join(F.broadcast(known), ["chart_id", "chart_date"], "left_anti")
        new = staged(new.groupBy("chart_id", "week_id", "chart_date", "rank").agg(F.min("entity_id").alias("entity_id")), "new")
        charts = [r["chart_id"] for r in new.select("chart_id").distinct().collect()]  # of the registry
        if not charts:
            return base
        before = self._of_charts(base, charts)
        changed = staged(rederived(before, new), "changed")
        version = self.versions.merged(base, "entries", changed, entry_part(), with_changes)
        after = self._of_charts(version, charts)
        signed = staged(signed_placements(before, after), "signed")

        counted = after.join(F.broadcast(valid_weeks(after)), ["chart_id", "week_id"], "left_semi")
        version = self._merged(version, "item_ranks", staged(rank_changes(signed, counted), "rank_changes"), item_part(), merged_ranks)
        weekly = signed.join(self.links, ITEM).groupBy("artist_id", "chart_id", "week_id").agg(F.sum("sign").cast("long").alias("n"))
        weekly = staged(weekly, "weekly")
        summed = lambda old, change: old.unionByName(change).groupBy("artist_id", "chart_id", "week_id").agg(F.sum("n").alias("n")).where("n <> 0")
        version = self._merged(version, "artist_weeks", weekly, artist_part(), summed)
        affected = staged(weekly.select("artist_id", "chart_id").distinct(), "affected")
        rows = staged(self._rollups(version, affected), "rollups")
        replaced = lambda old, _: old.join(affected, ["artist_id", "chart_id"], "left_anti").unionByName(rows)
        hit = affected.withColumn("_n", F.lit(0))
        return self._replaced(version, "artist_chart_stats", hit, rows, replaced)

    def _merged(self, version: Version, name: str, change: DataFrame, part: Column, resolve) -> Version:
        """A merge whose first load goes through ``resolve`` as well."""
        if name not in version.schemas:
            empty = self.spark.createDataFrame([], change.drop("whole").schema)
            return self.versions.written(version, name, resolve(empty, change), part)
        return self.versions.merged(version, name, change, part, resolve)

    def _replaced(self, version: Version, name: str, hit: DataFrame, rows: DataFrame, resolve) -> Version:
        if name not in version.schemas:
            return self.versions.written(version, name, rows, artist_part())
        return self.versions.merged(version, name, hit, artist_part(), resolve)

    def _rollups(self, version: Version, affected: DataFrame) -> DataFrame:
        """The rollups of the affected artists and charts, from the states of their own items and weeks."""
        items = staged(self.links.join(affected, ["artist_id", "chart_id"], "left_semi").distinct(), "items")
        parts = [r["p"] for r in items.select(item_part().alias("p")).distinct().collect()]  # at most the table's parts
        ranks = items.join(self.versions.read("item_ranks", version, parts), ITEM)
        by_item = ranks.groupBy("artist_id", *ITEM).agg(F.sum("n").alias("n"), F.min("rank").alias("best"), F.min("first").alias("first"), F.max("last").alias("last"))
        parts = [r["p"] for r in affected.select(artist_part().cast("string").alias("p")).distinct().collect()]
        weeks = self.versions.read("artist_weeks", version, parts).join(affected, ["artist_id", "chart_id"], "left_semi")
        at_once = weeks.groupBy("artist_id", "chart_id").agg(F.max("n").cast("int").alias("max_simultaneous"))
        return chart_totals(by_item).join(at_once, ["artist_id", "chart_id"])
