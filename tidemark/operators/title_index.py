"""A stored index of titles by trigram: similar titles without a look at all the others.

``postings`` has a row for each trigram of a title, with the number of its trigrams, in buckets by trigram.  A query reads
the buckets of its own trigrams and of those only titles of a fitting number of trigrams: with similarity s, a
title of n trigrams can only be alike to a query of m if s * m <= n <= m / s.  The shared ones are counted, which gives the exact
similarity; titles are read for what is listed, by identifier.

The index is versioned (``sources.versions``).  New titles append postings; for a changed one the old stamp is put on the list of
replaced ones, so nothing is rewritten but the buckets of titles by identifier.

Defined results: null titles and titles without letters and digits are alike to nothing; of rows with one identifier in one
load the smallest title counts; a load that changes nothing publishes nothing; a frequent trigram's bucket is written by
many tasks, by identifier.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.names import SIMILAR, trigrams
from tidemark.sources.shared import staged
from tidemark.sources.versions import Version, Versions

#: Buckets of postings by trigram, of titles by identifier, and tasks that write one bucket of postings at most.
BUCKETS, TITLE_BUCKETS, WRITERS = 64, 16, 8
#: So many found identifiers at most are written into the filter of the scan; more are joined.
LISTED = 1000

_POSTING = "trigram string, id long, stamp long, n int"
_TITLE = "id long, stamp long, title string"


def _bucket(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BUCKETS))


def _title_bucket() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(TITLE_BUCKETS))


class TitleIndex:
    """The index in a folder that all writers and readers share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    @property
    def is_empty(self) -> bool:
        return self.versions.latest().number == 0

    def _read(self, name: str, schema: str, version: Version, parts=None) -> DataFrame:
        if name not in version.schemas:
            return self.spark.createDataFrame([], schema)
        return self.versions.read(name, version, parts)

    # -- loading ------------------------------------------------------------------------------

    def upsert(self, items: DataFrame) -> Version:
        """Adds the titles of ``items`` (id, title) that the index lacks or has otherwise."""
        given = staged(items.where("id is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.min("title").alias("title")), "titles")
        return self.versions.publish(lambda base: self._upserted(base, given))

    def _upserted(self, base: Version, given: DataFrame) -> Version:
        old = self._read("titles", _TITLE, base)
        both = given.join(old.select("id", F.col("stamp").alias("_stamp"), F.col("title").alias("_title")), "id", "left")
        changed = both.where(F.col("_stamp").isNull() | ~F.col("title").eqNullSafe(F.col("_title")))
        changed = staged(changed.select("id", F.xxhash64("title", F.lit(base.number)).alias("stamp"), "title", "_stamp"), "changed")
        if changed.isEmpty():
            return base
        grams = changed.select("id", "stamp", trigrams(F.col("title")).alias("g")).select("id", "stamp", F.size("g").alias("n"), F.explode("g").alias("trigram"))
        # Files by bucket and identifier: a trigram that most titles have is no single task's.
        dealt = grams.select("trigram", "id", "stamp", "n").repartition(_bucket(F.col("trigram")), F.pmod(F.xxhash64("id"), F.lit(WRITERS))).sortWithinPartitions("trigram", "n")
        version = self.versions.written(base, "postings", dealt, F.concat_ws(".", _bucket(F.col("trigram")), F.lit(base.number)), [])
        gone = changed.where("_stamp is not null").select("id", F.col("_stamp").alias("stamp"))
        version = self.versions.written(version, "replaced", gone, F.lit(str(base.number)), [])
        new = changed.select("id", "stamp", "title")
        return self.versions.merged(version, "titles", new, _title_bucket(), lambda was, now: was.join(now.select("id"), "id", "left_anti").unionByName(now))

    # -- searching ----------------------------------------------------------------------------

    def alike(self, query: str, least: float = SIMILAR) -> DataFrame:
        """(id, sim) of all titles whose similarity to the query reaches ``least``, from the buckets of its trigrams alone."""
        version = self.versions.latest()
        grams = self.spark.range(1).select(F.transform(trigrams(F.lit(query)), lambda g: F.struct(g.alias("g"), _bucket(g).alias("b"))).alias("q")).first()["q"]
        wanted, m = [r["g"] for r in grams], len(grams)
        parts = [p for p in version.tables.get("postings", {}) if int(p.split(".")[0]) in {r["b"] for r in grams}]
        rows = self._read("postings", _POSTING, version, parts)
        fitting = rows.where(F.col("trigram").isin(wanted) & F.col("n").between(math.ceil(least * m - 1e-9), math.floor(m / least + 1e-9)))
        current = fitting.join(self._read("replaced", "id long, stamp long", version), ["id", "stamp"], "left_anti")
        shared = current.groupBy("id", "n").agg(F.count("*").alias("k"))
        return shared.select("id", (F.col("k") / (F.col("n") + m - F.col("k"))).alias("sim")).where(F.col("sim") >= least)

    def best(self, query: str, limit: int) -> DataFrame:
        """(id, title, sim) of the titles that a list of ``limit`` by similarity is taken from: those as alike as its last one, or more."""
        version = self.versions.latest()
        found = staged(self.alike(query), "alike")
        last = found.orderBy(F.desc("sim")).limit(limit).agg(F.min("sim").alias("s")).first()["s"]
        chosen = found.where(F.col("sim") >= F.lit(last)) if last is not None else found
        few = chosen.select("id", _title_bucket().cast("string").alias("p")).limit(LISTED + 1).collect()
        titles = self._read("titles", _TITLE, version, None if len(few) > LISTED else {r["p"] for r in few})
        if len(few) <= LISTED:
            titles = titles.where(F.col("id").isin([r["id"] for r in few]))
        return titles.select("id", "title").join(chosen, "id")
