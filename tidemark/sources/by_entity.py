"""Entries and credits kept in buckets of their item, so that they meet, and items are summed, without an exchange.

Both are written once to the shared folder, in as many buckets as their rows ask for and by the same columns;
a bucket of each is read by one task.  An item stands at most once in a week of its chart, so no bucket
holds a hot key, and an artist's credits are spread by item, however many they are.  The session's catalog only
learns where the tables are: a later session finds them by their folder.
"""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.projection import ENTRY_COLUMNS, Tables
from tidemark.sources.shared import exists, file_system

KEYS = ["chart_id", "entity_id"]
CREDIT_COLUMNS = "chart_id int, entity_id long, artist_id long, role string"
#: Rows of the larger table that a bucket is meant to hold, and the fewest buckets.
BUCKET_ROWS, FEWEST = 1 << 22, 8


def bucket_count(rows: int) -> int:
    """A power of two of buckets, none of which holds more than ``BUCKET_ROWS`` on average."""
    return max(FEWEST, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length())


def _written(spark: SparkSession, home: str) -> int | None:
    """The number of buckets of the tables in a folder; None if they are not complete."""
    if not exists(spark, home):
        return None
    fs, make = file_system(spark, home)
    found = [s.getPath().getName() for s in fs.listStatus(make(home))]
    whole = [int(n) for n in found if n.isdigit() and all(exists(spark, f"{home}/{n}/{t}/_SUCCESS") for t in ("entries", "credits"))]
    return max(whole, default=None)


def _defined(spark: SparkSession, path: str, columns: str, buckets: int) -> str:
    """The name under which the session's catalog knows the bucketed table of a folder."""
    name = f"tidemark_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
    keys = ", ".join(KEYS)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def _write(rows: DataFrame, path: str, columns: str, buckets: int) -> None:
    """One sorted file for each bucket."""
    spark, name = rows.sparkSession, _defined(rows.sparkSession, path, columns, buckets)
    typed = rows.select(*[F.col(n).cast(kind).alias(n) for n, kind in (c.split() for c in columns.split(", "))])
    typed.repartition(buckets, *KEYS).sortWithinPartitions(*KEYS).write.insertInto(name, overwrite=True)
    spark.catalog.refreshTable(name)


def by_entity(t: Tables, credits: DataFrame, home: str) -> tuple[Tables, DataFrame]:
    """``t`` with its entries, and ``credits`` (chart_id, entity_id, artist_id, role), from buckets by item in ``home``.

    They are written if ``home`` doesn't hold them whole; a write that was cut short is done again.  Its name must
    change with their contents.  Rows without an item or a chart stay, in a bucket of their own, and join nothing.
    """
    spark = t.entries.sparkSession
    buckets = _written(spark, home)
    if buckets is None:
        buckets = bucket_count(max(t.entries.count(), credits.count()))
        _write(t.entries, f"{home}/{buckets}/entries", ENTRY_COLUMNS, buckets)
        _write(credits, f"{home}/{buckets}/credits", CREDIT_COLUMNS, buckets)
    entries = spark.table(_defined(spark, f"{home}/{buckets}/entries", ENTRY_COLUMNS, buckets))
    return replace(t, entries=entries), spark.table(_defined(spark, f"{home}/{buckets}/credits", CREDIT_COLUMNS, buckets))
