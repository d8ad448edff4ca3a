"""What the operators of this subpackage share: staged tables, size-checked joins, word lists.

Row identity.  The operators identify a document by ``doc_id``.  A null ``doc_id`` is a value like
any other.  Extra columns are ignored by the operators (they select what they need first), so
clashing names cannot reach a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import fresh_path, scratch, staged

__all__ = ["fresh_path", "scratch", "staged"]  # the other modules here take them from this one

#: A side of a join is broadcast only when its counted rows times their width stay below this.
BROADCAST_BYTES = 16 << 20

#: Rows from which a group is joined by a broadcast row of its own, so that no task of a shuffle holds more of one group.
LARGE_GROUP = 100_000

#: Word separators of every operator here: space, tab, LF, VT, FF, CR (what bytes.split() splits at).
SPACE = r"[\x20\x09-\x0D]"


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Counts a staged table (from its footers) against the broadcast bound."""
    return df.count() * row_bytes <= limit


def broadcast_if_small(df: DataFrame, row_bytes: int = 24, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted size allows it, else as it is: a shuffled join."""
    return F.broadcast(df) if small_enough(df, row_bytes, limit) else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str = "n", row_bytes: int = 64) -> DataFrame:
    """``rows`` joined with the staged ``groups`` (a row for each key, with its number of rows ``size``).

    A table of groups is broadcast if its counted size allows it.  Else its large groups are, by the same rule, and
    the others shuffle, so a hot key does not gather its rows in one task.
    """
    if small_enough(groups, row_bytes):
        return rows.join(F.broadcast(groups), key)
    large = groups.where(F.col(size) >= LARGE_GROUP)
    if large.isEmpty() or not small_enough(large, row_bytes):
        return rows.join(groups, key)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(groups.where(F.col(size) < LARGE_GROUP), key)
    return rows.join(F.broadcast(large), key).unionByName(rest)


def text_key():
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def without_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the ids in the staged one-column table ``dropped``; null ids match null ids."""
    gone = broadcast_if_small(dropped.select(F.col(dropped.columns[0]).alias("_gone")).distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def keep_rows(docs: DataFrame, rows: DataFrame, keepers: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one for each of the staged ``keepers`` (doc_id, text_key, without repeats).

    ``rows`` (staged) has the doc_id of every row.  An id whose rows all go or all stay is settled by its id; the
    ids of losing rows are broadcast if their counted size allows it and joined by a shuffle otherwise.  Only where
    an id stands on several rows of different fate (null ids, repeated rows) are its rows told apart by their text,
    and then each task first reduces equal ones to one, so a row that is repeated without end is no hot group.
    """
    one = lambda df, n, k: df.select("doc_id", F.lit(n).alias("n"), F.lit(k).alias("k"))
    both = one(rows, 1, 0).unionByName(one(keepers, 0, 1)).groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    per_id = staged(both.where("n <> k"), "losing_ids")
    whole = without_ids(docs, per_id.select("doc_id"))
    mixed = per_id.where("k > 0").select(F.col("doc_id").alias("_mid"))
    if mixed.isEmpty():
        return whole
    # A row travels as a struct, so none of its columns can clash with those of the keepers.
    own = docs.select(F.col("doc_id").alias("_id"), text_key().alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    own = own.join(broadcast_if_small(mixed), F.col("_id").eqNullSafe(F.col("_mid")), "left_semi").groupBy("_id", "_key").agg(F.any_value("_row").alias("_row"))
    stay = keepers.select(F.col("doc_id").alias("_kid"), F.col("text_key").alias("_kkey"))
    stay = own.join(stay, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_key") == F.col("_kkey")), "left_semi")
    return whole.unionByName(stay.select("_row.*"))


def first_of_each(found: DataFrame, group: str) -> DataFrame:
    """(doc_id, text_key) of the first row of each group: the smallest doc_id, any id before none."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    return found.groupBy(group).agg(F.min(order).alias("first")).select("first.doc_id", "first.text_key")


def keep_one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the first row of each component of ``found`` (doc_id, text_key, root: a row for each)."""
    found = staged(found.select("doc_id", "text_key", "root"), "found")
    return keep_rows(docs, found, staged(first_of_each(found, "root"), "keepers"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
