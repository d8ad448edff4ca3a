"""Exact dedup with a heavy-hitter split.

1. Each text is normalised (every run of white space becomes one space) and hashed with SHA-256;
   (doc_id, digest) is staged with a number for each row, so the texts are read once and ties are settled.
2. A Misra-Gries summary (``freqItems``: the counter algorithm of Misra-Gries and Karp et al., built
   per partition and merged) holds at most ``1 / support`` digests, among them every digest with more
   than ``support`` of the rows.
3. An exact count verifies the candidates.  The winners - at most ``1 / support`` rows - are broadcast:
   their copies are resolved map-side, without moving a row of a hot group.
4. All other digests take ordinary shuffles: an aggregate that combines in each task, and a join of its
   rows with the digests.  Of these, groups of ``common.LARGE_GROUP`` rows and more join map-side too if their
   counted list is small, so no task of the join holds more rows of one group.

No window is used: a group's first row is the least (doc_id, row number) of an aggregate.

Only DataFrame functions run here.  Defined results: a null text is an empty one; all empty texts are
one group; rows with a null ``doc_id`` lose against any other id; of repeated rows (same id, same
text) exactly one stays; long texts are hashed whole; columns besides doc_id and text are not looked at,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_groups, keep_rows, staged, text_key

#: Share of the rows from which a digest counts as a heavy hitter; the summary has 1 / SUPPORT counters.
SUPPORT = 0.001

#: Runs that are not one plain space already; the rest of a text is left untouched.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, digest, row): SHA-256 of the normalised text; row differs for each row once this is staged."""
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")
    return docs.select("doc_id", text_key().alias("text_key"), digest, F.monotonically_increasing_id().alias("row"))


def groups(digested: DataFrame) -> DataFrame:
    """(digest, group_size, first): first is the (no_id, doc_id, row, text_key) of the row that stays."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "text_key"))
    return digested.groupBy("digest").agg(F.count("*").alias("group_size"), first.alias("first"))


def heavy_hitters(digested: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The groups of the digests that truly hold at least ``support`` of the rows."""
    found = digested.select(F.hex("digest").alias("d")).stat.freqItems(["d"], support)
    candidates = found.select(F.explode("d_freqItems").alias("d")).select(F.unhex("d").alias("digest"))
    counted = groups(digested.join(F.broadcast(candidates), "digest"))  # at most 1 / support rows
    least = digested.agg((F.count("*") * support).alias("least"))
    return counted.join(F.broadcast(least), F.col("group_size") >= F.col("least")).drop("least")


def _split(docs: DataFrame, support: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged: the digests of all rows, the groups of the heavy ones, the groups of the others."""
    digested = staged(digests(docs), "digests")
    winners = staged(heavy_hitters(digested, support), "winners")
    light = digested.join(F.broadcast(winners.select("digest")), "digest", "left_anti")  # at most 1 / support rows
    return digested, winners, staged(groups(light), "groups")


def exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept."""
    digested, winners, light = _split(docs, support)

    def resolved(rows: DataFrame) -> DataFrame:
        kept = F.col("row") == F.col("first.row")
        return rows.select("doc_id", "digest", F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"))

    rest = digested.join(F.broadcast(winners.select("digest")), "digest", "left_anti")  # at most 1 / support rows
    return resolved(digested.join(F.broadcast(winners), "digest")).unionByName(resolved(join_groups(rest, light, "digest", "group_size", 96)))


def drop_exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay."""
    digested, winners, light = _split(docs, support)
    keepers = winners.unionByName(light).select("first.doc_id", "first.text_key")
    return keep_rows(docs, digested, staged(keepers, "keepers"))
