"""Token counts as delta-maintained rollups.

A change adds a document's token count (an insert), takes it away (a delete) or does both (a revision: a new
text, a corrected count, another tokenizer version).  A batch of changes is summed to signed deltas by source,
language and tokenizer version, and committed as one folder of the rollup.  Totals are the sums over the
committed batches, so they never re-read a document.

A batch is written once under its identifier: Spark's writer leaves its success marker last, a batch
that has it is skipped on replay, and one that failed half-way is written anew.  ``compact`` folds all
batches into one; their identifiers stay known, so a replay after it still changes nothing.  Batches of different
identifiers may be committed at the same time, beside a ``compact`` too; the same identifier, or two ``compact``, must not
run at once.

Defined results: null texts have no tokens and long ones are counted whole; a null count is a document without
tokens; null sources and languages are groups of their own; repeated rows and repeated or null ids count once for
each row; further columns are not looked at, whatever their names; groups whose documents and tokens have all gone
vanish from the totals; an empty table or batch is committed too and changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import BLOCK_DOCS, Vocabulary

KEY = ["source", "lang", "tokenizer"]
_DELTA = "source string, lang string, tokenizer string, documents long, tokens long"


# -- counting ---------------------------------------------------------------------------------


def bpe_counts(docs: DataFrame, vocabulary: Vocabulary, tokenizer: str) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens) by a byte-level BPE vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(start, BLOCK_DOCS)
                counts = [len(ids) for ids in encoder.encode_many([t or "" for t in part.column("text").to_pylist()])]
                yield pa.record_batch([*(part.column(c) for c in ("doc_id", "source", "lang")), pa.array(counts, pa.int64())], names=["doc_id", "source", "lang", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "source", "lang", "text").mapInArrow(run, f"doc_id {kind}, source string, lang string, tokens long")
    return counted.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), "tokens")


def word_counts(docs: DataFrame, tokenizer: str = "words-1", separator: str = r"[\x20\x09-\x0D]+") -> DataFrame:
    """The same by white space (space, tab, LF, VT, FF, CR) or another separator."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), separator), lambda w: w != "")
    return docs.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.size(words).cast("long").alias("tokens"))


# -- changes ----------------------------------------------------------------------------------


def inserts(counts: DataFrame) -> DataFrame:
    """Signed changes (source, lang, tokenizer, documents, tokens) that add the documents of ``counts``."""
    return _signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    """Signed changes that take the documents of ``counts`` away."""
    return _signed(counts, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that lead from the counts ``old`` to the counts ``new``: the one go, the others come.

    Nothing is matched, so repeated and null ids need no rule; what stays the same cancels out in the sums, and a
    document that moves to another source, language or tokenizer leaves the one group and enters the other.
    """
    return deletes(old).unionByName(inserts(new))


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    tokens = F.coalesce(F.col("tokens"), F.lit(0)).cast("long") * sign
    return counts.select(*KEY, F.lit(sign).cast("long").alias("documents"), tokens.alias("tokens"))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums by group: one map-side combine and a shuffle of a row for each group and task."""
    sums = changes.groupBy(*KEY).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return sums.where("documents <> 0 or tokens <> 0")


# -- the rollup -------------------------------------------------------------------------------


class TokenRollup:
    """Committed batches of deltas in a folder that driver and executors share.

    ``batch-<id>`` holds a batch, ``fold-<number>`` the sums of all batches that ``covers-fold-<number>`` names.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._jvm_path(f"{self.path}/{name}"))

    def _named(self, pattern: str) -> list[str]:
        """Folders that are whole, by one listing."""
        found = self._fs.globStatus(self._jvm_path(f"{self.path}/{pattern}/_SUCCESS"))
        return sorted(s.getPath().getParent().getName() for s in found or [])

    def _folded(self) -> tuple[str | None, DataFrame]:
        """The latest fold and a table (value) of the batches that it covers."""
        folds = self._named("fold-*")
        if not folds:
            return None, self.spark.createDataFrame([], "value string")
        return folds[-1], self.spark.read.text(f"{self.path}/covers-{folds[-1]}")

    def _live(self, covered: DataFrame) -> list[str]:
        """The folders of the batches that no fold covers yet."""
        batches = self._named("batch-*")
        if not batches:
            return []
        gone = {r["value"] for r in covered.where(F.col("value").isin(batches)).collect()}  # of the folders just listed
        return [b for b in batches if b not in gone]

    def is_committed(self, batch_id: str) -> bool:
        """Looks for this batch alone: its own folder, then the list of the latest fold."""
        name = f"batch-{batch_id}"
        return self._exists(f"{name}/_SUCCESS") or not self._folded()[1].where(F.col("value") == name).isEmpty()

    def committed(self) -> DataFrame:
        """(batch_id) of all batches that count."""
        _, covered = self._folded()
        live = self.spark.createDataFrame([(b,) for b in self._live(covered)], "value string")
        return covered.unionByName(live).select(F.regexp_replace("value", "^batch-", "").alias("batch_id"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds a batch of changes; False if this batch had been committed before."""
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError(f"not a batch identifier: {batch_id!r}")
        if self.is_committed(batch_id):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")
        return True

    def _sums(self, folders: list[str]) -> DataFrame:
        """The deltas of some batches and folds, summed by group."""
        if not folders:
            return self.spark.createDataFrame([], _DELTA)
        return deltas(self.spark.read.schema(_DELTA).parquet(*(f"{self.path}/{n}" for n in folders)))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all committed batches."""
        fold, covered = self._folded()
        return self._sums([*self._live(covered), *[fold] * bool(fold)])

    def compact(self) -> None:
        """Folds all batches into one; the fold counts from the moment its success marker is there.

        The batches are listed once: a batch committed meanwhile is neither in the fold's list nor in its sums, and stays live.
        """
        fold, covered = self._folded()
        live = self._live(covered)
        name = f"fold-{int(fold.split('-')[1]) + 1 if fold else 0:09d}"
        covered.unionByName(self.spark.createDataFrame([(b,) for b in live], "value string")).write.mode("overwrite").text(f"{self.path}/covers-{name}")
        self._sums([*live, *[fold] * bool(fold)]).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def clean(self) -> None:
        """Removes the folders that the latest fold has made superfluous, once nobody reads older totals any more."""
        fold, covered = self._folded()
        live = set(self._live(covered))
        for name in [n for n in (*self._named("batch-*"), *self._named("fold-*"), *self._named("covers-*")) if fold and n not in live | {fold, f"covers-{fold}"}]:
            self._fs.delete(self._jvm_path(f"{self.path}/{name}"), True)
