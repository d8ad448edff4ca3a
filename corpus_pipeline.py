"""The corpus pipeline: documents in, encoded documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the
shared folder and reads again as the next stage's ``docs``.  All stages but the last keep the columns of
``documents`` and only take rows away; nulls, empty tables, repeated rows and further columns are handled
as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, exact_dedup, near_copies, toxicity
from tidemark.llm.common import staged, table

#: Whole texts that a task holds at once, by reader and on the way to Python; Spark's own bounds (4096 and 10000) hold most of a task's texts.
ROWS_AT_ONCE = {"spark.sql.parquet.columnarReaderBatchSize": 1024, "spark.sql.execution.arrow.maxRecordsPerBatch": 1024}


def few_rows_at_once(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` in a session of ``ROWS_AT_ONCE`` or less; the session keeps these, as the result is read after the stage's return."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, most in ROWS_AT_ONCE.items():
            if not 0 < int(spark.conf.get(name)) <= most:
                spark.conf.set(name, most)
        return stage(spark, docs, sf_dir)

    return run


@few_rows_at_once
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches their language's threshold go; the model learns from ``labels``."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


@few_rows_at_once
def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.drop_exact_duplicates(docs)


@few_rows_at_once
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays."""
    return near_copies.drop_near_copies(docs)


@few_rows_at_once
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@few_rows_at_once
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text and the bytes that they decode to."""
    return bpe.encode_documents(docs, bpe.public_vocabulary(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_duplicates),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("bpe", encode),
]

#: No SQL expresses the classifier or the components of near copies; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
