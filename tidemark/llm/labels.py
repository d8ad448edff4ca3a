"""Labelled texts for the classifiers: folds, a bounded training sample, the rows to be scored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, staged

#: At most so many labelled rows are collected to train a model; the same rows for the same labels.
TRAINING_ROWS = 8000
#: Texts of more UTF-8 bytes are scored but not learnt from, so a sample has at most TRAINING_ROWS times as many.
TRAINING_TEXT_BYTES = 1 << 15


def held_out():
    """Whether a row's label may not be learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int = TRAINING_ROWS) -> list:
    """(text, lang, label) of at most ``limit`` labelled rows outside the held-out fold, in a fixed order.

    The sample is bounded in rows and in bytes; neither bound holds for what is scored.

    A null label or id teaches nothing; an id with contradicting labels counts as its larger one.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    short = docs.select("doc_id", "text", "lang").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAINING_TEXT_BYTES)
    rows = short.join(F.broadcast(chosen), "doc_id")  # at most ``limit`` rows
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(limit).select("text", "lang", "y").collect()


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, lang, y) of every labelled row outside the held-out fold, whatever its length.

    A null label or id teaches nothing; an id with contradicting labels counts as its larger one.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = staged(usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")), "labelled")
    return docs.select("doc_id", "text", "lang").join(broadcast_if_small(chosen), "doc_id")


#: Values of a feature count as different from this relative distance on: far above what maths libraries differ by.
APART = 1e-9
#: Where a cut lies between two values: at no simple fraction, so that no whole number or ratio unseen in the sample lies on it.
WITHIN = (3 - 5**0.5) / 2


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` cuts at the quantiles of a feature, each between neighbouring values of the sample.

    No cut lies on a value, so a feature that another machine computes with another last bit falls into the same bin.
    """
    found = np.unique(values)
    apart = np.diff(found) > APART * np.maximum(1, np.abs(found[1:]))
    gap = np.searchsorted(found[:-1][apart], np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]), "left") - 1
    return (found[:-1] + WITHIN * np.diff(found))[apart][np.unique(gap[gap >= 0])]
