"""Embedding whitening: principal components of all vectors, by moments that merge pairwise.

Entries become whole numbers (``floor(64 * c) + 1000000``), and the components are learnt from the different vectors
among them.  Each partition of those computes its count, sums and centred scatter, block by block; two such states
merge by Chan's formula, on the way up a ``treeReduce``, so that nothing is ever squared before it is centred and the
driver gets a handful of states of one matrix each.  The driver decomposes one covariance.  A second pass over
the different vectors verifies that the covariance of the whitened ones is the identity; a third writes
the projections of every row.

Defined results: a vector is dropped if it is null or holds a null, a NaN or an infinity.  Entries beyond
``BOUND / 64`` count as that.  The vectors' length is that of most different vectors (the shorter one
of a tie); others have no place in the space and get no rows, nor do vectors without entries.  A component
without variance (fewer vectors than dimensions, constant dimensions) has a null ``whitened``, explains 0 and is
left out of the identity; if none has any, ``identity_error`` is 0.  ``deviation`` is null where it exceeds a long.
Repeated rows and repeated or null ids each get their own rows; columns besides the id and the vector are not looked
at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

COMPONENTS = 16
#: How an entry becomes a whole number.
SCALE, OFFSET = 64, 1_000_000
#: Whole numbers stay within this, so that adding the offset can't overflow.
BOUND = 1 << 62
#: Vectors whose moments are taken at once.
BLOCK = 4096
#: A component has variance if its eigenvalue is above this share of the largest one, times the dimensions.
ROUNDING = np.finfo(np.float64).eps
LARGEST_LONG = (1 << 63) - 1


def whole_numbers(vector: Column) -> Column:
    """The vector as longs."""
    bound = F.lit(float(BOUND))
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, bound), -bound)).cast("long") + OFFSET)


def finite_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole and finite."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    named = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    return named.where(F.col("v").isNotNull() & ~F.exists("v", odd)).select("vec_id", whole_numbers(F.col("v")).alias("x"))


# -- moments ----------------------------------------------------------------------------------


@dataclass
class Moments:
    """Count, exact sums and centred scatter of some vectors.

    The sums of whole numbers are Python integers: they are exact, and so is the difference of two means before its
    only rounding.
    """

    n: int
    sums: list
    scatter: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def merge(self, other: Moments) -> Moments:
        """Chan's formula: the scatters add up, and so does that of the two means around their common one."""
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        between = np.outer(apart, apart) * (self.n / n * other.n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.scatter + other.scatter + between)


def moments_of(x: np.ndarray) -> Moments:
    """Of a block of whole or real numbers, a row for each vector."""
    n, exact = len(x), x.dtype == np.int64
    # Whole numbers are summed as integers: in a long where the block can't overflow it, else one by one.
    small = not exact or (n and int(np.abs(x).max()) < LARGEST_LONG // max(1, n))
    sums = x.sum(axis=0).tolist() if small else x.astype(object).sum(axis=0).tolist()
    centre = np.array([s // n if exact else s / n for s in sums])
    # Of whole numbers the nearest whole centre is taken off first, exactly; the rest of the mean is below one.
    if exact:
        rest = np.array([(s - int(c) * n) / n for s, c in zip(sums, centre, strict=True)])
        near = (x.astype(object) - centre).astype(np.float64) if not small else (x - centre.astype(np.int64)).astype(np.float64)
        local = near - rest
    else:
        local = x - centre
    return Moments(n, sums, local.T @ local)


def _vectors(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def reduce_moments(vectors: DataFrame, length: int, prepare=None) -> Moments:
    """The moments of a table (x) of vectors of one length, or of what ``prepare`` makes of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments(0, [], np.zeros((0, 0)))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                x = _vectors(batch.column("x").slice(start, BLOCK), length)
                state = state.merge(moments_of(prepare(x) if prepare else x))
        yield pa.record_batch([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    states = vectors.select("x").mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(r["state"]))
    return states.treeReduce(lambda a, b: a.merge(b))


# -- the model --------------------------------------------------------------------------------


@dataclass
class Whitening:
    """What is learnt from the different vectors: their number and sums, and the components by falling variance."""

    length: int
    n: int
    sums: list
    directions: np.ndarray  # length x components, scaled so that the whitened values have variance one; zero without variance
    varied: np.ndarray  # whether a component has variance
    explained: np.ndarray
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """The whitened values of vectors of whole numbers."""
        centre = [s // self.n for s in self.sums]
        rest = np.array([(s - c * self.n) / self.n for s, c in zip(self.sums, centre, strict=True)])
        return (_minus(x, centre) - rest) @ self.directions

    def deviations(self, x: np.ndarray) -> list:
        """The exact sums of (n * x - sums)^2, or None beyond a long."""
        if not len(x):
            return []
        # An upper bound decides whether longs suffice: |n * x - S| of each dimension, squared and summed.
        largest = max(abs(self.n * int(v) - s) for ends in (x.min(axis=0), x.max(axis=0)) for v, s in zip(ends, self.sums, strict=True))
        fits = largest * largest * self.length <= LARGEST_LONG and max(map(abs, self.sums)) <= LARGEST_LONG and self.n * int(np.abs(x).max()) <= LARGEST_LONG
        if fits:
            apart = x * self.n - np.array(self.sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = x.astype(object) * self.n - np.array(self.sums, object)
        return [int(v) if v <= LARGEST_LONG else None for v in (apart * apart).sum(axis=1)]


def _minus(x: np.ndarray, centre: list) -> np.ndarray:
    """x - centre as real numbers, exact before they become so."""
    if max(map(abs, centre)) < BOUND // 2 and (not len(x) or int(np.abs(x).max()) < BOUND // 2):
        return (x - np.array(centre, np.int64)).astype(np.float64)
    return (x.astype(object) - np.array(centre, object)).astype(np.float64)


def learn(moments: Moments, length: int, components: int = COMPONENTS) -> Whitening:
    """The components of the covariance; each one's largest entry is positive, so all runs agree on the signs."""
    covariance = moments.scatter / moments.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    kept = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[kept], vectors[:, kept]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))] < 0, -1.0, 1.0)
    varied, trace = values > max(values[0], 0.0) * length * ROUNDING, float(np.trace(covariance))
    directions = np.where(varied, vectors / np.sqrt(np.where(varied, values, 1.0)), 0.0)
    explained = np.where(varied, values / trace if trace > 0 else 0.0, 0.0)
    return Whitening(length, moments.n, moments.sums, directions, varied, explained)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learns from the different vectors of ``rows`` (vec_id, x); None without any."""
    # Equal vectors meet after each task has dropped its own repetitions, so a very common one is no hot key.
    different = staged(rows.where("size(x) > 0").select("x").distinct().select("x", F.size("x").alias("length")), "different")
    lengths = different.groupBy("length").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").head()
    if lengths is None:
        return None
    length = lengths["length"]
    vectors = different.where(F.col("length") == length)
    model = learn(reduce_moments(vectors, length), length, components)
    if model.varied.any():
        held = rows.sparkSession.sparkContext.broadcast(model)  # components x dimensions
        whitened = reduce_moments(vectors, length, lambda x: held.value.project(x)[:, held.value.varied])
        model.identity_error = float(np.abs(whitened.scatter / whitened.n - np.eye(len(whitened.scatter))).max())
    return model


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # components x dimensions
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        k = len(model.varied)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK // 4):
                part = batch.slice(start, BLOCK // 4)
                m, x = part.num_rows, _vectors(part.column("x"), model.length)
                row = pa.array(np.repeat(np.arange(m), k))
                yield pa.record_batch(
                    [
                        part.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                        pa.array(model.deviations(x), pa.int64()).take(row), pa.array(model.project(x).ravel(), mask=np.tile(~model.varied, m)),
                        pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error)),
                    ],
                    names=names,
                )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.where(F.size("x") == model.length).mapInArrow(
        run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )


def whitened_embeddings(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """All finite vectors, whitened by the components of the different ones."""
    rows = finite_vectors(embeddings, vec_id, vector)
    model = fit(rows, components)
    if model is None:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whiten(rows, model)
