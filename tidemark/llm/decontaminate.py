"""Benchmark decontamination by SimHash windows of an item's size.

1. Words are lower-cased (A-Z), stripped of ASCII punctuation and split at ASCII white space; shingles
   are five words (all words of a shorter item).
2. A window of an item's number of words gets the bitwise majority of its shingle hashes as a
   fingerprint; prefix sums of the votes give all windows of a text at once.  A window without any
   shingle of an item has similarity zero with it, so only windows around shared shingles are formed.
   A text with fewer words than an item is one window, if its length allows the similarity.
3. A multi-index over the items' fingerprints (eight blocks of eight bits; within radius 22 at least
   one block differs in at most two bits) yields all items within the radius: no loss, no scan.
4. Candidates are verified by exact weighted-shingle similarity: shared multiplicity over total
   multiplicity, at least 0.8.

The benchmark is indexed in blocks of bounded size, each broadcast; every document meets every block,
several in one pass, so the documents are never shuffled.  Defined results: null or wordless texts and items
match nothing; repeated items count once; of an item's windows with the same distance the first counts; repeated
documents give repeated rows; long texts are taken in overlapping parts; further columns are not looked at,
whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from tidemark.llm.simhash import _bits, _majority, _mixed

WORDS, SIMILARITY, RADIUS = 5, 0.8, 22
BLOCKS, BLOCK_BITS = 8, 8
#: UTF-8 bytes of the items in one block, and blocks that meet the documents in one pass over them.  Besides its shingles
#: (about its text's size) an item stands in about 300 lists of the multi-index (2.4 KB): some 35 MB a block of 300-byte items.
ITEM_BYTES, BLOCKS_A_PASS = 4 << 20, 4
#: Words of a text that are looked at together; blocks overlap by the longest item.
TEXT_WORDS = 1 << 18

_U = np.uint64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def word_hashes(text: bytes) -> np.ndarray:
    words = text.translate(_LOWER, _PUNCTUATION).split()
    return np.fromiter(map(xxh64_intdigest, words, repeat(7)), _U, len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0 or not size:
        return np.zeros(0, _U)
    h = words[:n].copy()
    for k in range(1, size):
        h *= _U(0x9E3779B97F4A7C15)
        h += words[k : k + n]
    return _mixed(h)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    values, side = np.unique(np.concatenate([a, b]), return_inverse=True)
    in_a, in_b = np.bincount(side[: len(a)], minlength=len(values)), np.bincount(side[len(a) :], minlength=len(values))
    return float(np.minimum(in_a, in_b).sum() / np.maximum(in_a, in_b).sum())


class MultiIndex:
    """Fingerprints by the values of their blocks and all values within the block's share of the radius."""

    _NEAR = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)) <= RADIUS // BLOCKS

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        blocks = fps.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        self.found = [[np.flatnonzero(self._NEAR[v, blocks[:, b]]) for v in range(256)] for b in range(BLOCKS)]

    def within(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, distance) of all pairs within the radius."""
        pairs = [np.zeros(0, np.int64)]
        for b, values in enumerate(fps.astype("<u8").view(np.uint8).reshape(-1, BLOCKS).T):
            for v in np.unique(values):
                if len(items := self.found[b][v]):
                    pairs.append((np.flatnonzero(values == v)[:, None] * len(self.fps) + items).ravel())
        query, item = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.fps)))
        distance = np.bitwise_count(fps[query] ^ self.fps[item])
        near = distance <= RADIUS
        return query[near], item[near], distance[near]


class Items:
    """One block of benchmark items."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids, self.words, self.shingles = [], [], []
        for item_id, text in items:
            words = word_hashes((text or "").encode())
            if len(words):
                self.ids.append(item_id)
                self.words.append(len(words))
                self.shingles.append(shingle_hashes(words, min(WORDS, len(words))))
        #: by shingle size: all items' shingles in order, the item of each, a bitmap of their top bits
        self.known = {}
        for size in {min(WORDS, n) for n in self.words}:
            own = [i for i, n in enumerate(self.words) if min(WORDS, n) == size]
            hashes = np.concatenate([self.shingles[i] for i in own])
            owner = np.repeat(own, [len(self.shingles[i]) for i in own])
            order = np.argsort(hashes)
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(hashes >> _U(44)).astype(np.int64)] = True
            self.known[size] = hashes[order], owner[order], bitmap
        self.index, self.of_length = {}, {}
        for n in set(self.words):
            own = np.array([i for i, m in enumerate(self.words) if m == n])
            fps = np.concatenate([_majority(_bits(self.shingles[i]).sum(axis=0, dtype=np.int64)[None, :], np.array([len(self.shingles[i])])) for i in own])
            self.index[n], self.of_length[n] = MultiIndex(fps), own

    def matches(self, words: np.ndarray) -> list[tuple[object, float, int, int, int]]:
        """(item id, similarity, distance, first word, words) of each item found in a text of these words, at its closest window."""
        best: dict[int, tuple] = {}
        overlap = max(self.words, default=0)
        for start in range(0, max(1, len(words)), TEXT_WORDS):
            block = words[start : start + TEXT_WORDS + overlap]
            for size, (known, owner, bitmap) in self.known.items():
                hashes = shingle_hashes(block, size)
                hit = np.flatnonzero(bitmap[(hashes >> _U(44)).astype(np.int64)])
                if len(hit):
                    left = np.searchsorted(known, hashes[hit])
                    right = np.searchsorted(known, hashes[hit], "right")
                    hit, left, right = hit[left < right], left[left < right], right[left < right]
                if not len(hit):
                    continue
                items = np.unique(np.concatenate([owner[a:b] for a, b in zip(left, right, strict=True)]))
                for n in np.unique([self.words[i] for i in items]):
                    for found in self._windows(hashes, hit, int(n), int(n) - size + 1, len(words) < n):
                        item, distance, at, score = found
                        if item not in best or (distance, start + at) < (best[item][2], best[item][3]):
                            best[item] = (self.ids[item], score, distance, start + at, min(int(n), len(words)))
        return [best[i] for i in sorted(best)]

    def _windows(self, hashes: np.ndarray, hit: np.ndarray, n: int, shingles: int, whole: bool) -> Iterator[tuple[int, int, int, float]]:
        """(item, distance, first word, similarity) for the items of n words, from the windows around hits; ``whole``: the text is shorter."""
        last = len(hashes) - shingles
        if last < 0:
            if not whole or len(hashes) / shingles < SIMILARITY:
                return
            shingles, last = len(hashes), 0
        edges = np.zeros(last + 2, np.int64)
        np.add.at(edges, np.clip(hit - shingles + 1, 0, last + 1), 1)
        np.add.at(edges, np.minimum(hit + 1, last + 1), -1)
        starts = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        index, own, done = self.index[n], self.of_length[n], set()
        for cut in range(0, len(starts), 4096):
            some = starts[cut : cut + 4096]
            low = int(some[0])
            votes = np.zeros((int(some[-1]) - low + shingles + 1, 64), np.int32)
            np.cumsum(_bits(hashes[low : low + len(votes) - 1]), axis=0, out=votes[1:])
            fps = _majority(votes[some - low + shingles] - votes[some - low], np.full(len(some), shingles))
            query, item, distance = index.within(fps)
            for k in np.lexsort((some[query], distance)):
                i, at = int(own[item[k]]), int(some[query[k]])
                if i not in done and (score := similarity(hashes[at : at + shingles], self.shingles[i])) >= SIMILARITY:
                    done.add(i)
                    yield i, int(distance[k]), at, score


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of bounded size; one block unless its measured bytes exceed ``ITEM_BYTES``."""
    items = benchmark.select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // ITEM_BYTES)
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield Items([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()])


def passes(spark: SparkSession, benchmark: DataFrame) -> Iterator[list[Broadcast]]:
    """Broadcast blocks, as many as meet the documents together."""
    blocks = item_blocks(benchmark)
    while some := [spark.sparkContext.broadcast(items) for items in islice(blocks, BLOCKS_A_PASS)]:  # bounded by ITEM_BYTES of text each
        yield some


def _found(some: list[Broadcast], text: bytes) -> Iterator[tuple]:
    words = word_hashes(text)
    for items in some:
        yield from items.value.matches(words)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, hamming, first_word, n_words): a row for each document and item in it."""
    spark = docs.sparkSession
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, hamming int, first_word long, n_words int"
    out = spark.createDataFrame([], schema)
    for some in passes(spark, benchmark):

        def run(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, found = [], []
                for i, text in enumerate(batch.column("text")):
                    for match in _found(some, text.as_py() or b""):
                        rows.append(i)
                        found.append(match)
                ids, score, distance, at, n = zip(*found, strict=True) if found else ((),) * 5
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(ids, item_type), pa.array(score, pa.float64()), pa.array(distance, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int32())],
                    names=["doc_id", "item_id", "similarity", "hamming", "first_word", "n_words"],
                )

        out = out.unionByName(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; decided where each row is."""
    for some in passes(docs.sparkSession, benchmark):

        def run(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not any(True for _ in _found(some, (text.as_py() or "").encode())) for text in batch.column("text")]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
