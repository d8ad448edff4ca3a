"""Near copies by their word shingles: pairs with a Jaccard similarity of at least 0.8, and what they connect.

1. A text's shingles are the set of XXH64 of its runs of five words (words as in ``simhash``; a shorter
   text is one shingle).  Texts with equal sets are one node, so they never meet in pairs.
2. Candidates come from two sources: the links of the pivot tables (``simhash.links``) over five-word
   fingerprints, and an exact search, the prefix filter.  All shingles have one order (those common in
   a bounded sample last, else by hash); sets that are similar enough share one of the first
   ``n - ceil(0.8 n) + 1`` of the larger set and ``n - ceil(8 n / 9) + 1`` of the smaller one.  Any order is
   right: the sample only decides how many texts meet.
3. The texts that share such a shingle form a bucket.  First each meets one representative of the bucket
   and its range of sizes, in ``ROUNDS`` overlapping deals, so a large group of copies gives rows in
   proportion to its size.  Then all pairs of a bucket that the verified links have not yet connected meet.
   A bucket of more than ``BLOCK_ROWS`` is cut into salted blocks, and each pair of its blocks meets by itself.
   A pair is proposed only if its sizes and its sketches (the parity of the number of shingles in each of
   ``SKETCH_BITS`` classes: sets differ in at least as many shingles as sketches in bits) allow the similarity.
4. Every candidate is verified by the exact similarity of the two sets.  Before sets travel, pairs go whose numbers of
   shingles in each of some classes rule the similarity out (sets differ in at least as many shingles as these numbers
   do together); classes grow with the set, so this tells long texts apart as well, for which sketches are too short.
   The sets of a text with many candidates are dealt out in salted blocks.
5. Connected components of the verified pairs, as in ``simhash``.

Defined results: texts without words (null, empty, blank) are equal; long texts count with all their words; repeated rows and
texts with equal sets of shingles are one node and so in one component; of a component the smallest doc_id stays, a row without
an id only if no other has one, and of equal ids the smallest text key; columns besides doc_id and text are not looked at,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, join_groups, keep_one_of_each, scratch, staged, text_key
from tidemark.llm.simhash import _bits, _majority, _mixed, components, connected, links, references, text_hashes

WORDS = 5
#: Similarity as a fraction, so that no bound is rounded.
NUM, DEN = 4, 5
#: Texts sampled for common shingles, sampled texts that make one common, and the most that are kept.
SAMPLE_TEXTS, COMMON_TEXTS, COMMON_SHINGLES = 20_000, 3, 1 << 18
#: Deals of representatives before the pairs that are still unconnected.
ROUNDS = 3
#: Bits of a sketch, held in 64-bit columns.
SKETCH_BITS = 512
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
#: Shingles of a class of the counts that are compared before sets are.
PER_CLASS = 4
#: Candidates of one text that are verified in one block.
HOT_PAIRS = 256
#: Candidate pairs of a task that are held before repeated ones are dropped.
HELD_PAIRS = 1 << 20
#: Rows of a bucket that one task compares; the rows of a larger one are dealt out in blocks, each pair of which is a task's.
BLOCK_ROWS = 8192

_U = np.uint64
_SKETCHED = ", ".join(f"{c} long" for c in SKETCH)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, without repeats (a sort is faster here than the hash table of ``np.unique``)."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def shingle_set(text: bytes, votes: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """The sorted distinct shingles and the number of all; the bits of all are added to ``votes``."""
    blocks, n = [], 0
    for hashes in text_hashes(text, WORDS):
        if votes is not None:
            votes += _bits(hashes).sum(axis=0, dtype=np.int64)
        n += len(hashes)
        blocks.append(_distinct(hashes))
    if len(blocks) < 2:
        return (blocks[0] if blocks else np.zeros(0, _U)), n
    return _distinct(np.concatenate(blocks)), n


def node_of(shingles: np.ndarray) -> np.ndarray:
    """One hash for a set."""
    return _mixed(_mixed(shingles).sum(dtype=_U, keepdims=True) + _U(len(shingles)))


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each class."""
    odd = np.bincount((shingles & _U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def class_counts(shingles: np.ndarray) -> np.ndarray:
    """The number of shingles, 255 at most, in each class of equal low bits: a power of two of classes."""
    classes = 1 << max(0, (len(shingles) - 1) // PER_CLASS).bit_length()
    counts = np.bincount((shingles & _U(classes - 1)).astype(np.int64), minlength=classes)
    return np.minimum(counts, 255).astype(np.uint8)


def least_apart(x: np.ndarray, y: np.ndarray) -> int:
    """So many shingles at least stand in one of two sets alone, by their class counts."""
    classes = min(len(x), len(y))  # the more classes of the larger set are folded
    x, y = (c.reshape(-1, classes).sum(axis=0, dtype=np.int64) for c in (x, y))
    return int(np.abs(x - y).sum())


def similar(shared, a, b):
    """Whether sets of a and b shingles with so many in common are similar enough."""
    return DEN * shared >= NUM * (a + b - shared)


def prefix_lengths(n: int) -> tuple[int, int]:
    """How many of a set's first shingles are looked at against larger sets and against smaller ones."""
    least = [-(-2 * NUM * n // (NUM + DEN)), -(-NUM * n // DEN)]  # shingles in common with a set that is not smaller, not larger
    return (n - least[0] + 1, n - least[1] + 1) if n else (0, 0)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted shingles that stand in several texts of a sample; bounded, and any choice gives right results."""
    rows = docs.count()
    every = max(1, rows // SAMPLE_TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                own = [shingle_set(t.as_py() or b"")[0] for t in batch.column("text").slice(start, 256)]
                yield pa.record_batch([pa.array(np.concatenate(own).view(np.int64))], names=["key"])

    some = docs.where(F.pmod(text_key(), F.lit(every)) == 0).select(F.col("text").cast("binary").alias("text"))
    counted = some.mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= COMMON_TEXTS)
    found = counted.orderBy(F.desc("count"), "key").limit(COMMON_SHINGLES).select("key").toPandas()["key"]
    return np.sort(found.to_numpy(np.int64).view(_U))


def marked_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, fp, size, sketch columns, counts, prefix, reach): the first ``reach`` of prefix against larger sets."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))  # at most COMMON_SHINGLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                nodes, votes, counts, sizes, sketches, classes, prefixes, reach = [], [], [], [], [], [], [], []
                for text in part.column("text"):
                    bits = np.zeros(64, np.int64)
                    own, n = shingle_set(text.as_py() or b"", bits)
                    last = np.zeros(len(own), bool)
                    if len(common.value):
                        at = np.minimum(np.searchsorted(common.value, own), len(common.value) - 1)
                        last = common.value[at] == own
                    short, long = prefix_lengths(len(own))
                    nodes.append(node_of(own))
                    votes.append(bits)
                    counts.append(n)
                    sizes.append(len(own))
                    sketches.append(sketch_of(own))
                    classes.append(class_counts(own).tobytes())
                    prefixes.append(np.concatenate([own[~last], own[last]])[:long].view(np.int64))
                    reach.append(short)
                fp = _majority(np.array(votes), np.array(counts))
                offsets = np.cumsum([0, *map(len, prefixes)])
                yield pa.record_batch(
                    [
                        part.column("doc_id"), part.column("text_key"), pa.array(np.concatenate(nodes).view(np.int64)), pa.array(fp.view(np.int64)),
                        pa.array(sizes, pa.int32()), *map(pa.array, np.stack(sketches, axis=1)), pa.array(classes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(prefixes))), pa.array(reach, pa.int32()),
                    ],
                    names=["doc_id", "text_key", "node", "fp", "size", *SKETCH, "counts", "prefix", "reach"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_key().alias("text_key"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, text_key long, node long, fp long, size int, {_SKETCHED}, counts binary, prefix array<long>, reach int")


# -- candidates -------------------------------------------------------------------------------


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first one, cut only between its values."""
    held = None
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(p) for p in zip(held, new, strict=True)] if held else new
        if not len(held[0]):
            continue
        last = int(np.searchsorted(held[0], held[0][-1]))
        if last:
            yield [c[:last] for c in held]
            held = [c[last:] for c in held]
    if held and len(held[0]):
        yield held


def _partly(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """The same, but the rows of a key beyond ``most`` come piece by piece, with True: no task holds a large bucket."""
    held, cut = None, None
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(p) for p in zip(held, new, strict=True)] if held else new
        if cut is not None:
            more = int(np.searchsorted(held[0], cut, "right"))
            if more:
                yield [c[:more] for c in held], True
                held = [c[more:] for c in held]
            if len(held[0]):
                cut = None
        if not len(held[0]):
            continue
        last = int(np.searchsorted(held[0], held[0][-1]))
        if last:
            yield [c[:last] for c in held], False
            held = [c[last:] for c in held]
        if len(held[0]) > most:
            cut = held[0][-1]
            yield held, True
            held = [c[:0] for c in held]
    if held and len(held[0]):
        yield held, False


def _by_size(key: np.ndarray, node: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, sorted by key, in the order of key and size, and for each where the sets of its key get too large for it."""
    order = np.lexsort((node, size, key))
    bucket = np.cumsum(np.r_[False, key[1:] != key[:-1]]) << 32
    sizes = size[order].astype(np.int64)
    return order, np.searchsorted(bucket | sizes, bucket | (DEN * sizes // NUM), side="right")


def _have_partners(key: np.ndarray, node: np.ndarray, size: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """Which rows can be in a pair: those that lead and have larger sets in reach, and the rows of these sets."""
    order, stop = _by_size(key, node, size)
    at = np.flatnonzero(leads[order] & (stop > np.arange(len(key)) + 1))
    reached = np.cumsum(np.bincount(at, minlength=len(key) + 1) - np.bincount(stop[at], minlength=len(key) + 1))[:-1] > 0
    found = np.empty(len(key), bool)
    found[order] = reached
    return found


def buckets(marked: DataFrame) -> DataFrame:
    """(key, node, size, leads, sketch columns) of the nodes that share a shingle of their prefixes with one of a similar size."""
    most = BLOCK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, cut in _partly(batches, most):
            key, node = columns[:2]
            first = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            columns = [c[first] for c in columns]
            found = np.ones(len(columns[0]), bool) if cut else _have_partners(*columns)
            yield pa.record_batch([pa.array(c[found]) for c in columns], names=["key", "node", "size", "leads"])

    rows = marked.select("node", "size", "reach", F.posexplode("prefix").alias("at", "key"))
    rows = rows.select("key", "node", "size", (F.col("at") < F.col("reach")).alias("leads"))
    met = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long, size int, leads boolean")
    return met.join(marked.select("node", *SKETCH).dropDuplicates(["node"]), "node").select("key", "node", "size", "leads", *SKETCH)


def _may_be_similar(node, size, leads, sketch, a, b) -> np.ndarray:
    """Which pairs (a, b) of rows a bucket proposes: sizes and sketches near enough, its shingle early enough in the smaller set."""
    a_first = (size[a] < size[b]) | ((size[a] == size[b]) & (node[a] < node[b]))
    small, large = np.where(a_first, a, b), np.where(a_first, b, a)
    good = np.flatnonzero((node[a] != node[b]) & leads[small] & (DEN * size[small].astype(np.int64) >= NUM * size[large].astype(np.int64)))
    apart = np.zeros(len(good), np.int64)
    for part in sketch:
        apart += np.bitwise_count(part[a[good]] ^ part[b[good]])
    return good[(DEN + NUM) * apart <= (DEN - NUM) * (size[a[good]].astype(np.int64) + size[b[good]])]


def _pairs(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Distinct (a, b), a < b, of what a task proposes, in bounded pieces."""
    held, n = [], 0

    def settle():
        both = np.unique(np.concatenate(held, axis=1), axis=1)
        return pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    for a, b in parts:
        if len(a):
            held.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            n += len(a)
            if n > HELD_PAIRS:
                yield settle()
                held, n = [], 0
    if held:
        yield settle()


def large_buckets(shared: DataFrame) -> DataFrame:
    """(key, blocks) of the buckets of more than ``BLOCK_ROWS`` rows, staged."""
    counts = shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS)
    return staged(counts.select("key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "large_buckets")


def _block(blocks: str = "blocks"):
    return F.pmod(F.xxhash64("node", F.lit(17)), F.col(blocks)).cast("int")


def in_blocks(shared: DataFrame, large: DataFrame) -> DataFrame:
    """``shared`` with a key of its own for each block of a large bucket."""
    if large.isEmpty():
        return shared
    named = shared.join(broadcast_if_small(large), "key", "left")
    return named.withColumn("key", F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", _block()))).drop("blocks")


def in_pairs_of_blocks(rows: DataFrame, large: DataFrame) -> DataFrame:
    """``rows`` with a key of its own for each two blocks of a large bucket, and the ``side`` on which a row's block stands.

    Rows of a small bucket, and those that meet their own block, have no side (0): they meet each other.
    """
    rows = rows.withColumn("side", F.lit(0))
    if large.isEmpty():
        return rows
    named = rows.join(broadcast_if_small(large), "key", "left").withColumn("own", _block())
    small = named.where("blocks is null").drop("blocks", "own")
    met = named.where("blocks is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") < F.col("other"), 1).when(F.col("own") > F.col("other"), 2).otherwise(0)
    return small.unionByName(met.withColumns({"key": pair, "side": side}).drop("blocks", "own", "other"))


def represented(shared: DataFrame) -> DataFrame:
    """(a, b): each row of a bucket with the representative of its range of sizes, in ``ROUNDS`` overlapping deals."""

    def propose(batches):
        for key, node, size, leads, *sketch in _whole_buckets(batches):
            sketch = [part.view(_U) for part in sketch]
            for deal, salt in enumerate(references(ROUNDS, 5)):
                range_ = np.floor(np.log(size) / np.log(DEN / NUM) + deal / ROUNDS).astype(np.int64)
                order = np.lexsort((_mixed(node.view(_U) ^ salt), range_, key))
                starts = np.r_[True, (key[order][1:] != key[order][:-1]) | (range_[order][1:] != range_[order][:-1])]
                centre = order[np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))]
                good = _may_be_similar(node, size, leads, sketch, order, centre)
                yield node[order[good]], node[centre[good]]

    dealt = shared.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(lambda batches: _pairs(propose(batches)), "a long, b long").distinct()


def _largest_parts(key: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which rows, sorted by key, belong to the root of most rows of their key."""
    order = np.lexsort((root, key))
    k, r = key[order], root[order]
    runs = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
    rows = np.diff(np.r_[runs, len(k)])
    firsts = np.flatnonzero(np.r_[True, k[runs][1:] != k[runs][:-1]])
    chosen = np.zeros(len(runs), bool)
    chosen[np.maximum.reduceat(rows * len(runs) + np.arange(len(runs)), firsts) % len(runs)] = True
    largest = np.empty(len(key), bool)
    largest[order] = np.repeat(chosen, rows)
    return largest


def _ranges(at: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of ``at`` with all numbers of its range, about ``HELD_PAIRS`` pairs at a time."""
    some = start < stop
    at, start, n = at[some], start[some], (stop - start)[some]
    ends = np.cumsum(n)
    cuts = np.flatnonzero(np.diff(ends // HELD_PAIRS)) + 1
    for first, last in zip(np.r_[0, cuts], np.r_[cuts, len(n)], strict=True):
        m = n[first:last]
        if len(m):
            skipped = np.repeat(start[first:last] - (np.cumsum(m) - m), m)
            yield np.repeat(at[first:last], m), np.arange(len(skipped)) + skipped


def _meetings(key: np.ndarray, node: np.ndarray, size: np.ndarray, leads: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one key and different roots, the smaller set first, as far as sizes and leads allow them.

    The rows of a key's largest root meet only the others, so connected copies cost nothing.
    """
    order, stop = _by_size(key, node, size)
    root, largest = root[order], _largest_parts(key, root)[order]
    rest, small = np.flatnonzero(~largest), leads[order]
    others, own = np.flatnonzero(small & ~largest), np.flatnonzero(small & largest)
    for a, b in _ranges(others, others + 1, stop[others]):
        apart = root[a] != root[b]
        yield order[a[apart]], order[b[apart]]
    for a, b in _ranges(own, np.searchsorted(rest, own), np.searchsorted(rest, stop[own])):
        yield order[a], order[rest[b]]


def unconnected(shared: DataFrame, roots: DataFrame, large: DataFrame) -> DataFrame:
    """(a, b): all pairs of a bucket that ``roots`` (node, root) does not connect."""

    def propose(batches):
        for key, node, size, leads, side, root, *sketch in _whole_buckets(batches):
            sketch = [part.view(_U) for part in sketch]
            for a, b in _meetings(key, node, size, leads, root):
                across = (side[a] != side[b]) | (side[a] == 0)  # rows of one side meet in their own block's task
                a, b = a[across], b[across]
                good = _may_be_similar(node, size, leads, sketch, a, b)
                yield node[a[good]], node[b[good]]

    named = in_pairs_of_blocks(shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), large).select("key", "node", "size", "leads", "side", "root", *SKETCH)
    dealt = named.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(lambda batches: _pairs(propose(batches)), "a long, b long").distinct()


# -- verification -----------------------------------------------------------------------------


def end_blocks(pairs: DataFrame) -> DataFrame:
    """(node, blocks) of the nodes in ``pairs``, staged: in how many blocks the pairs of each are dealt out."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    return staged(ends.select("node", F.ceil(F.col("count") / HOT_PAIRS).cast("int").alias("blocks")), "blocks")


def with_both(pairs: DataFrame, held: DataFrame, blocks: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with what the staged ``held`` (node, held) has of a as x and of b as y."""
    held = held.join(broadcast_if_small(blocks), "node").select("node", "held", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    hot = broadcast_if_small(staged(blocks.where("blocks > 1"), "hot"))
    for end, other in (("a", "b"), ("b", "a")):
        pairs = pairs.join(hot.select(F.col("node").alias(end), F.col("blocks").alias(f"{end}_blocks")), end, "left")
        pairs = pairs.withColumn(f"{end}_block", F.pmod(F.xxhash64(other), F.coalesce(f"{end}_blocks", F.lit(1))).cast("int")).drop(f"{end}_blocks")
    for end, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(held.select(F.col("node").alias(end), F.col("block").alias(f"{end}_block"), F.col("held").alias(name)), [end, f"{end}_block"])
    return pairs.select("a", "b", "x", "y")


def plausible(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The (a, b) of the staged ``pairs`` of nodes whose class counts allow the similarity, staged."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                (n, x), (m, y) = ((end["size"].as_py(), np.frombuffer(end["counts"].as_buffer(), np.uint8)) for end in (x, y))
                good.append((DEN + NUM) * least_apart(x, y) <= (DEN - NUM) * (n + m))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    blocks = end_blocks(pairs)
    ends = marked.join(broadcast_if_small(blocks.select("node")), "node", "left_semi")
    counts = staged(ends.groupBy("node").agg(F.any_value(F.struct("size", "counts")).alias("held")), "counts")
    return staged(with_both(pairs, counts, blocks).mapInArrow(compare, "a long, b long"), "plausible")


def verified(pairs: DataFrame, marked: DataFrame, docs: DataFrame) -> DataFrame:
    """The (a, b) of the staged ``pairs`` of nodes whose sets are similar enough."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                own = [shingle_set(t.as_py() or b"")[0] for t in batch.column("text").slice(start, 256)]
                nodes = np.concatenate([node_of(s) for s in own]).view(np.int64)
                yield pa.record_batch([pa.array(nodes), pa.array([s.tobytes() for s in own], pa.binary())], names=["node", "held"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                good.append(similar(int((both[1:] == both[:-1]).sum()), len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = plausible(pairs, marked)
    blocks = end_blocks(pairs)
    one_text = marked.join(broadcast_if_small(blocks.select("node")), "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("_key"))
    keys = broadcast_if_small(staged(one_text.select("_key").distinct(), "texts"))
    texts = docs.select(text_key().alias("_key"), F.col("text").cast("binary").alias("text")).join(keys, "_key", "left_semi").select("text")
    held = texts.mapInArrow(sets, "node long, held binary")
    # Sets are large: they are told apart by a shuffle of their own only if some text stands in several rows.
    if marked.select(F.col("text_key").alias("_key")).join(keys, "_key", "left_semi").count() > blocks.count():
        held = held.dropDuplicates(["node"])
    return with_both(pairs, staged(held, "sets"), blocks).mapInArrow(verify, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key, root, component_id (the smallest doc_id that near copies reach).

    The result is stored; all tables on the way to it are removed as soon as nothing needs them.
    """
    spark = docs.sparkSession
    with scratch(spark):
        marked = staged(marked_texts(docs), "marked")
        shared = staged(buckets(marked), "buckets")
        large = large_buckets(shared)

        with scratch(spark):
            by_fp = marked.groupBy("fp").agg(F.min("node").alias("centre"))
            nodes = staged(by_fp, "nodes")
            tied = marked.select("fp", "node").join(nodes, "fp").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
            near = links(nodes).join(nodes.select(F.col("fp").alias("a"), F.col("centre").alias("na")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("centre").alias("nb")), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
            pivots = tied.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            first = staged(represented(in_blocks(shared, large)).unionByName(pivots).distinct(), "first_pairs", keep=True)
        roots = _connected_by(first, marked, docs)
        rest = staged(unconnected(shared, roots, large), "rest_pairs")
        if not rest.isEmpty():
            roots = _connected_by(rest, marked, docs, roots)

        of_node = staged(marked.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "of_node")
        by_node = staged(components(of_node, roots, "node"), "components")
        found = join_groups(marked.select("doc_id", "text_key", "node"), by_node, "node")
        return staged(found.select("doc_id", "text_key", "root", "component_id"), "near_copies", keep=True)


def _connected_by(pairs: DataFrame, marked: DataFrame, docs: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(node, root) of what the verified pairs connect, together with ``roots``; the sets that verify them are not kept."""
    with scratch(docs.sparkSession):
        good = verified(pairs, marked, docs)
        return staged(connected(good if roots is None else roots.toDF("a", "b").unionByName(good)), "roots", keep=True)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, one without any only if no other has one."""
    return keep_one_of_each(docs, near_copies(docs))
