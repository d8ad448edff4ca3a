"""SimHash near-dedup with pivot distance tables.

1. A document's fingerprint is the bitwise majority of the XXH64 of its word shingles.  Equal
   fingerprints collapse to one node, so copies never meet in pairs.
2. Pivot tables.  The 64 bits fall into six groups; two fingerprints within 3 bits agree on at least
   three whole groups.  For each of the 20 choices of three groups a table holds the Hamming distances
   to reference fingerprints restricted to these groups.  A pair within the radius has the same row in
   at least one table, so a shuffle on the table's row brings all such pairs together and discards
   every pair whose largest coordinate difference is not zero in all tables.
3. In such a bucket a table of distances to full-width reference fingerprints is made; by the triangle
   inequality a pair whose largest coordinate difference exceeds 3 is discarded.  Survivors are
   verified by their exact Hamming distance.
4. A bucket gives the star of each of its connected parts (at most a row for each member), never its
   pairs.  Buckets beyond ``HOT_BUCKET`` fingerprints are not compared in place: they are dealt out
   again on three of six groups of their free bits, which bounds a bucket by 2 ** 16 fingerprints.
5. Connected components by alternating large-star and small-star rounds on the shared folder.

Defined results: a null text is an empty one; texts without words have fingerprint zero and link like
any other; a null ``doc_id`` never names a component unless all its members have none; repeated rows
fall into the same component; long texts count with all their words; a bit that exactly half the hashes have set is zero;
columns besides doc_id and text are not looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import join_groups, keep_one_of_each, staged, text_key

WORDS, SEED, RADIUS = 3, 42, 3
#: Bit groups; RADIUS of them can differ, so GROUPS - RADIUS agree.
GROUPS = 6
#: Reference fingerprints of a table of step 2 and of the table of step 3.
BAND_PIVOTS, WIDE_PIVOTS = 20, 16
#: Distinct fingerprints of one bucket that are compared in place.
HOT_BUCKET = 2048
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16
#: Edges of a task that are contracted at a time.
HELD_EDGES = 1 << 20

_U = np.uint64


# -- fingerprints -----------------------------------------------------------------------------


def text_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles in order, in blocks; A-Z lower-cased, words split at ASCII white space."""
    w = text.lower().split()
    if not w:
        return
    if len(w) < words:
        yield np.array([xxh64_intdigest(b" ".join(w), seed)], _U)
        return
    n = len(w) - words + 1
    for start in range(0, n, BLOCK):
        stop = min(n, start + BLOCK)
        shingles = map(b" ".join, zip(*(w[start + i : stop + i] for i in range(words)), strict=True))
        yield np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), _U, stop - start)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.packbits(2 * votes > counts[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(_U)


def fingerprint_texts(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """A fingerprint (unsigned) for each text."""
    votes, counts = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    waiting, size = [], 0

    def count() -> None:
        owners = [i for i, _ in waiting]
        starts = np.cumsum([0] + [len(h) for _, h in waiting[:-1]])
        sums = np.add.reduceat(_bits(np.concatenate([h for _, h in waiting])), starts, axis=0, dtype=np.int32)
        np.add.at(votes, owners, sums)
        np.add.at(counts, owners, [len(h) for _, h in waiting])

    for i, text in enumerate(texts):
        for hashes in text_hashes(text, words):
            waiting.append((i, hashes))
            size += len(hashes)
            if size >= BLOCK:
                count()
                waiting, size = [], 0
    if waiting:
        count()
    return _majority(votes, counts)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [t or b"" for t in part.column("text").to_pylist()]
                fp = fingerprint_texts(texts, words).view(np.int64)
                yield pa.record_batch([part.column("doc_id"), part.column("text_key"), pa.array(fp)], names=["doc_id", "text_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_key().alias("text_key"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


# -- pivot tables -----------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def references(n: int, salt: int) -> np.ndarray:
    """n pseudo-random reference fingerprints, the same everywhere."""
    return _mixed(_U(0x9E3779B97F4A7C15) * np.arange(1, n + 1, dtype=_U) + _U(salt))


def _choices(bits: list[int]) -> list[int]:
    """Masks of all choices of GROUPS - RADIUS of the GROUPS groups of these bits."""
    groups = np.array_split(np.array(bits), GROUPS)
    return [sum(1 << int(b) for g in chosen for b in g) for chosen in combinations(groups, GROUPS - RADIUS)]


BANDS = _choices(list(range(64)))


def table_rows(fps: np.ndarray, band: int) -> np.ndarray:
    """Key of each fingerprint's row in the band's pivot table: its distances to the references there."""
    mask, key = _U(BANDS[band]), np.full(len(fps), _U(band + 1))
    for r in references(BAND_PIVOTS, band + 1):
        key = key * _U(0x100000001B3) + np.bitwise_count((fps ^ r) & mask).astype(_U)
    return _mixed(key)


def _linked(fps: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which pairs survive the pivot filter and are within the radius."""
    near = np.flatnonzero((np.abs(table[a] - table[b]) <= RADIUS).all(axis=1))
    return near[np.bitwise_count(fps[a[near]] ^ fps[b[near]]) <= RADIUS]


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each node's connected part."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(label, np.maximum(la, lb), low)
        while (label != label[label]).any():
            label = label[label]


def _stars(fps: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, centre) for the connected parts within each of the consecutive buckets."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    table = np.stack([np.bitwise_count(fps ^ r) for r in references(WIDE_PIVOTS, 99)], axis=1).astype(np.int8)
    label, at, kept_a, kept_b, n = np.arange(len(fps)), np.arange(len(fps)), [], [], 0
    for d in range(1, int(sizes.max(initial=1))):
        at = at[at + d < ends[at]]
        good = at[_linked(fps, at, at + d, table)]
        kept_a.append(good)
        kept_b.append(good + d)
        n += len(good)
        if n > BLOCK:
            label = _roots(len(fps), np.concatenate(kept_a), np.concatenate(kept_b), label)
            kept_a, kept_b, n = [], [], 0
    if n:
        label = _roots(len(fps), np.concatenate(kept_a), np.concatenate(kept_b), label)
    member = np.flatnonzero(label != np.arange(len(fps)))
    return fps[member], fps[label[member]]


def _cube_stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one bucket of many fingerprints that differ in few bits: looks up all neighbours."""
    bits = [b for b in range(64) if int(np.bitwise_or.reduce(fps ^ fps[0])) >> b & 1]
    code = np.zeros(len(fps), np.int64)
    for i, b in enumerate(bits):
        code |= ((fps >> _U(b)) & _U(1)).astype(np.int64) << i
    there = np.full(1 << len(bits), -1)
    there[code] = np.arange(len(fps))
    label = np.arange(len(fps))
    for r in range(1, RADIUS + 1):
        for flips in combinations(range(len(bits)), r):
            other = there[code ^ sum(1 << f for f in flips)]
            a = np.flatnonzero(other >= 0)
            label = _roots(len(fps), a, other[a], label)
    member = np.flatnonzero(label != np.arange(len(fps)))
    return fps[member], fps[label[member]]


def _buckets(batches: Iterator[pa.RecordBatch], hot: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> stars of each bucket; the rows of hot buckets pass unchanged."""

    def emit(a, b, key=None):
        return pa.record_batch(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(key if key is not None else np.zeros(len(a), np.int64)), pa.array(np.full(len(a), key is not None))],
            names=["a", "b", "key", "hot"],
        )

    def settle(keys, fps):
        if not len(keys):
            return
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        size = np.repeat(sizes, sizes)
        limit = HOT_BUCKET if hot is None else hot
        few = (size > 1) & (size <= limit)
        if few.any():
            yield emit(*_stars(fps[few], sizes[(sizes > 1) & (sizes <= limit)]))
        for s, n in zip(starts[sizes > limit], sizes[sizes > limit], strict=True):
            if hot is None:
                yield emit(*_cube_stars(fps[s : s + n]))
            else:
                yield emit(fps[s : s + n], fps[s : s + n], keys[s : s + n])

    keys, fps, passing = np.zeros(0, np.int64), np.zeros(0, _U), None
    for batch in batches:
        k = batch.column("key").to_numpy(zero_copy_only=False)
        f = batch.column("fp").to_numpy(zero_copy_only=False).view(_U)
        if passing is not None:  # the rest of a hot bucket whose first rows have passed
            n = int(np.searchsorted(k != passing, True)) if (k != passing).any() else len(k)
            yield emit(f[:n], f[:n], k[:n])
            k, f = k[n:], f[n:]
            if not len(k):
                continue
            passing = None
        keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
        if not len(keys):
            continue
        last = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])
        yield from settle(keys[:last], fps[:last])
        keys, fps = keys[last:], fps[last:]
        if hot is not None and len(keys) > hot:
            passing = keys[0]
            yield emit(fps, fps, keys)
            keys, fps = keys[:0], fps[:0]
    yield from settle(keys, fps)


def links(nodes: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b): pairs of linked fingerprints that span every connected part of the distinct ``fp`` of ``nodes``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(_U)
            for band in range(len(BANDS)):
                yield pa.record_batch([pa.array(table_rows(fps, band).view(np.int64)), pa.array(fps.view(np.int64))], names=["key", "fp"])

    def deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("a").to_numpy(zero_copy_only=False).view(_U)
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(_U)
            for band, mask in enumerate(BANDS):
                own = fps[table_rows(fps, band) == keys]
                for sub in _choices([b for b in range(64) if not mask >> b & 1]):
                    # the bits themselves: whatever shares a bucket differs in at most 16 places
                    held = _mixed((own & _U(mask | sub)) ^ _mixed(np.full(len(own), _U(mask | sub))))
                    yield pa.record_batch([pa.array(held.view(np.int64)), pa.array(own.view(np.int64))], names=["key", "fp"])

    out = "a long, b long, key long, hot boolean"

    def compared(dealt: DataFrame, hot: int | None) -> DataFrame:
        return dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lambda batches: _buckets(batches, hot), out)

    found = staged(compared(nodes.select("fp").mapInArrow(deal, "key long, fp long"), hot_bucket), "links")
    hot = found.where("hot").select("a", "key")
    cold = found.where("not hot").select("a", "b")
    if hot.isEmpty():
        return cold.distinct()
    again = compared(hot.mapInArrow(deal_again, "key long, fp long").distinct(), None).select("a", "b")
    return cold.unionByName(again).distinct()


# -- components -------------------------------------------------------------------------------


def _contracted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) that a task holds as the stars (a, smallest) of their connected parts, ``most`` at a time."""

    def settle(held: list[np.ndarray]) -> pa.RecordBatch:
        nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        a, b = ends.reshape(2, -1)
        label = _roots(len(nodes), a, b)
        member = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.record_batch([pa.array(nodes[member]), pa.array(nodes[label[member]])], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]))
        n += batch.num_rows
        if n >= most:
            yield settle(held)
            held, n = [], 0
    if n:
        yield settle(held)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected part, for the nodes that have an edge (a, b).

    Each task first replaces the edges that it holds by stars; the rounds join the stars of different tasks and end
    once every node has one root and no root has another.
    """

    def nearest(directed: DataFrame) -> DataFrame:
        """u, v and the smallest of u and all its v."""
        low = directed.groupBy("u").agg(F.min("v").alias("m"))
        return directed.join(low, "u").select("u", "v", F.least("u", "m").alias("m"))

    def large_star(stars: DataFrame) -> DataFrame:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        return nearest(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small_star(stars: DataFrame) -> DataFrame:
        down = stars.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        near = nearest(down)
        own = near.select(F.col("u").alias("a"), F.col("m").alias("b"))
        return near.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own).where("a <> b").distinct()

    def settled(stars: DataFrame) -> bool:
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
        of_node = stars.select(ends.alias("end")).groupBy("end.node").agg(F.sum("end.up").alias("ups"), F.max("end.down").alias("down"))
        return not of_node.agg(F.bool_or((F.col("ups") > 1) | (F.col("ups") + F.col("down") > 1))).first()[0]

    stars = staged(edges.mapInArrow(lambda batches: _contracted(batches, HELD_EDGES), "a long, b long").distinct(), "edges")
    while not settled(stars):
        stars = staged(small_star(large_star(stars)), "stars")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """(node, n, root, component_id) of nodes (node, n, first_id): the smallest first_id of the nodes of a root."""
    rooted = staged(nodes.join(roots, node, "left").select(node, "n", "first_id", F.coalesce("root", node).alias("root")), "rooted")
    named = staged(rooted.groupBy("root").agg(F.count("*").alias("nodes"), F.min("first_id").alias("component_id")), "named")
    return join_groups(rooted.drop("first_id"), named, "root", "nodes").select(node, "n", "root", "component_id")


def near_duplicates(docs: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row per document: doc_id, text_key, fp, root, component_id (the smallest doc_id that links reach).

    ``root`` names the component by a fingerprint, so components without any id stay apart.
    """
    marked = staged(fingerprints(docs), "fingerprints")
    nodes = staged(marked.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "nodes")
    roots = connected(links(nodes, hot_bucket)).withColumnRenamed("node", "fp")
    by_fp = staged(components(nodes, roots, "fp"), "components")
    return join_groups(marked, by_fp, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, one without any only if no other has one."""
    return keep_one_of_each(docs, near_duplicates(docs))
