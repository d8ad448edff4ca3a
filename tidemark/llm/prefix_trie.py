"""The prefix trie of conversations: which first turns are shared, by how many, and what sharing them would save.

Conversations are rebuilt first: of ``FAMILY`` neighbouring identifiers each takes its first turns from the family's
first one.  Families are dealt out whole and sorted, so one streaming pass rebuilds them, and numpy scans give every
prefix a polynomial fingerprint: a batch of turns at a time, by powers and cumulative sums.

Prefixes of one depth and fingerprint are a candidate group.  It is verified turn by turn: all members must have the
turn of its representative (the smallest identifier) at this depth, compared by the 128 first bits of its
SHA-256, and must have come from the representative's group one turn before, which was verified in the same way.
Members that differ are split off, with all their longer prefixes, and grouped again, until nothing differs.

Nothing climbs the trie level by level.  A node's representative represents the rest of its own branch too, so
what a node's subtree sums up is a running sum along each member's own prefixes, added up by node: one window by
conversation and one aggregate, which each task combines first.

Defined results: rows without a conv_id belong to no conversation and are left out; turns stand by ``turn`` (null first),
those of one number by the digest of role and text; a null role or text is empty; repeated rows are turns of their
own; long texts are read whole and long conversations scanned piece by piece; columns besides the four are not looked at,
whatever their names; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, broadcast_if_small, join_groups, staged

#: So many neighbouring identifiers share first turns, fewer than so many of them.
FAMILY, SHARED = 20, 4
#: Moduli (primes below 2^31) and bases of the two polynomials that make a fingerprint.
MODULI, BASES = (2_147_483_647, 2_147_483_629), (911_382_323, 972_663_749)
#: Identifiers that end at one node are joined in pieces of at most so many before they meet.
PIECE_BITS = 10

NODE = ["depth", "fp", "split"]
_PREFIX = "conv_id long, depth long, fp long, parent_fp long, d0 long, d1 long, words long, last boolean"


# -- turns, rebuilt and fingerprinted ---------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """(family, conv_id, shared, turn, digest, words) of every turn; the texts stay behind."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    known = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    words = F.size(F.filter(F.split("text", f"{SPACE}+"), lambda w: w != "")).cast("long")
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    family = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    return known.select(family.alias("family"), "conv_id", shared.alias("shared"), "turn", F.unhex(F.sha2(whole, 256)).alias("digest"), words.alias("words"))


class Polynomials:
    """Fingerprints of prefixes: F(d) = F(d - 1) * base + hash of turn d, for two moduli."""

    def __init__(self, moduli: tuple[int, int] = MODULI, bases: tuple[int, int] = BASES):
        self.moduli, self.bases = moduli, bases
        self.tables = [(np.ones(1, np.int64), np.ones(1, np.int64)) for _ in moduli]

    def _powers(self, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """base^0 … base^n and base^-0 … base^-n."""
        up, down = self.tables[k]
        if len(up) <= n:
            p, b = self.moduli[k], self.bases[k]
            up, down = np.ones(2 * n + 1, np.int64), np.ones(2 * n + 1, np.int64)
            back = pow(b, -1, p)
            for i in range(1, 2 * n + 1):
                up[i], down[i] = up[i - 1] * b % p, down[i - 1] * back % p
            self.tables[k] = up, down
        return up[: n + 1], down[: n + 1]

    def scan(self, hashes: np.ndarray, place: np.ndarray, first: np.ndarray, before: list[int]) -> list[np.ndarray]:
        """The fingerprints of all rows, for each modulus.

        ``place`` counts rows within a conversation (0: its root, whose hash is not looked at), ``first`` is the row where
        a row's conversation begins here; the rows of the first one continue from ``before`` if it has no root here.
        """
        found = []
        continues = (first == 0) & (len(place) > 0 and place[0] > 0)
        for k, p in enumerate(self.moduli):
            up, down = self._powers(k, int(place.max(initial=0)))
            terms = np.where(place > 0, (hashes % np.uint64(p - 1)).astype(np.int64) + 1, 0) * down[place] % p
            sums = np.cumsum(terms)
            start = np.where(continues, 0, sums[first])  # a root adds nothing, so the sum at it is what came before
            found.append(((sums - start) % p + np.where(continues, before[k], 0)) * up[place] % p)
        return found


def _binary(rows: pa.Array) -> np.ndarray:
    """Digests of 32 bytes each as a matrix."""
    return np.frombuffer(b"".join(rows.to_pylist()), np.uint8).reshape(-1, 32)


def _prefixes(polynomials: Polynomials):
    """The pass over sorted turns: a row for each prefix of each rebuilt conversation, its root included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = conv = None
        seen = depth = 0  # own turns of the conversation so far, and its rebuilt ones
        head = np.zeros((0, 32), np.uint8), np.zeros(0, np.int64)  # the family's shared first turns
        before, held = [0, 0], None  # fingerprints and the row of the prefix that was last
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            convs, families, shared = (batch.column(c).to_numpy() for c in ("conv_id", "family", "shared"))
            k = len(head[1])
            digests = np.concatenate([head[0], _binary(batch.column("digest"))])  # the carried head, then the batch
            words = np.concatenate([head[1], batch.column("words").to_numpy()])
            at_head = list(range(k))
            starts = np.flatnonzero(np.r_[True, convs[1:] != convs[:-1]])
            source, owner, begins, offset = [], [], [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
                c, new = int(convs[a]), convs[a] != conv
                if families[a] != family:
                    family, at_head = int(families[a]), []
                begins.append(len(source))
                if new:
                    conv, seen, depth = c, 0, 0
                own = max(0, int(shared[a]) - seen) if c != family else 0
                offset.append(0 if new else depth + 1)
                if new:
                    source += [-1, *(at_head[: int(shared[a])] if c != family else [])]
                if c == family and len(at_head) < SHARED - 1:
                    at_head += range(k + a, k + min(b, a + SHARED - 1 - len(at_head)))
                source += range(k + min(b, a + own), k + b)
                seen += b - a
                owner += [c] * (len(source) - begins[-1])
                depth = offset[-1] + len(source) - begins[-1] - 1
            head = digests[at_head], words[at_head]
            size = len(source)
            if not size:
                continue
            source, owner = np.array(source), np.array(owner)
            counts = np.diff([*begins, size])
            first = np.repeat(begins, counts)
            inside = np.arange(size) - first
            place = inside + np.repeat([int(o > 0) for o in offset], counts)
            root = source < 0
            halves = np.ascontiguousarray(digests).view("<i8").reshape(-1, 4)[:, :2] if len(digests) else np.zeros((0, 2), np.int64)
            halves = np.where(root[:, None], 0, halves[source])
            f1, f2 = polynomials.scan(halves[:, 0].astype(np.uint64), place, first, before)
            fp = (f1 << 32) | f2
            parent = np.r_[(before[0] << 32) | before[1], fp[:-1]]
            parent[root] = 0
            before = [int(f1[-1]), int(f2[-1])]
            out = [owner, inside + np.repeat(offset, counts), fp, parent, halves[:, 0], halves[:, 1], np.where(root, 0, words[source])]
            if held is not None:
                out = [np.r_[h, o] for h, o in zip(held, out, strict=True)]
            held = [o[-1:] for o in out]
            if len(out[0]) > 1:
                yield _rows(out, np.r_[out[0][1:] != out[0][:-1], False], slice(0, -1))
        if held is not None:
            yield _rows(held, np.array([True]), slice(None))

    return run


def _rows(columns: list[np.ndarray], last: np.ndarray, part: slice) -> pa.RecordBatch:
    names = [c.split()[0] for c in _PREFIX.split(", ")]
    return pa.record_batch([*(pa.array(c[part].astype(np.int64)) for c in columns), pa.array(last[part])], names=names)


def prefixes(conversations: DataFrame, polynomials: Polynomials | None = None) -> DataFrame:
    """(conv_id, depth, fp, parent_fp, d0, d1, words, last): all prefixes of all rebuilt conversations."""
    dealt = turns(conversations).repartition("family").sortWithinPartitions("family", "conv_id", F.asc_nulls_first("turn"), "digest")
    return dealt.select("family", "conv_id", "shared", "digest", "words").mapInArrow(_prefixes(polynomials or Polynomials()), _PREFIX)


# -- nodes ------------------------------------------------------------------------------------

_SAME = ["d0", "d1", "parent_fp", "parent_split"]


def _groups(rows: DataFrame) -> DataFrame:
    """(depth, fp, split, conv_id, n, n_ends, pure): candidate groups; pure if all members agree with the representative."""
    ends = [F.min(c).alias(f"min_{c}") for c in _SAME] + [F.max(c).alias(f"max_{c}") for c in _SAME]
    found = rows.groupBy(*NODE).agg(F.min("conv_id").alias("node_conv"), F.count("*").alias("n"), F.count_if("last").alias("n_ends"), *ends)
    pure = F.lit(True)
    for c in _SAME:
        pure = pure & (F.col(f"min_{c}") == F.col(f"max_{c}"))
    return found.select(*NODE, "node_conv", "n", "n_ends", pure.alias("pure"))


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The staged prefixes and their groups, split until every group is one node."""
    rows = rows.withColumns({"split": F.lit(0), "parent_split": F.lit(0)})
    while True:
        groups = staged(_groups(rows), "groups")
        mixed = groups.where("not pure").select(*NODE, "node_conv")
        if mixed.isEmpty():
            return rows, groups
        members = staged(rows.join(broadcast_if_small(mixed, 40), NODE), "members")
        turn_of = members.where("conv_id = node_conv").select(*NODE, F.struct(*_SAME).alias("wanted"))
        differing = members.join(broadcast_if_small(staged(turn_of, "representatives"), 64), NODE).where(F.struct(*_SAME) != F.col("wanted"))
        # Equal prefixes have the same representatives, differ from them at the same turn, and stay together.
        from_ = staged(differing.groupBy("conv_id").agg(F.min("depth").alias("from_depth")), "differing")
        joined = rows.join(broadcast_if_small(from_), "conv_id", "left")
        later = lambda c, depth: (F.col(c) + F.coalesce(depth >= F.col("from_depth"), F.lit(False)).cast("int")).alias(c)
        kept = [c for c in rows.columns if c not in ("split", "parent_split")]
        rows = staged(joined.select(*kept, later("split", F.col("depth")), later("parent_split", F.col("depth") - 1)), "split")


def _hashed(pieces: DataFrame) -> DataFrame:
    """(depth, fp, split, ends): SHA-256 of the identifiers that end at a node, from pieces of them in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def result() -> pa.RecordBatch:
            return pa.record_batch([pa.array([node[0]]), pa.array([node[1]]), pa.array([node[2]], pa.int32()), pa.array([digest.hexdigest()])], names=[*NODE, "ends"])

        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key != node:
                    if node is not None:
                        yield result()
                    node, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
        if node is not None:
            yield result()

    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return ordered.select(*NODE, "ids").mapInArrow(run, "depth long, fp long, split int, ends string")


def trie(conversations: DataFrame, polynomials: Polynomials | None = None) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, groups = verified(staged(prefixes(conversations, polynomials), "prefixes"))
    # Every prefix with its node; a node with many members meets them by a broadcast row.
    of_node = join_groups(rows.select("conv_id", *NODE, "words", "last"), groups.drop("pure"), NODE)
    of_node = staged(of_node.select("conv_id", *NODE, "words", "last", "node_conv", "n", "n_ends"), "of_node")

    own = F.col("conv_id") == F.col("node_conv")
    upwards = Window.partitionBy("conv_id").orderBy(F.desc("depth"))  # from a conversation's last prefix to its root
    so_far = upwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = of_node.withColumns({
        "saved": F.sum(F.when(own, (F.col("n") - 1) * F.col("words")).otherwise(0)).over(so_far),
        "leaves": F.sum(F.when(own & F.col("last") & (F.col("n") == F.col("n_ends")), 1).otherwise(0)).over(so_far),
        "children": F.coalesce(F.lag(own.cast("int")).over(upwards), F.lit(0)),
        "parent": F.lead("node_conv").over(upwards),
    })
    nodes = marked.groupBy(*NODE).agg(
        F.min("node_conv").alias("conv_id"), F.min("parent").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum("children").cast("long").alias("n_children"),
        F.sum("leaves").cast("long").alias("n_leaves"), F.sum("saved").cast("long").alias("saved_tokens"), F.max(F.when(F.col("last"), F.col("conv_id"))).alias("an_end"),
    )
    # Where many end, their identifiers are joined piece by piece before the pieces of a node meet in one stream.
    many = of_node.where("last and n_ends > 1").groupBy(*NODE, F.shiftright("conv_id", PIECE_BITS).alias("piece"))
    pieces = many.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    hashes = broadcast_if_small(staged(_hashed(pieces), "ends"), 96)
    one = F.sha2(F.coalesce(F.col("an_end").cast("string"), F.lit("")), 256)
    return nodes.join(hashes, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", one).alias("ends_sha256")
    )
