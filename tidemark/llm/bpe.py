"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is cut by the vocabulary's pattern; the different pieces of a block of texts are encoded once.
Pieces of like length share a padded matrix, one piece a row.  In each round every row merges its
leftmost pair of least rank; ranks come from an open-addressing hash table of id pairs; rows without
a mergeable pair leave the matrix and the rest is compacted by one column.  A row of n bytes costs up
to n rounds, so pieces above ``LONGEST_ROW`` bytes (runs without a break) go through a heap with the
same order of merges.

Spark partitions the texts; a task holds one block of texts and a bounded memo of encoded pieces.
Defined results: a null text is an empty one: no ids, empty bytes; repeated rows give repeated results; texts of any length are
encoded whole, piece by piece; of pairs of one rank the leftmost merges first; columns besides those named are not looked at,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pieces of more bytes are merged one by one.
LONGEST_ROW = 256
#: Cells of one matrix, pieces that a worker remembers, characters of a text that are cut at a time.
MATRIX_CELLS, MEMO_PIECES, BLOCK_CHARS = 1 << 17, 200_000, 1 << 18
#: Characters and documents that are handled at a time.
BATCH_CHARS, BLOCK_DOCS = 1 << 20, 512

_NONE = np.int64(1 << 40)
_EMPTY = np.uint64(0xFFFF_FFFF_FFFF_FFFF)
_MIX = np.uint64(0x9E37_79B9_7F4A_7C15)


class PairTable:
    """(left id, right id) -> rank of the merged token, as an open-addressing hash table."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 3).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.mask = slots - 1
        self.keys = np.full(slots, _EMPTY)
        self.ranks = np.full(slots, _NONE)
        self.probes = 0
        at = ((keys * _MIX) >> self.shift).astype(np.int64)
        while len(keys):
            self.probes += 1
            free = self.keys[at] == _EMPTY
            won = np.zeros(len(keys), bool)
            _, first = np.unique(at[free], return_index=True)
            won[np.flatnonzero(free)[first]] = True
            self.keys[at[won]], self.ranks[at[won]] = keys[won], ranks[won]
            keys, ranks, at = keys[~won], ranks[~won], (at[~won] + 1) & self.mask

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, _NONE where there is no such token or an id is negative (padding)."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFF_FFFF))
        out = np.full(keys.shape, _NONE)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = keys[todo]
        at = ((keys * _MIX) >> self.shift).astype(np.int64)
        for _ in range(self.probes):
            held = self.keys[at]
            hit = held == keys
            out[todo[hit]] = self.ranks[at[hit]]
            left_over = ~hit & (held != _EMPTY)
            if not left_over.any():
                break
            todo, keys, at = todo[left_over], keys[left_over], (at[left_over] + 1) & self.mask
        return out


class ByteBPE:
    """Encoder and decoder for one vocabulary of ranks (lines of: base64 token, space, rank)."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.rank = {}
        for line in vocabulary.splitlines():
            if line:
                token, number = line.split()
                self.rank[base64.b64decode(token)] = int(number)
        self.pattern = regex.compile(pattern)
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, number in self.rank.items():
            self.token[number] = token
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [
            (a << 32 | b, number)
            for token, number in self.rank.items()
            for cut in range(1, len(token))
            if (a := self.rank.get(token[:cut])) is not None and (b := self.rank.get(token[cut:])) is not None
        ]
        self.pairs = PairTable(np.array([k for k, _ in pairs], np.uint64), np.array([r for _, r in pairs], np.int64))
        self._forget()

    # -- encoding -----------------------------------------------------------------------------

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece; whole tokens are taken as they are."""
        out: list = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.rank.get(piece)) is not None:
                out[i] = np.array([whole], np.int32)
            elif len(piece) > LONGEST_ROW:
                out[i] = self._merge_long(piece)
            else:
                width = len(piece) if len(piece) <= 12 else -(-len(piece) // 8) * 8
                by_length.setdefault(width, []).append(i)
        for width, members in by_length.items():
            rows = max(1, MATRIX_CELLS // width)
            for start in range(0, len(members), rows):
                self._merge_rows(width, members[start : start + rows], pieces, out)
        return out

    def _merge_rows(self, width: int, members: list[int], pieces: list[bytes], out: list) -> None:
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in members), np.uint8).reshape(-1, width)
        lengths = np.array([len(pieces[i]) for i in members])
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_id[raw], -1)
        ranks = self.pairs.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        who = np.array(members)
        while len(ids):
            least = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            best = ranks[np.arange(len(ids)), least] if ranks.shape[1] else np.full(len(ids), _NONE)
            going = best < _NONE
            for i, row in zip(who[~going].tolist(), ids[~going], strict=True):
                out[i] = row[row >= 0].astype(np.int32)
            who, ids, ranks, least, best = who[going], ids[going], ranks[going], least[going], best[going]
            if not len(ids):
                return
            rows, keep = np.arange(len(ids)), np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, keep + (keep > least[:, None]), axis=1)
            ids[rows, least] = best
            keep = keep[:-1]
            ranks = np.take_along_axis(ranks, keep + (keep >= least[:, None]), axis=1)
            for at in (least - 1, least):  # the two pairs that the merge has changed
                fit = (at >= 0) & (at < ranks.shape[1])
                ranks[rows[fit], at[fit]] = self.pairs.look_up(ids[rows[fit], at[fit]], ids[rows[fit], at[fit] + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        token, rank = self.token, self.rank

        def pair(i: int) -> int | None:
            return rank.get(token[ids[i]] + token[ids[after[i]]]) if after[i] < n else None

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (found := pair(k)) is not None:
                    heapq.heappush(heap, (found, k, ids[k], ids[after[k]]))
        return np.array([i for i in ids if i >= 0], np.int32)

    def _codes(self, pieces: list[str]) -> np.ndarray:
        """Index of each piece in the memo; new pieces are encoded first."""
        codes = np.fromiter(map(self.memo.get, pieces, repeat(-1)), np.int64, len(pieces))
        if (codes < 0).any():
            new = list(dict.fromkeys(pieces[i] for i in np.flatnonzero(codes < 0)))
            if len(self.memo) + len(new) > MEMO_PIECES and self.memo:
                self._forget()
                return self._codes(pieces)
            encoded = self.encode_pieces([p.encode() for p in new])
            counts = np.array([len(e) for e in encoded], np.int64)
            self.memo.update(zip(new, range(len(self.counts), len(self.counts) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, *encoded])
            codes = np.fromiter(map(self.memo.get, pieces), np.int64, len(pieces))
        return codes

    def _blocks(self, text: str) -> Iterator[str]:
        """Cuts a long text before white space that follows something else: no piece crosses that."""
        start = 0
        while len(text) - start > BLOCK_CHARS:
            cut = _GAP.search(text, start + BLOCK_CHARS)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the new pieces of all texts are encoded together."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for block in self._blocks(text):
                waiting.append((i, self.pattern.findall(block)))
                size += len(block)
                if size >= BATCH_CHARS:
                    self._encode_blocks(waiting, out)
                    waiting, size = [], 0
        self._encode_blocks(waiting, out)
        return [np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.int32) for parts in out]

    def _encode_blocks(self, blocks: list[tuple[int, list[str]]], out: list[list[np.ndarray]]) -> None:
        codes = self._codes([p for _, pieces in blocks for p in pieces])
        if not len(codes):
            return
        counts = self.counts[codes]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(self.starts[codes] - ends + counts, counts) + np.arange(ends[-1])]
        piece = at = 0
        for i, pieces in blocks:
            piece += len(pieces)
            end = int(ends[piece - 1]) if piece else 0
            out[i].append(ids[at:end])
            at = end

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    # -- decoding -----------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(
            b"".join(map(self.token.__getitem__, ids[i : i + BLOCK_CHARS].tolist())) for i in range(0, len(ids), BLOCK_CHARS)
        )


_GAP = regex.compile(r"(?<=\S)\s")


class _File:
    """The bytes of a vocabulary file and the encoder that a worker builds from them: it goes with the worker's copy of the bytes."""

    def __init__(self, raw: bytes, pattern: str):
        self.raw, self.pattern = raw, pattern
        self._encoder: ByteBPE | None = None

    def __getstate__(self):
        return self.__dict__ | {"_encoder": None}

    def encoder(self) -> ByteBPE:
        if self._encoder is None:
            self._encoder = ByteBPE(self.raw, self.pattern)
        return self._encoder


class Vocabulary:
    """A vocabulary file read once by the driver; workers build their encoder from the broadcast bytes, for as long as tasks use them."""

    def __init__(self, spark, path: str, pattern: str):
        with open(path, "rb") as file:
            self.file = spark.sparkContext.broadcast(_File(file.read(), pattern))  # one vocabulary file, whatever the corpus

    def encoder(self) -> ByteBPE:
        return self.file.value.encoder()


def public_vocabulary(spark, name: str = "byte_bpe_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    return Vocabulary(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, decoded): the ids of each whole text and the bytes that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(start, BLOCK_DOCS)
                ids = encoder.encode_many([text or "" for text in part.column("text").to_pylist()])
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([encoder.decode(i) for i in ids], pa.binary())],
                    names=["doc_id", "ids", "decoded"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def token_digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of ``encode_documents``, taken where the ids are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(start, BLOCK_DOCS)
                counts, of_ids, of_bytes = [], [], []
                for ids in encoder.encode_many([text or "" for text in part.column("text").to_pylist()]):
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    of_bytes.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
