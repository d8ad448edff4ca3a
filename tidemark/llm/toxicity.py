"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy.

A word (a run of letters, lower-cased) is the sum of the hashed embeddings of itself and of its longer
prefixes, so that a stem carries over to its compounds.  Filters of several widths run over the words;
max pooling keeps each filter's strongest answer in a text; a logistic layer gives the score.  A text
without words is one blank word.  Per language a threshold is calibrated on training rows that the
weights have not seen; the score itself never looks at the language.

All labelled rows outside the held-out fold are learnt from.  They are dealt to shards by a hash; in every pass each
shard learns from the same weights, and the mean of what the shards have learnt, by their rows, is the next pass' start.
How many texts have a bucket, and how many calibration rows have a score, is counted over all of them.

When scoring, a filter's answers are sums of per-word projections, so a worker projects each different
word once and a text costs lookups, additions and a maximum.  Texts are cut into overlapping parts, so
memory does not grow with the longest text.

Defined results: null and empty texts score as a blank word; without labels of both kinds the score is
the share of toxic labels (0 without any); repeated rows score alike; columns besides doc_id, text and lang are not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, staged
from tidemark.llm.labels import held_out, labelled_rows

BUCKETS, DIMENSIONS, WIDTHS, FILTERS = 1 << 17, 12, (1, 2, 3), 8
#: A word counts by itself and by these prefixes of it, if it is longer.
PREFIXES = (4, 5, 6, 7, 8)
#: Words and prefixes of fewer training texts carry no weight: a rare word tells one text, not a kind of text.
LEAST_TEXTS, SMOOTHING = 4, 8
#: Passes over the rows: enough of them for LEAST_STEPS batches, within these bounds.
EPOCHS, LEAST_STEPS, BATCH, RATE, TOXIC_WEIGHT = (4, 60), 500, 32, 0.003, 2.0
#: Labelled rows and characters of text of a shard.
SHARD_ROWS, SHARD_CHARS = 8000, 64 << 20
#: Numbers of a piece of an array that is summed between tasks.
PIECE = 1 << 16
#: One training row in so many only calibrates; the model and a language need so many toxic ones for an own threshold.
CALIBRATION, LEAST_TOXIC = 5, 10
#: Words of a part of a text; words that a worker remembers.
PART_WORDS, MEMO_WORDS = 1 << 15, 150_000
#: Words whose features are found together; longer ones are taken one by one.
FEATURE_WORDS, LONG_WORD = 1 << 13, 32

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(word: str) -> list[int]:
    """Buckets 1 to BUCKETS - 1 of a word and its prefixes; 0 stands for none."""
    names = [word, *(word[:n] + "~" for n in PREFIXES if len(word) > n)]
    found = [zlib.crc32(name.encode()) % (BUCKETS - 1) + 1 for name in names]
    return found + [0] * (1 + len(PREFIXES) - len(found))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _crc_of(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """CRC-32 states one byte further."""
    return _CRC[(state ^ byte) & 0xFF] ^ (state >> 8)


def features_of(words: list[str]) -> np.ndarray:
    """``features`` of many words, a row for each: the states of their CRCs go from character to character together."""
    out = np.zeros((len(words), 1 + len(PREFIXES)), np.int32)
    short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
    for at in range(0, len(short), FEATURE_WORDS):
        rows = np.array(short[at : at + FEATURE_WORDS])
        own = np.array([words[i] for i in rows])
        chars = own.view(np.uint32).reshape(len(rows), -1)
        sizes = (chars != 0).sum(axis=1)
        by_size = np.argsort(-sizes, kind="stable")  # so that the words that go on are always the first ones
        rows, chars, sizes = rows[by_size], np.ascontiguousarray(chars[by_size].T), sizes[by_size]
        bucket = lambda state: (state ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS - 1) + 1
        state = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for n, column in enumerate(chars, 1):
            alive = int(np.searchsorted(-sizes, -n, "right"))
            state, c = state[:alive], column[:alive]
            wide = np.flatnonzero(c > 0x7F)
            after = _crc_of(state, c)
            if len(wide):  # UTF-8 of two to four bytes
                x, begun = c[wide], state[wide]
                more = np.where(x > 0xFFFF, 3, np.where(x > 0x7FF, 2, 1)).astype(np.uint32)
                begun = _crc_of(begun, np.array([0, 0xC0, 0xE0, 0xF0], np.uint32)[more] | (x >> (6 * more)))
                for left in (2, 1, 0):
                    goes = more > left
                    begun = np.where(goes, _crc_of(begun, 0x80 | ((x >> np.uint32(6 * left)) & 0x3F)), begun)
                after[wide] = begun
            state = after
            longer = int(np.searchsorted(-sizes, -(n + 1), "right"))
            out[rows[longer:alive], 0] = bucket(state[longer:])
            if n in PREFIXES:
                out[rows[:longer], 1 + PREFIXES.index(n)] = bucket(_crc_of(state[:longer], ord("~")))
    for i, w in enumerate(words):
        if len(w) > LONG_WORD:
            out[i] = features(w)
    return out


def passes(rows: int) -> int:
    return min(EPOCHS[1], max(EPOCHS[0], LEAST_STEPS * BATCH // max(1, rows)))


class Shard:
    """Labelled texts of one task, as numbers of its words."""

    def __init__(self, texts: Iterable[list[str]], labels: np.ndarray):
        number: dict[str, int] = {}
        self.rows = [np.array([number.setdefault(w, len(number) + 1) for w in words] or [0], np.int32) for words in texts]
        self.table = np.concatenate([np.zeros((1, 1 + len(PREFIXES)), np.int32), features_of(list(number))])
        self.labels = np.asarray(labels, np.float32)

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        words = np.concatenate(self.rows)
        return self.table.astype(np.int32).tobytes(), words.tobytes(), np.array([len(r) for r in self.rows], np.int64).tobytes(), self.labels.tobytes()

    @classmethod
    def unpacked(cls, table: bytes, words: bytes, lengths: bytes, labels: bytes) -> Shard:
        shard = cls.__new__(cls)
        shard.table = np.frombuffer(table, np.int32).reshape(-1, 1 + len(PREFIXES))
        shard.rows = np.split(np.frombuffer(words, np.int32), np.cumsum(np.frombuffer(lengths, np.int64))[:-1])
        shard.labels = np.frombuffer(labels, np.float32)
        return shard

    def seen(self) -> np.ndarray:
        """(2, BUCKETS): by label, the texts that have a bucket."""
        found = np.zeros((2, BUCKETS))
        for row, label in zip(self.rows, self.labels, strict=True):
            found[int(label), np.unique(self.table[np.unique(row)])] += 1
        return found


class TextCNN:
    def __init__(self, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.embedding[0] = 0
        self.filters = [rng.normal(0, (2 / (w * DIMENSIONS)) ** 0.5, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.zeros(len(WIDTHS) * FILTERS, np.float32) + 0.1
        self.out_bias = np.float32(0)
        self.constant: float | None = None

    # -- training ---------------------------------------------------------------------------

    def train(self, texts: list[list[str]], labels: np.ndarray) -> TextCNN:
        """Learns from texts at hand, as from a single shard."""
        shard = Shard(texts, labels)
        if self.start(shard.seen(), labels.sum(), len(labels)):
            self.learn(shard, range(passes(len(labels))), passes(len(labels)))
        return self

    def start(self, seen: np.ndarray, toxic: float, n: int) -> bool:
        """The first dimension starts as the smoothed log odds of a bucket's texts; the filters start by passing it.

        ``seen``: by label and bucket, the texts that have it.  False if there is nothing to learn: one kind of label or none.
        """
        share = np.float32(toxic / n) if n else np.float32(0)
        if not 0 < toxic < n:
            self.constant = float(share)
            return False
        odds = np.log((seen[1] + SMOOTHING * share) / (seen[0] + SMOOTHING * (1 - share)) * (1 - share) / share)
        self.embedding *= 0.2
        self.embedding[:, 0] = 0.5 * np.maximum(odds, 0)
        self.rare = seen.sum(axis=0) < LEAST_TEXTS
        self.embedding[self.rare] = 0
        self.embedding[0] = 0
        for kernel in self.filters:
            kernel *= 0.2
            kernel[0, 0] = 1
        return True

    def learn(self, shard: Shard, epochs: range, of: int, seed: int = 29) -> None:
        """Some of the ``of`` passes over a shard."""
        table, rows, labels = shard.table.copy(), shard.rows, shard.labels
        table[self.rare[table]] = 0
        names = ["embedding", "bias", "out", "out_bias", *range(len(WIDTHS))]
        get = lambda n: self.filters[n] if isinstance(n, int) else getattr(self, n)
        first = {n: np.zeros_like(get(n)) for n in names}
        second = {n: np.zeros_like(get(n)) for n in names}
        rng, step = np.random.default_rng(seed), 0
        for epoch in epochs:
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                batch = order[at : at + BATCH]
                step += 1
                grads, touched = self._gradients([rows[i] for i in batch], labels[batch], table, rng)
                rate = RATE * (1 - epoch / (of + 1))
                for n, grad in grads.items():
                    where = touched if n == "embedding" else ...
                    m, v = first[n], second[n]
                    m[where] = 0.9 * m[where] + 0.1 * grad
                    v[where] = 0.99 * v[where] + 0.01 * grad * grad
                    change = rate * (m[where] / (1 - 0.9**step)) / (np.sqrt(v[where] / (1 - 0.99**step)) + 1e-6)
                    if n == "out_bias":
                        self.out_bias = np.float32(self.out_bias - change)
                    else:
                        get(n)[where] -= change

    def weights(self) -> np.ndarray:
        """All that is learnt, in one row; buckets of rare words stay zero and are left out."""
        return np.concatenate([x.ravel() for x in (self.embedding[~self.rare], self.bias, self.out, np.array([self.out_bias]), *self.filters)]).astype(np.float32)

    def take(self, weights: np.ndarray) -> None:
        shapes = [(int((~self.rare).sum()), DIMENSIONS), self.bias.shape, self.out.shape, (1,), *(k.shape for k in self.filters)]
        parts = np.split(weights.astype(np.float32), np.cumsum([np.prod(s) for s in shapes])[:-1])
        embedding, self.bias, self.out, bias, *self.filters = (x.reshape(s).copy() for x, s in zip(parts, shapes, strict=True))
        self.embedding[~self.rare], self.out_bias = embedding, bias[0]

    def _gradients(self, rows, labels, table, rng):
        lengths = np.array([len(r) for r in rows])
        pad = max(WIDTHS) - 1
        words = np.concatenate([x for r in rows for x in (r, np.zeros(pad, r.dtype))])
        starts = np.r_[0, np.cumsum(lengths + pad)[:-1]]
        different, inverse = np.unique(words, return_inverse=True)
        vectors = self.embedding[table[different]].sum(axis=1)[inverse]
        valid = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, lengths, strict=True)])
        edges = np.r_[0, np.cumsum(lengths)[:-1]]
        owner = np.repeat(np.arange(len(rows)), lengths)
        pooled, winners = [], []
        for w, kernel in zip(WIDTHS, self.filters, strict=True):
            answer = sum(vectors[valid + k] @ kernel[k] for k in range(w))
            top = np.maximum.reduceat(answer, edges, axis=0)
            hit, of = np.nonzero(answer == top[owner])
            first = np.full(top.shape, len(answer) - 1)
            first[owner[hit[::-1]], of[::-1]] = hit[::-1]  # of several the first one is written last
            winners.append(valid[first])
            pooled.append(top)
        raw = np.concatenate(pooled, axis=1) + self.bias
        drop = (rng.random(raw.shape) > 0.2) / np.float32(0.8)
        active = np.maximum(raw, 0) * drop
        p = 1 / (1 + np.exp(-(active @ self.out + self.out_bias)))
        delta = ((p - labels) * np.where(labels == 1, TOXIC_WEIGHT, 1.0) / len(rows)).astype(np.float32)
        grads = {"out": active.T @ delta + 1e-4 * self.out, "out_bias": delta.sum()}
        into = delta[:, None] * self.out * drop * (raw > 0)
        grads["bias"] = into.sum(axis=0)
        changes = np.zeros_like(vectors)
        for i, (w, kernel, won) in enumerate(zip(WIDTHS, self.filters, winners, strict=True)):
            part = into[:, i * FILTERS : (i + 1) * FILTERS]
            grads[i] = np.stack([np.einsum("bfd,bf->df", vectors[won + k], part) for k in range(w)]) + 1e-4 * kernel
            for k in range(w):
                np.add.at(changes, (won + k).ravel(), (part[:, :, None] * kernel[k].T[None]).reshape(-1, DIMENSIONS))
        moved = np.flatnonzero(np.abs(changes).sum(axis=1))
        of_bucket = table[words[moved]]
        touched, slot = np.unique(of_bucket, return_inverse=True)
        grad = np.zeros((len(touched), DIMENSIONS), np.float32)
        np.add.at(grad, slot.ravel(), np.repeat(changes[moved], of_bucket.shape[1], axis=0))
        grad[touched == 0] = 0
        grads["embedding"] = grad
        return grads, touched

    # -- scoring ----------------------------------------------------------------------------

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts; remembers the projections of the words seen."""

    def __init__(self, model: TextCNN):
        self.model = model
        #: all filters side by side: DIMENSIONS x (width 1, width 2 at 0, width 2 at 1, ...)
        self.kernel = np.concatenate([kernel[k] for kernel in model.filters for k in range(len(kernel))], axis=1)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.projected = np.zeros((1024, self.kernel.shape[1]), np.float32)  # from row 1 on, with room

    def _numbers(self, words: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            missed = [words[i] for i in unknown]
            new = list(dict.fromkeys(missed))
            if len(self.number) + len(new) > MEMO_WORDS and self.number:
                self._forget()
                return self._numbers(words)
            start = len(self.number) + 1
            end = start + len(new)
            if end > len(self.projected):
                room = np.zeros((max(end, 2 * len(self.projected)), self.kernel.shape[1]), np.float32)
                room[:start] = self.projected[:start]
                self.projected = room
            self.projected[start:end] = self.model.embedding[features_of(new)].sum(axis=1) @ self.kernel
            self.number.update(zip(new, range(start, end), strict=True))
            found[unknown] = np.fromiter(map(self.number.get, missed), np.int64, len(missed))
        return found

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        pooled = np.full((len(texts), len(self.model.bias)), -np.inf, np.float32)
        pad, waiting, size = max(WIDTHS) - 1, [], 0
        for i, text in enumerate(texts):
            words = words_of(text)
            for start in range(0, max(1, len(words)), PART_WORDS):
                waiting.append((i, words[start : start + PART_WORDS + pad], min(PART_WORDS, max(1, len(words) - start))))
                size += len(waiting[-1][1]) + pad
                if size >= PART_WORDS:
                    self._pool(waiting, pooled)
                    waiting, size = [], 0
        if waiting:
            self._pool(waiting, pooled)
        raw = np.maximum(pooled + self.model.bias, 0) @ self.model.out + self.model.out_bias
        return 1 / (1 + np.exp(-raw.astype(np.float64)))

    def _pool(self, parts: list[tuple[int, list[str], int]], pooled: np.ndarray) -> None:
        pad = max(WIDTHS) - 1
        flat = self._numbers([w for _, words, _ in parts for w in words])
        lengths = np.array([len(words) for _, words, _ in parts])
        counts = np.array([n for _, _, n in parts])  # windows that start in this part
        room = np.maximum(lengths, 1) + pad  # a blank for an empty text, and blanks behind each part
        offset = np.r_[0, np.cumsum(room)[:-1]]
        numbers = np.zeros(int(room.sum()), np.int64)
        numbers[np.repeat(offset - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(len(flat))] = flat
        ends = np.cumsum(counts)
        valid = np.repeat(offset - ends + counts, counts) + np.arange(ends[-1])
        answers, column = [], 0
        for w in WIDTHS:
            answer = 0
            for k in range(w):
                answer = answer + self.projected[numbers[valid + k], column : column + FILTERS]
                column += FILTERS
            answers.append(answer)
        top = np.maximum.reduceat(np.concatenate(answers, axis=1), ends - counts, axis=0)
        np.maximum.at(pooled, [i for i, _, _ in parts], top)


class ToxicityModel:
    """Weights and thresholds, fitted on all labelled rows outside the held-out fold."""

    def __init__(self, cnn: TextCNN, default: float = 0.5, thresholds: dict[str, float] | None = None):
        self.cnn, self.default, self.thresholds = cnn, default, thresholds or {}
        self._scorer: Scorer | None = None

    def __getstate__(self):
        return self.__dict__ | {"_scorer": None}

    def judge(self, texts: list[str | None], langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, thresholds)."""
        if self._scorer is None:
            self._scorer = self.cnn.scorer()
        return self._scorer.score(texts), np.array([self.thresholds.get(x, self.default) for x in langs])


def _best_threshold(scores: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The threshold of the best F1 over numbers of rows by score, in the middle of its gap; 0.5 without toxic rows."""
    if not toxic.sum():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    hits, chosen = np.cumsum(toxic[order]), np.cumsum((toxic + clean)[order])
    best = int(np.argmax(2 * hits / (chosen + toxic.sum())))
    low = scores[order[best + 1]] if best + 1 < len(order) else 0.0
    return float(np.clip((scores[order[best]] + low) / 2, 0.05, 0.95))


_PACKED = ["words", "numbers", "lengths", "labels"]


def _shards(rows: DataFrame) -> DataFrame:
    """A row for each shard of the labelled texts (text, y) of a task; a task holds one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((text.as_py(), y) for batch in batches for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True))
        ended = False
        while not ended:
            labels: list[int] = []

            def of_shard(labels=labels) -> Iterator[list[str]]:
                """The words of one text at a time, until the shard is full."""
                nonlocal ended
                size = 0
                while len(labels) < SHARD_ROWS and size < SHARD_CHARS:
                    text, y = next(rows, (None, None))
                    if y is None:
                        ended = True
                        return
                    labels.append(y)
                    size += len(text or "")
                    yield words_of(text)

            shard = Shard(of_shard(), labels)
            if labels:
                cells = shard.packed()
                yield pa.record_batch([pa.array([len(labels)], pa.int64()), pa.array([sum(labels)], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], names=["n", "toxic", *_PACKED])

    return rows.select("text", "y").mapInArrow(run, "n long, toxic long, " + ", ".join(f"{c} binary" for c in _PACKED))


def _over_shards(shards: DataFrame, of_shard: Callable[[Shard], np.ndarray]) -> np.ndarray:
    """The sum of an array over all shards: within each task first, then piece by piece between tasks.

    As many tasks as the session has cores at most, whatever the shards' number: what is shuffled is an array of each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                found = of_shard(Shard.unpacked(*(batch.column(c)[i].as_buffer() for c in _PACKED)))
                total = found if total is None else total + found
        for at in range(0, 0 if total is None else len(total), PIECE):
            cells = [at], [TaskContext.get().partitionId()], [total.dtype.str], [total[at : at + PIECE].tobytes()]
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(cells, (pa.int64(), pa.int32(), pa.string(), pa.binary()), strict=True)], names=["at", "task", "kind", "piece"])

    def summed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task").to_pydict()  # sums of floats in one order
        total = sum(np.frombuffer(piece, kind) for piece, kind in zip(rows["piece"], rows["kind"], strict=True))
        return pa.table({"at": pa.array(rows["at"][:1], pa.int64()), "kind": pa.array(rows["kind"][:1]), "piece": pa.array([total.tobytes()], pa.binary())})

    tasks = shards.sparkSession.sparkContext.defaultParallelism
    sums = shards.select(*_PACKED).coalesce(tasks).mapInArrow(run, "at long, task int, kind string, piece binary")
    pieces = sums.groupBy("at").applyInArrow(summed, "at long, kind string, piece binary").collect()  # an array of fixed size
    return np.concatenate([np.frombuffer(r["piece"], r["kind"]) for r in sorted(pieces, key=lambda r: r["at"])])


def _fitted(shards: DataFrame) -> TextCNN:
    """Every pass starts each shard from the same weights and ends with their mean over the shards; one shard makes all its passes at once."""
    n, toxic, count = shards.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    cnn = TextCNN()
    if not cnn.start(_over_shards(shards, lambda shard: shard.seen().ravel()).reshape(2, BUCKETS) if n else np.zeros((2, BUCKETS)), toxic, n):
        return cnn
    of = passes(n)
    for epochs in [range(of)] if count == 1 else [range(i, i + 1) for i in range(of)]:
        sent = shards.sparkSession.sparkContext.broadcast(cnn)  # weights of fixed size

        def learnt(shard: Shard, epochs=epochs, sent=sent) -> np.ndarray:
            own = pickle.loads(pickle.dumps(sent.value))  # a worker keeps the broadcast one
            own.learn(shard, epochs, of, 29 + epochs.start)
            return np.r_[np.float32(len(shard.rows)), own.weights() * np.float32(len(shard.rows))]

        summed = _over_shards(shards, learnt)
        cnn.take(summed[1:] / summed[0])
        sent.destroy()
    return cnn


def _calibrated(cnn: TextCNN, rows: DataFrame) -> ToxicityModel:
    """Thresholds from the numbers of all calibration rows by language, label and score (to four digits)."""
    model = ToxicityModel(cnn)
    scored = score_toxicity(rows.select(F.concat_ws(" ", F.col("y"), F.coalesce("lang", F.lit(""))).alias("doc_id"), "text", "lang"), model)
    by_score = scored.groupBy("doc_id", F.round("score", 4).alias("score")).agg(F.count("*").alias("n"))
    # Only languages with enough toxic rows have a threshold; what comes back is at most 10,001 scores of each and of all.
    marked = by_score.select(F.split("doc_id", " ", 2)[1].alias("lang"), "score", F.when(F.col("doc_id").startswith("1"), F.col("n")).otherwise(0).alias("toxic"), "n")
    counts = staged(marked.groupBy("lang", "score").agg(F.sum("toxic").alias("toxic"), F.sum(F.col("n") - F.col("toxic")).alias("clean")), "calibration")
    columns = lambda found: [np.array([r[c] for r in found], float) for c in ("score", "toxic", "clean")]
    scores, toxic, clean = columns(counts.groupBy("score").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).orderBy("score").collect())
    if toxic.sum() < LEAST_TOXIC or cnn.constant is not None:  # a threshold from fewer would be a guess
        return model
    best = _best_threshold(scores, toxic, clean)
    shift = np.log(best / (1 - best))
    cnn.out_bias = np.float32(cnn.out_bias - shift)  # from now on 0.5 is best overall
    enough = counts.groupBy("lang").agg(F.sum("toxic").alias("t")).where(F.col("t") >= LEAST_TOXIC).select("lang")
    own: dict[str, list] = {}
    for r in counts.join(enough, "lang").orderBy("lang", "score").collect():
        own.setdefault(r["lang"], []).append(r)
    for lang, found in own.items():
        scores, toxic, clean = columns(found)
        odds = scores / np.maximum(1 - scores, 1e-9) * np.exp(-shift)
        model.thresholds[lang] = _best_threshold(odds / (1 + odds), toxic, clean)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from every labelled row outside the held-out fold, in shards of about ``SHARD_ROWS`` rows."""
    with scratch(docs.sparkSession):
        rows = labelled_rows(docs, labels, "toxic").withColumn("hash", F.xxhash64("doc_id", F.lit(CALIBRATION)))
        held = F.pmod("hash", F.lit(CALIBRATION)) == 0
        taught = rows.where(~held).select("text", "y", "hash", "doc_id")
        tasks = max(1, -(-labels.count() // SHARD_ROWS))
        # Where the session deals rows to more partitions than are asked for, a task still takes a shard's rows: small shards learn little.
        shards = _shards(taught.repartition(tasks, "hash").coalesce(tasks).sortWithinPartitions("hash", "doc_id", "text"))
        return _calibrated(_fitted(staged(shards, "shards")), rows.where(held))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, threshold): threshold is the calibrated one of the row's language."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # weights of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                scores, thresholds = held.value.judge(part.column("text").to_pylist(), part.column("lang").to_pylist())
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(scores), pa.array(thresholds)], names=["doc_id", "held_out", "score", "threshold"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text", "lang").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, threshold double"
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold of their language; decided where each row is."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # weights of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                scores, thresholds = held.value.judge(part.column("text").to_pylist(), part.column("lang").to_pylist())
                yield part.filter(pa.array(scores < thresholds))

    return docs.mapInArrow(run, docs.schema)
