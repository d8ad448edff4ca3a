"""Quality: a generalised additive model with pairwise interactions, boosted cyclically.

A text is described by shape features (lengths, character classes, repetition, line structure).
Features are cut into quantile bins whose cuts lie between values of the sample; in turn, each feature's lookup table gets the leaf values of a
shallow tree grown on the histogram of the current residuals over its own bins; then the same for the
pairs of features with the largest gain.  A score is the logistic of a sum of bin lookups.

Defined results: null and empty texts score by the features of an empty text; long texts are scored whole, one
at a time; without labels of both kinds the score is the share of good labels (0.5 without any); repeated rows
score alike; columns besides doc_id and text are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.labels import cuts, held_out, training_rows

BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, SHRINK = 150, 60, 0.1, 1.0
LEAVES = 4

FEATURES = (
    "log_words", "mean_word", "distinct_words", "commonest_word", "repeated_next", "short_words", "upper", "digits", "spaces",
    "stops", "marks", "symbols", "beyond_ascii", "line_words", "repeated_lines", "sentence_words", "lone_symbols", "log_longest_word",
)

_CLASS = np.zeros((256, 8))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [_c.isascii() and _c.isupper(), 48 <= _b < 58, _b in b" \t\n\r\v\f", _c in ".,;:", _c in "!?", 32 < _b < 127 and not _c.isalnum() and _c not in ".,;:!?'\"-()", _b >= 128, (_c.isascii() and _c.isalpha()) or _b >= 0xC0]


def text_features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    upper, digits, spaces, stops, marks, symbols, beyond, letters = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    words = (text or "").split()
    n, size = max(1, len(words)), max(1, len(raw))
    counts = Counter(words)
    lines = (text or "").split("\n")
    return [
        np.log1p(len(words)), (size - spaces) / n, len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n, sum(len(w) <= 3 for w in words) / n, upper / max(1, letters), digits / size, spaces / size,
        stops / size, marks / size, symbols / size, beyond / size, n / len(lines), 1 - len(set(lines)) / len(lines),
        n / (stops + marks + 1), sum(c for w, c in counts.items() if len(w) == 1 and not w.isalnum()) / n, np.log1p(max(map(len, counts), default=0)),
    ]


def _leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value for each bin: a tree of at most LEAVES leaves on consecutive bins, best split first."""
    total_g, total_h = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    worth = lambda gs, hs: gs * gs / (hs + SHRINK)

    def best(a: int, b: int):
        cuts = np.arange(a + 1, b)
        if not len(cuts):
            return 0.0, a, a, b
        left_g, left_h = total_g[cuts] - total_g[a], total_h[cuts] - total_h[a]
        all_g, all_h = total_g[b] - total_g[a], total_h[b] - total_h[a]
        gain = worth(left_g, left_h) + worth(all_g - left_g, all_h - left_h) - worth(all_g, all_h)
        gain[(left_h < 0.5) | (all_h - left_h < 0.5)] = 0
        k = int(gain.argmax())
        return float(gain[k]), int(cuts[k]), a, b

    parts, options = [(0, len(g))], [best(0, len(g))]
    while len(parts) < LEAVES and (top := max(options))[0] > 1e-9:
        _, cut, a, b = top
        options.remove(top)
        options += [best(a, cut), best(cut, b)]
        parts.remove((a, b))
        parts += [(a, cut), (cut, b)]
    values = np.zeros(len(g))
    for a, b in parts:
        values[a:b] = -(total_g[b] - total_g[a]) / (total_h[b] - total_h[a] + SHRINK)
    return values


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of both axes of a two-way histogram."""
    cg, ch = (np.pad(np.cumsum(np.cumsum(x, axis=0), axis=1), ((1, 0), (1, 0))) for x in (g, h))
    inner = np.s_[1:-1, 1:-1]
    parts = [
        (cg[inner], ch[inner]),
        (cg[1:-1, -1:] - cg[inner], ch[1:-1, -1:] - ch[inner]),
        (cg[-1:, 1:-1] - cg[inner], ch[-1:, 1:-1] - ch[inner]),
        (cg[-1, -1] - cg[1:-1, -1:] - cg[-1:, 1:-1] + cg[inner], ch[-1, -1] - ch[1:-1, -1:] - ch[-1:, 1:-1] + ch[inner]),
    ]
    gain = sum(x * x / (y + SHRINK) for x, y in parts)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    low, values = [-float(x[i, j] / (y[i, j] + SHRINK)) for x, y in parts], np.zeros(g.shape)
    values[: i + 1, : j + 1], values[: i + 1, j + 1 :], values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = low
    return float(gain[i, j]), values


class AdditiveModel:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = float(y.mean()) if len(y) else 0.5
        self.constant = share if not len(y) or share in (0.0, 1.0) else None
        if self.constant is not None:
            return
        self.bias = float(np.log(share / (1 - share)))
        self.edges = [cuts(c, BINS) for c in x.T]
        self.coarse = [cuts(c, PAIR_BINS) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        bins, z = self._bins(x, self.edges), np.full(len(y), self.bias)

        def slopes():
            p = 1 / (1 + np.exp(-z))
            return p - y, p * (1 - p)

        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                g, h = slopes()
                step = RATE * _leaves(np.bincount(bins[f], g, len(table)), np.bincount(bins[f], h, len(table)))
                table += step
                z += step[bins[f]]
        coarse, shape = self._bins(x, self.coarse), [len(e) + 1 for e in self.coarse]

        def two_way(i: int, j: int):
            g, h = slopes()
            cell = coarse[i] * shape[j] + coarse[j]
            return [np.bincount(cell, v, shape[i] * shape[j]).reshape(shape[i], shape[j]) for v in (g, h)]

        open_ = [(i, j) for i, j in combinations(range(len(shape)), 2) if shape[i] > 1 and shape[j] > 1]
        best = sorted(open_, key=lambda p: -_quadrants(*two_way(*p))[0])[:PAIRS]
        self.pairs = {p: np.zeros((shape[p[0]], shape[p[1]])) for p in best}
        for _ in range(PAIR_ROUNDS):
            for (i, j), table in self.pairs.items():
                step = RATE * _quadrants(*two_way(i, j))[1]
                table += step
                z += step[coarse[i], coarse[j]]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        bins, coarse = self._bins(x, self.edges), self._bins(x, self.coarse)
        z = self.bias + sum(table[b] for table, b in zip(self.tables, bins, strict=True))
        z = z + sum(table[coarse[i], coarse[j]] for (i, j), table in self.pairs.items())
        return 1 / (1 + np.exp(-z))


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([text_features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame) -> AdditiveModel:
    rows = training_rows(docs, labels, "quality")
    return AdditiveModel(matrix([r["text"] for r in rows]), np.array([r["y"] for r in rows], np.float64))


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, held_out, score)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                scores = held.value.score(matrix(part.column("text").to_pylist()))
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(scores)], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
