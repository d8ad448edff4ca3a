"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

A rule is a host and a path prefix; it fits its host and all subdomains.  The longest fitting rule
decides.  URLs without a rule go to boosted trees on length, depth, digit ratio, entropy, parameter
counts and suffix statistics, trained on a bounded sample of the URLs that the rules label.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule; without
labelled URLs of both kinds the trees answer with the share of blocked ones (allow without any);
repeated rows are judged alike; long URLs are taken whole, but none of more than ``TRAINING_URL_CHARS`` characters is
learnt from; columns besides page_id and url are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labels import cuts

#: (verdict, rule): fixed values.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: At most so many URLs that a rule labels are collected for training.
TRAINING_ROWS = 20_000
#: Longer URLs are judged but not learnt from, which bounds the sample in bytes too.
TRAINING_URL_CHARS = 2048
TREES, DEPTH, RATE, BINS, SHRINK, LEAST_WEIGHT = 80, 3, 0.15, 32, 1.0, 2.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """Columns host and path of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, ruled): the longest rule that fits and its verdict, or nulls."""
    host, path = host_and_path(F.col("url"))
    parted = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule = ruled = F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):  # longer rules override shorter ones
        own, slash, prefix = text.partition("/")
        fits = ((F.col("host") == own) | F.col("host").endswith("." + own)) & F.col("path").startswith(slash + prefix)
        rule, ruled = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return parted.withColumn("rule", rule).withColumn("ruled", ruled)


# -- features ---------------------------------------------------------------------------------


def lexical(url: str | None, host: str, path: str) -> list[float]:
    text = url or ""
    n = max(1, len(text))
    shares = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)[1] / n
    query = text.partition("?")[2]
    return [
        len(text), len(host), len(path), path.count("/"), host.count("."), sum(c.isdigit() for c in text) / n,
        float(-(shares * np.log2(shares)).sum()), query.count("="), query.count("&"), text.count("-"), text.count("_"), text.count("%"),
        float("#" in text), float(text.startswith("https")), float(path.endswith("/")), float("." in path.rpartition("/")[2]),
        max(map(len, re.split(r"[^0-9a-z]+", text.lower()))), sum(c in "aeiou" for c in host) / max(1, len(host)),
    ]


def suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


class UrlModel:
    """Boosted trees on lexical features and on what the training URLs say about a host's suffixes.

    The suffix statistics come from one half of the training rows and the trees from the other, so that no
    tree sees a statistic to which its own row's label has contributed.
    """

    def __init__(self, rows: list):
        y = np.array([r["ruled"] == "block" for r in rows], np.float64)
        self.share = float(y.mean()) if len(y) else 0.0
        self.stats: dict[str, tuple[float, float]] = {}
        for r, label in zip(rows[::2], y[::2], strict=True):
            for s in suffixes(r["host"]):
                n, blocked = self.stats.get(s, (0.0, 0.0))
                self.stats[s] = (n + 1, blocked + label)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias = 0.0
        if 0 < y[1::2].sum() < len(y[1::2]):
            self._boost(self._matrix([(r["url"], r["host"], r["path"]) for r in rows[1::2]]), y[1::2])

    def _matrix(self, parts: list[tuple]) -> np.ndarray:
        out = []
        for url, host, path in parts:
            row = lexical(url, host, path)
            for s in suffixes(host):
                n, blocked = self.stats.get(s, (0.0, 0.0))
                row += [np.log1p(n), (blocked + 5 * self.share) / (n + 5)]
            out.append(row)
        return np.array(out, np.float64).reshape(len(parts), -1)

    def _boost(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges = [cuts(c, BINS) for c in x.T]
        bins = self._bins(x)
        self.bias = float(np.log(self.share / (1 - self.share)))
        z = np.full(len(y), self.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(bins, p - y, p * (1 - p))
            self.trees.append(tree)
            z += self._walk(tree, bins)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    @staticmethod
    def _grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full tree of DEPTH levels as arrays: feature and cut of each inner node, value of each leaf."""
        inner = (1 << DEPTH) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS + 1)
        node = np.zeros(len(g), np.int64)
        for level in range(DEPTH):
            for at in range((1 << level) - 1, (2 << level) - 1):
                own = np.flatnonzero(node == at)
                best = 1e-9
                total_g, total_h = g[own].sum(), h[own].sum()
                for f in range(bins.shape[1]):
                    left_g = np.cumsum(np.bincount(bins[own, f], g[own], BINS + 1))[:-1]
                    left_h = np.cumsum(np.bincount(bins[own, f], h[own], BINS + 1))[:-1]
                    gain = left_g**2 / (left_h + SHRINK) + (total_g - left_g) ** 2 / (total_h - left_h + SHRINK) - total_g**2 / (total_h + SHRINK)
                    gain[(left_h < LEAST_WEIGHT) | (total_h - left_h < LEAST_WEIGHT)] = 0
                    if gain.max(initial=0) > best:
                        best, feature[at], cut[at] = gain.max(), f, int(gain.argmax())
                node[own] = 2 * at + 1 + (bins[own, feature[at]] > cut[at])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + SHRINK)
        return feature, cut, value

    @staticmethod
    def _walk(tree: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def score(self, parts: list[tuple]) -> np.ndarray:
        """Probability that (url, host, path) is to be blocked."""
        if not self.trees:
            return np.full(len(parts), self.share)
        bins = self._bins(self._matrix(parts))
        return 1 / (1 + np.exp(-(self.bias + sum(self._walk(tree, bins) for tree in self.trees))))


def fit(pages: DataFrame, rules=RULES, limit: int = TRAINING_ROWS) -> UrlModel:
    """Trains on at most ``limit`` different URLs that a rule labels, the same ones for the same table."""
    labelled = with_rules(pages, rules).where(F.col("rule").isNotNull() & (F.length("url") <= TRAINING_URL_CHARS)).select("url", "host", "path", "ruled").distinct()
    return UrlModel(labelled.orderBy(F.xxhash64("url"), "url").limit(limit).collect())


def judge(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score)."""
    held = pages.sparkSession.sparkContext.broadcast(model)  # trees of fixed size and the sample's suffixes
    names = ["page_id", "host", "path", "rule", "ruled", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")), strict=True))
            yield pa.record_batch([*(batch.column(c) for c in names[:-1]), pa.array(held.value.score(parts), pa.float64())], names=names)

    kind = pages.schema["page_id"].dataType.simpleString()
    scored = with_rules(pages, rules).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, ruled string, score double")
    by_score = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_score).alias("verdict"), "score")
