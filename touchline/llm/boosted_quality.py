"""A quality classifier: histogram gradient-boosted trees over statistics of a document.

Every text becomes a row of statistics (shares of kinds of bytes, word lengths, repetition of words and
lines). Trees are grown on at most `MOST_ROWS` labelled rows, picked by a hash of the id: features
are cut into at most `BINS` bins, and a level of a tree is found from sums of gradients by node, feature and bin. Trees are kept as
complete binary trees in flat arrays, so scoring is a few array look-ups a level for a whole batch.

Neither labels nor language, source or id enter the statistics.

NULL and empty texts have statistics of zeros and get a score like any other. Labels that contradict
each other count as the lower. Without labelled rows every score is 0.5; with one kind of label it is near that label.
Rows with NULL or equal ids stay (NULL ids have no label). Extra columns are passed through.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows used at most; bins by feature; trees, their depth, step and penalties.
MOST_ROWS = 20_000
BINS, TREES, DEPTH, RATE, PENALTY, LEAST_WEIGHT = 64, 80, 4, 0.15, 1.0, 2.0
KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!", b".", b",", b"?:;-'\"", b"\n")
N_FEATURES = len(KINDS) + 13


def statistics_of(raw: bytes) -> list[float]:
    """The statistics of one text."""
    words = raw.split()
    if not words:
        return [0.0] * N_FEATURES
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = [float(counts[list(kind)].sum()) / len(raw) for kind in KINDS]
    n = len(words)
    seen = Counter(words)
    top = seen.most_common(2)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return [
        *shares,
        float(counts[128:].sum()) / len(raw),
        float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), float((lengths <= 3).mean()), float((lengths >= 14).mean()),
        len(seen) / n, top[0][1] / n, (top[1][1] if len(top) > 1 else 0) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), n / len(lines), len(seen) / np.sqrt(n),
    ]


def statistics(text: str | Column) -> Column:
    """Array of statistics of every whole text."""

    @F.arrow_udf("array<float>")
    def rows(texts: pa.Array) -> pa.Array:
        values = [statistics_of(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
        flat = pa.array(np.array(values, np.float32).reshape(-1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * N_FEATURES), flat)

    return rows(text)


@dataclass
class Trees:
    """Flat complete trees: node k has the children 2k+1 (up to the cut) and 2k+2 (above it)."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for labels 0 and 1."""
    if len(y) == 0:
        return Trees(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)))
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    n, n_features = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    inner, total = 2**DEPTH - 1, np.full(n, base)
    features, cuts, leaves = [], [], []
    offsets = np.arange(n_features) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at_bin = np.full(inner, BINS)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (n_features * BINS) + offsets + binned).reshape(-1)
            shape = (width, n_features, BINS)
            sums = [np.bincount(cell, np.repeat(v, n_features), width * n_features * BINS).reshape(shape) for v in (gradient, weight)]
            g, h = (s.cumsum(axis=2) for s in sums)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + PENALTY) + (all_g - g) ** 2 / (all_h - h + PENALTY) - all_g**2 / (all_h + PENALTY)
            gain[(h < LEAST_WEIGHT) | (all_h - h < LEAST_WEIGHT)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k, b in enumerate(best):
                f, at = divmod(int(b), BINS)
                if gain[k, f, at] > 1e-9 and at < len(edges[f]):
                    feature[first + k], cut[first + k], at_bin[first + k] = f, edges[f][at], at
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > at_bin[node])
        place = node - inner
        sums_g, sums_h = np.bincount(place, gradient, inner + 1), np.bincount(place, weight, inner + 1)
        leaf = -RATE * sums_g / (sums_h + PENALTY)
        total += leaf[place]
        features.append(feature), cuts.append(cut), leaves.append(leaf)
    return Trees(base, np.array(features), np.array(cuts), np.array(leaves))


def fit(described: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Trees:
    """Trees from `described` (`doc_id`, `statistics`) and `labels` (`doc_id`, `quality`), on a sample bounded by `most_rows`."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = described.join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).select("statistics", "quality").toArrow()
    x = np.array(rows.column(0).to_pylist(), np.float64).reshape(-1, N_FEATURES)
    return grow(x, np.array(rows.column(1).to_pylist(), np.float64))


def score(values: str | Column, trees: Trees) -> Column:
    """Probability of label 1, from statistics."""

    @F.arrow_udf("double")
    def probability(batch: pa.Array) -> pa.Array:
        return pa.array(trees.scores(batch.flatten().to_numpy().reshape(-1, N_FEATURES).astype(np.float64)))

    return probability(values)
