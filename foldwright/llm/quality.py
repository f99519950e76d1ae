"""Document quality by histogram gradient-boosted trees over document statistics.

Statistics are counted in numpy over the bytes, words and lines of whole texts. Trees are grown level by level from
histograms of binned statistics and stored as flat arrays (feature, threshold, leaf value per complete tree); scoring
walks all rows of a batch through one tree level at a time.

The fit takes a bounded sample of labelled rows (`most_rows`), in digest order of the id and outside the held-out
fold. Scoring reads every whole text once and shuffles nothing.

Defined results: a null or empty text has all statistics zero and a score like any other; repeated rows keep a row
each; when the sample has one label only, every score is that label's share; 0.5 without labels; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.base import text_bytes, text_slices
from foldwright.llm.labelled import held_out, sample, training_labels
from foldwright.llm.runs import hash_runs, word_runs

MOST_ROWS = 20_000
BINS = 64
DEPTH = 5
TREES = 80
RATE = 0.12
_FILLED = np.ones(256, dtype=bool)
_FILLED[[9, 10, 11, 12, 13, 32]] = False
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False


def _bytes(*codes: int) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(codes)] = True
    return out


_CLASSES = {
    "upper": _bytes(*range(65, 91)), "lower": _bytes(*range(97, 123)), "digit": _bytes(*range(48, 58)), "space": ~_FILLED, "beyond_ascii": _bytes(*range(128, 256)),
    "stop": _bytes(46, 44, 59, 58, 63), "shout": _bytes(33), "bar": _bytes(124), "sign": _bytes(*b"#$%&*+=<>@[]\\^_`{}~"), "quote": _bytes(*b"\"'()-/"),
}
STATISTICS = (
    "log_bytes", "log_words", "log_lines", *(f"share_{c}" for c in _CLASSES), "word_length", "longest_word", "distinct_words", "repeated_next_words", "top_word",
    "distinct_lines", "line_length", "short_lines",
)


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `values` between neighbouring offsets."""
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return running[offsets[1:]] - running[offsets[:-1]]


def _distinct(row: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes per row, and how often its most frequent one occurs."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    heads = np.flatnonzero(new)
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, row[heads], np.diff(np.append(heads, len(row))))
    return np.bincount(row[heads], minlength=n), top


def statistics(column: pa.Array) -> np.ndarray:
    """One row of `STATISTICS` per text."""
    data, offsets = text_bytes(column)
    n = len(column)
    size = np.diff(offsets)
    starts, lengths, firsts = word_runs(data, offsets, _FILLED)
    words = np.diff(firsts)
    row = np.repeat(np.arange(n), words)
    hashes = hash_runs(data, starts, lengths)
    line_starts, line_lengths, line_firsts = word_runs(data, offsets, _LINE)
    lines = np.diff(line_firsts)
    line_row = np.repeat(np.arange(n), lines)
    distinct, top = _distinct(row, hashes, n)
    distinct_lines, _ = _distinct(line_row, hash_runs(data, line_starts, line_lengths), n)
    again = np.zeros(len(row), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    longest = np.zeros(n)
    np.maximum.at(longest, row, lengths)
    some, w, ln = np.maximum(size, 1), np.maximum(words, 1), np.maximum(lines, 1)
    out = [np.log1p(size), np.log1p(words), np.log1p(lines)]
    out += [_per_row(mask[data], offsets) / some for mask in _CLASSES.values()]
    out += [_per_row(lengths, firsts) / w, np.log1p(longest), distinct / w, np.bincount(row, weights=again, minlength=n) / w, top / w]
    out += [distinct_lines / ln, _per_row(line_lengths, line_firsts) / ln, np.bincount(line_row, weights=line_lengths < 30, minlength=n) / ln]
    return np.stack(out, axis=1).astype(np.float64)


class BoostedTrees:
    """Complete trees in flat arrays: node k of a level goes to 2k+1 or, above its threshold, to 2k+2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            z += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, smooth: float = 1.0) -> BoostedTrees:
    """Second-order boosting of the logistic loss on binned columns."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(m) * bins
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    z = np.full(n, base)
    inner = 2**depth - 1
    all_feature, all_threshold, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (m * bins) + flat).ravel()
            shape = (width, m, bins)
            sums = [np.bincount(place, weights=np.repeat(v, m), minlength=width * m * bins).reshape(shape).cumsum(axis=2) for v in (g, h)]
            total = [s[:, :, -1:] for s in sums]
            gain = sum(a[0] ** 2 / (a[1] + smooth) for a in (sums, [t - s for t, s in zip(total, sums, strict=True)])) - total[0] ** 2 / (total[1] + smooth)
            for j, e in enumerate(edges):
                gain[:, j, len(e):] = -1  # nothing lies above the last edge
            best = gain.reshape(width, -1).argmax(axis=1)
            worth = gain.reshape(width, -1).max(axis=1) > 1e-9
            feature[first : first + width] = np.where(worth, best // bins, 0)
            threshold[first : first + width] = [edges[b // bins][b % bins] if ok else np.inf for b, ok in zip(best, worth, strict=True)]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = -rate * np.bincount(node - inner, weights=g, minlength=inner + 1) / (np.bincount(node - inner, weights=h, minlength=inner + 1) + smooth)
        z += leaf[node - inner]
        all_feature.append(feature)
        all_threshold.append(threshold)
        all_leaf.append(leaf)
    return BoostedTrees(np.array(all_feature), np.array(all_threshold), np.array(all_leaf), base)


class ConstantScore:
    def __init__(self, score: float):
        self.score = score

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.score)


def _sample_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in text_slices(batches):
        values = statistics(rows.column("text"))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
        yield pa.record_batch([rows.column("doc_id"), rows.column("y"), lists], names=["doc_id", "y", "x"])


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fit_quality(documents: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS):
    """Trees from a bounded sample of labelled rows; only their statistics reach the driver."""
    chosen = sample(training_labels(labels, "quality"), most_rows)
    rows = _texts(documents).join(F.broadcast(chosen), "doc_id")
    got = rows.mapInArrow(_sample_statistics, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    y = got.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return ConstantScore(float(y.mean()) if len(y) else 0.5)
    return fit_trees(np.array(got.column("x").to_pylist()), y)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches):
            yield pa.record_batch([rows.column("doc_id"), pa.array(shared.value.scores(statistics(rows.column("text"))))], names=["doc_id", "score"])

    return run


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(fit_quality(documents, labels))
    scored = _texts(documents).mapInArrow(_score(shared), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
