"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives; all other text is unlabelled. The risk of a classifier on negatives is what
the unlabelled rows show less the class prior's share of it on positives; where that falls below zero, the step goes
back instead (the non-negative correction). Numpy classifiers are linear over presence of hashed words and of their
prefixes of 4 to 8 bytes that mark positives; each is fitted with another part of the unlabelled sample, and scores are averaged.

The fit takes bounded samples (`most_positive`, `most_unlabelled`), in digest order of the id and outside the held-out
fold; the class prior is the share of toxic rows among all training labels. Scoring reads every whole text once, in
arrays of 4 MB of text, and shuffles nothing.

Defined results: a null or empty text has the score of a text without features; repeated rows keep a row each; without
a positive or an unlabelled row in the sample every score is the class prior (0 without labels); other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.base import free_name, stored, text_bytes, text_slices
from foldwright.llm.labelled import held_out, sample, training_labels, with_texts
from foldwright.llm.runs import hash_prefixes, hash_runs, word_runs

MOST_POSITIVE = 3_000
MOST_UNLABELLED = 9_000
FEATURES = 512
MODELS = 3
PREFIXES = (4, 5, 6, 7, 8)
_SLOT_BITS = 20


def _row_slots(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, slot) of every word, then of every word's prefixes of one size after the other."""
    data, offsets = text_bytes(column)
    starts, lengths, firsts = word_runs(data, offsets)
    row = np.repeat(np.arange(len(column), dtype=np.int64), np.diff(firsts))
    for hashes in (hash_runs(data, starts, lengths), *hash_prefixes(data, starts, lengths, PREFIXES).values()):
        yield row, (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def text_slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, slot) pairs of the hashed words and word prefixes of every text."""
    joined = np.unique(np.concatenate([np.unique(row << _SLOT_BITS | slot) for row, slot in _row_slots(column)]))
    return joined >> _SLOT_BITS, joined & ((1 << _SLOT_BITS) - 1)


class PresenceModel:
    """Linear scores over the presence of chosen slots, one weight row per fitted classifier."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.index = np.full(1 << _SLOT_BITS, -1, dtype=np.int64)
        self.index[slots] = np.arange(len(slots))
        self.weights, self.bias = weights, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        chosen = []
        for row, slot in _row_slots(column):
            which = self.index[slot]
            chosen.append(np.unique(row[which >= 0] << _SLOT_BITS | which[which >= 0]))
        pairs = np.unique(np.concatenate(chosen))
        row, which = pairs >> _SLOT_BITS, pairs & ((1 << _SLOT_BITS) - 1)
        parts = [np.bincount(row, weights=w[which], minlength=len(column)) + b for w, b in zip(self.weights, self.bias, strict=True)]
        return np.mean([1 / (1 + np.exp(-np.clip(p, -40, 40))) for p in parts], axis=0)


class ConstantModel:
    def __init__(self, score: float):
        self.score = score

    def scores(self, column: pa.Array) -> np.ndarray:
        return np.full(len(column), self.score)


def fit_nnpu(row: np.ndarray, column: np.ndarray, positive: np.ndarray, features: int, prior: float, steps: int = 250, rate: float = 0.05):
    """Weights and bias of a linear classifier by the non-negative risk estimator with logistic loss (Adam steps).

    (row, column) are the features present; `positive` marks the rows of the positive sample, the rest are unlabelled.
    """
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    decay = 0.3 / n_p  # few positives are no ground for large weights
    w = np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[column], minlength=len(positive)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss_negative = np.logaddexp(0, z)
        negative_risk = loss_negative[~positive].mean() - prior * loss_negative[positive].mean()
        # Derivatives of the losses by the score: p - 1 for label 1, p for label 0.
        negative = np.where(positive, -prior * p / n_p, p / n_u)
        slope = negative + np.where(positive, prior * (p - 1) / n_p, 0) if negative_risk >= 0 else -negative
        gradient = np.append(np.bincount(column, weights=slope[row], minlength=features), slope.sum())
        gradient[:-1] += decay * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w[:-1], w[-1]


def choose_slots(rows: DataFrame, features: int) -> list[int]:
    """Slots whose share among positives exceeds that among unlabelled rows most, in standard errors (two at least).

    Counts are one aggregation over (positive, slots); only the chosen slots reach the driver.
    """
    sizes = rows.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).first()
    n_p, n_u = max(1, sizes["p"]), max(1, sizes["u"])
    counts = rows.select("positive", F.explode("slots").alias("slot")).groupBy("slot").agg(F.count_if("positive").alias("in_p"), F.count_if(~F.col("positive")).alias("in_u"))
    p, u = (F.col("in_p") + 0.5) / (n_p + 1), (F.col("in_u") + 0.5) / (n_u + 1)
    distance = (p - u) / F.sqrt(p * (1 - p) / n_p + u * (1 - u) / n_u)
    ranked = counts.where(F.col("in_p") + F.col("in_u") >= 3).withColumn("distance", F.round(distance, 9)).where("distance > 2")
    return [r["slot"] for r in ranked.orderBy(F.desc("distance"), "slot").limit(features).collect()]


def _sample_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in text_slices(batches):
        row, slot = text_slots(rows.column("text"))
        ends = np.searchsorted(row, np.arange(rows.num_rows + 1))
        slots = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(slot, pa.int32()))
        yield pa.record_batch([rows.column("doc_id"), rows.column("positive"), slots], names=["doc_id", "positive", "slots"])


def fit_toxicity(documents: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED):
    """A model from confirmed toxic rows and unlabelled text; only the chosen features of the bounded samples reach the driver."""
    known = training_labels(labels, "toxic")
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    prior = counts["toxic"] / counts["n"] if counts["n"] else 0.0
    if not 0 < prior < 1:
        return ConstantModel(prior)
    toxic = known.where("y = 1").select("doc_id")
    texts = documents.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id")
    positive = sample(toxic, most_positive).withColumn("positive", F.lit(True))
    chosen = positive.unionByName(sample(texts, most_unlabelled).withColumn("positive", F.lit(False)))
    rows = stored(with_texts(chosen, documents).mapInArrow(_sample_slots, "doc_id long, positive boolean, slots array<int>"), "toxicity-sample")
    slots = np.array(choose_slots(rows, FEATURES), dtype=np.int64)
    wanted = F.array(*(F.lit(int(s)) for s in slots)) if len(slots) else F.array().cast("array<int>")
    got = rows.select("doc_id", "positive", F.array_intersect("slots", wanted).alias("slots")).toArrow().sort_by([("positive", "ascending"), ("doc_id", "ascending")])
    mark = got.column("positive").to_numpy().astype(bool)
    lists = [np.asarray(x.values, dtype=np.int64) for x in got.column("slots")]
    if not mark.any() or mark.all():
        return ConstantModel(prior)
    index = np.full(1 << _SLOT_BITS, -1, dtype=np.int64)
    index[slots] = np.arange(len(slots))
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    column = index[np.concatenate(lists)]
    weights, bias = [], []
    part = np.arange(len(mark)) % MODELS
    for k in range(MODELS):
        use = mark | (part != k) if (~mark).sum() >= MODELS else np.ones(len(mark), dtype=bool)
        renumber = np.cumsum(use) - 1
        mine = use[row]
        w, b = fit_nnpu(renumber[row[mine]], column[mine], mark[use], len(slots), prior)
        weights.append(w)
        bias.append(b)
    return PresenceModel(slots, np.array(weights), np.array(bias))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches):
            yield pa.record_batch([rows.column("doc_id"), pa.array(shared.value.scores(rows.column("text")))], names=["doc_id", "score"])

    return run


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(fit_toxicity(documents, labels))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    scored = rows.mapInArrow(_score(shared), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep(shared, lowered: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, lowered):
            scores = shared.value.scores(rows.column(rows.schema.get_field_index(lowered)))
            yield rows.filter(pa.array(scores < 0.5)).select(names)

    return run


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """`documents` without those predicted toxic; all columns stay, nothing is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(fit_toxicity(documents, labels))
    lowered = free_name(documents, "lower_case_text")
    marked = documents.withColumn(lowered, F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return marked.mapInArrow(_keep(shared, lowered, documents.columns), documents.schema)
