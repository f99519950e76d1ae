"""Packing by a cutting-stock linear program with column generation.

Documents are encoded and cut at multiples of the sequence length; the rest of each is one piece. Piece lengths are
rounded up to classes of `UNIT` ids, so the program's size is fixed however many documents there are. The program
covers the class counts with as few sequences as it can; a knapsack over the capacity prices new patterns. Whole parts
of the solution are taken, the small rest is filled pattern by pattern with bounded knapsacks. Every piece has a rank
in its class (task, place within the task); ranks map to pattern slots by offset.

Only class counts (at most length / UNIT rows) and patterns reach the driver. No piece list, no group of pieces.

Defined results: null text is empty; every document, empty ones too, ends with `end_id`; equal rows are packed each on
its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.llm.base import stored
from foldwright.llm.token_files import encoded

UNIT = 16
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, class int, nth long"


def _cut_pieces(tokenizer: str, end_id: int, length: int, unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(length // unit + 1, dtype=np.int64)
        for rows, ids, ends in encoded(batches, tokenizer, end_id):
            sizes = np.diff(ends, prepend=0)
            parts = -(-sizes // length)
            row = np.repeat(np.arange(len(sizes)), parts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * length
            n = np.minimum(length, sizes[row] - start)
            raw = memoryview(ids.astype("<u4").tobytes())
            begin = (ends - sizes)[row] + start
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + n).tolist(), strict=True)]
            kind = -(-n // unit)
            order = np.argsort(kind, kind="stable")
            counts = np.bincount(kind, minlength=len(seen))
            nth = np.empty(len(kind), dtype=np.int64)
            nth[order] = np.arange(len(kind)) - np.repeat(np.cumsum(counts) - counts, counts)
            nth += seen[kind]
            seen += counts
            yield pa.record_batch(
                [rows.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, n, sums, sizes[row], np.full(len(n), task)))
                 , pa.array(kind, pa.int32()), pa.array(nth, pa.int64())],
                names=[c.split()[0] for c in _PIECES.split(", ")],
            )

    return run


def best_pattern(values: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable multiset of weights within the capacity."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = weights <= room
        gains = np.where(fits, values + best[np.where(fits, room - weights, 0)], -1.0)
        k = int(np.argmax(gains))
        best[room], choice[room] = best[room - 1], -1
        if gains[k] > best[room] + 1e-12:
            best[room], choice[room] = gains[k], k
    counts, room = np.zeros(len(weights), dtype=np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= weights[choice[room]]
    return float(best[capacity]), counts


def fullest_pattern(counts: np.ndarray, weights: np.ndarray, capacity: int) -> np.ndarray:
    """Bounded knapsack: the fullest sequence that the remaining pieces allow, with the largest of them in it."""
    largest = int(np.flatnonzero(counts)[np.argmax(weights[counts > 0])])
    out = np.zeros(len(counts), dtype=np.int64)
    out[largest] = 1
    room = capacity - int(weights[largest])
    items = []
    for k in np.flatnonzero(counts - out)[::-1]:
        left, step = int(min((counts - out)[k], room // weights[k])), 1
        while left > 0:  # binary splitting of the multiplicity
            take = min(step, left)
            items.append((int(k), take))
            left, step = left - take, step * 2
    reach = np.zeros(room + 1, dtype=bool)
    reach[0] = True
    first_with = np.full(room + 1, -1)
    for i, (k, take) in enumerate(items):
        w = int(weights[k]) * take
        if w <= room:
            new = np.zeros_like(reach)
            new[w:] = reach[: room + 1 - w]
            new &= ~reach
            first_with[new] = i
            reach |= new
    at = int(np.flatnonzero(reach)[-1])
    while at > 0:
        k, take = items[first_with[at]]
        out[k] += take
        at -= int(weights[k]) * take
    return out


def cutting_stock(demand: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns {weight: pieces} and how often each is used; together they hold exactly `demand`."""
    weights = np.array(sorted(demand), dtype=np.int64)
    need = np.array([demand[int(w)] for w in weights], dtype=np.int64)
    m = len(weights)
    if not m:
        return []
    basis = np.diag(capacity // weights).astype(float)
    inverse = np.diag(1.0 / (capacity // weights))
    amounts = inverse @ need
    for _ in range(40 * m):  # more rounds would only shave fractions of sequences off
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(prices, weights, capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ pattern
        usable = direction > 1e-9
        if not usable.any():
            break
        ratios = np.where(usable, amounts / np.where(usable, direction, 1), np.inf)
        leaves = int(np.argmin(ratios))
        step = ratios[leaves]
        amounts = np.maximum(amounts - step * direction, 0)
        amounts[leaves] = step
        inverse[leaves] /= direction[leaves]
        others = np.arange(m) != leaves
        inverse[others] -= np.outer(direction[others], inverse[leaves])
        basis[:, leaves] = pattern
    out: list[tuple[int, dict[int, int]]] = []
    left = need.copy()

    def use(pattern: np.ndarray, times: int) -> None:
        used = np.flatnonzero(pattern)
        out.append((times, {int(weights[k]): int(pattern[k]) for k in used}))
        left[used] -= times * pattern[used]

    for k in np.argsort(-amounts, kind="stable"):
        pattern = np.rint(basis[:, k]).astype(np.int64)
        used = pattern > 0
        times = min(int(amounts[k] + 1e-6), int((left[used] // pattern[used]).min()))
        if times > 0:
            use(pattern, times)
    while left.any():
        pattern = fullest_pattern(left, weights, capacity)
        used = pattern > 0
        use(pattern, int((left[used] // pattern[used]).min()))
    return out


def slot_table(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per class: first rank of each pattern's slots, pieces of the class in one sequence, the pattern's first sequence."""
    table: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, pattern in patterns:
        for kind, pieces in pattern.items():
            table.setdefault(kind, []).append((taken.get(kind, 0), pieces, sequence))
            taken[kind] = taken.get(kind, 0) + times * pieces
        sequence += times
    return {kind: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for kind, rows in table.items()}


def _to_sequences(slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = (batch.column(c).to_numpy() for c in ("class", "rank"))
            sequence = np.empty(len(kind), dtype=np.int64)
            for k in np.unique(kind):
                mine = kind == k
                first, pieces, begin = slots[int(k)]
                at = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine] = begin[at] + (rank[mine] - first[at]) // pieces[at]
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence)], names=[*batch.schema.names[:5], "sequence_id"])

    return run


def pack(documents: DataFrame, tokenizer: str, end_id: int, length: int = 4096, unit: int = UNIT) -> DataFrame:
    """Every piece of `documents` (doc_id, text) with the sequence it stands in and its offset there."""
    if length % unit:
        raise ValueError("the sequence length must be a multiple of the unit")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(rows.mapInArrow(_cut_pieces(tokenizer, end_id, length, unit), _PIECES), "pieces")
    per_task = pieces.groupBy("class", "task").agg(F.count("*").alias("n"))
    demand = {r["class"]: r["n"] for r in per_task.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    slots = slot_table(cutting_stock(demand, length // unit))
    earlier = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("class", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["class", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("before") + F.col("nth")).alias("rank")
    )
    placed = ranked.mapInArrow(_to_sequences(slots), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    # A sequence holds at most length / unit pieces.
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
