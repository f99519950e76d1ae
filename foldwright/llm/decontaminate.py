"""Benchmark decontamination with spaced seeds.

Words are lower-case runs of ASCII letters and digits and of all other characters beyond ASCII. A mask keeps five word
positions of a short window and ignores the others; the kept words' hash is a seed. Masks are fixed so that any aligned
window of 10 to 20 words with one word in five substituted has a seed in common with the benchmark item; the tests
count all such patterns. Every seed of every document, to the end of its text, is looked up among the benchmark's
seeds. A hit fixes an alignment; the item is then compared word by word along it, and the best window of 20 words (the
whole item when it is shorter) counts. A document contains an item when at least four in five words of a window agree.
Items of fewer than five words have one seed, the hash of all their words.

Repeated words share a seed at many places. Hits are counted per text and item first; where they outnumber the
alignments, all alignments of the two are compared instead, so work is at most one comparison per alignment and word.

The benchmark is cut into slices of bounded size, so what is broadcast never grows; documents are read once per slice
and never shuffled. Work in a task is a few arrays over 4 MB of text.

Defined results: items without words match nothing; those of fewer than 10 words must match in full; null texts are
empty; an input column's name never clashes with an inner one; repeated rows give a row each; other columns are ignored; an empty benchmark or table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.base import free_name, text_bytes, text_slices
from foldwright.llm.runs import hash_runs, mix, spread_index, word_runs

MASKS = ("11111", "110111", "11010011")
WINDOW = 20
LEAST_WORDS = 5
FULL_BELOW = 10
#: Hits, and words compared, that are held at once; one item is compared as a whole.
MOST_AT_ONCE = 1 << 20
#: Characters of benchmark text in one slice; its arrays take about 50 bytes a character at most.
SLICE_CHARS = 2_000_000
_FILTER_BITS = 22
_WEIGHTS = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows one after the other, and where the words of each row begin (one entry more than rows)."""
    data, offsets = text_bytes(column)
    starts, lengths, firsts = word_runs(data, offsets)
    return hash_runs(data, starts, lengths), firsts


def _seeds(words: np.ndarray, row: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes of a mask and the positions of their windows, which lie in one row."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for k in (k for k, bit in enumerate(mask) if bit == "1"):
        total += words[k : k + n] * _WEIGHTS[k]
    at = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
    return mix(total[at]), at


def _cuts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of one element at least with a sum of about `most`."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(first, last)
        first = last


class _Places:
    """The places of a mask's seeds in the items: one group per seed and item, and the groups of each seed together."""

    def __init__(self, seeds: np.ndarray, item: np.ndarray, place: np.ndarray):
        order = np.lexsort((place, item, seeds))
        seeds, item, self.place = seeds[order], item[order], place[order]
        new = np.ones(len(seeds), dtype=bool)
        new[1:] = (seeds[1:] != seeds[:-1]) | (item[1:] != item[:-1])
        self.first = np.flatnonzero(new)
        self.seed, self.item = seeds[self.first], item[self.first]
        self.count = np.diff(np.append(self.first, len(seeds)))
        present = np.zeros(1 << _FILTER_BITS, dtype=bool)
        present[(seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.present = np.packbits(present)

    def met(self, seeds: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and the groups with their seed, some at a time."""
        slot = (seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
        near = np.flatnonzero((self.present[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
        left = np.searchsorted(self.seed, seeds[near], "left")
        count = np.searchsorted(self.seed, seeds[near], "right") - left
        for part in _cuts(count, MOST_AT_ONCE):
            yield np.repeat(at[near[part]], count[part]), spread_index(left[part], count[part])


class Benchmark:
    """Seeds and words of one slice of the benchmark."""

    def __init__(self, ids: list, texts: list[str]):
        self.words, self.firsts = words_of(pa.array(texts, pa.large_string()))
        self.ids = ids
        lengths = np.diff(self.firsts)
        row = np.repeat(np.arange(len(ids)), lengths)
        self.tables = []
        for mask in (*MASKS, *("1" * n for n in range(1, LEAST_WORDS) if (lengths == n).any())):
            seeds, at = _seeds(self.words, row, mask)
            usable = (lengths >= LEAST_WORDS if mask in MASKS else lengths == len(mask))[row[at]]
            seeds, at = seeds[usable], at[usable]
            self.tables.append((mask, _Places(seeds, row[at], at - self.firsts[row[at]])))

    def matches(self, column: pa.Array) -> dict[str, np.ndarray]:
        """The best window per (row, item) that reaches the limit."""
        words, firsts = words_of(column)
        out = [self._verified(words, firsts, pairs) for pairs in self._alignments(words, firsts)]
        return _best({name: np.concatenate([o[name] for o in out]) if out else np.zeros(0) for name in ("row", "item", "similarity", "first_word", "n_words", "item_words")})

    def _alignments(self, words: np.ndarray, firsts: np.ndarray) -> Iterator[np.ndarray]:
        """(row, item, word position where the item would begin) of every seed in common, some at a time."""
        row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        seeds = [(table, *_seeds(words, row, mask)) for mask, table in self.tables]
        key = lambda table, at, group: row[at] * len(self.ids) + table.item[group]
        counted = []
        for table, mine, at in seeds:
            for spot, group in table.met(mine, at):
                keys, inverse = np.unique(key(table, spot, group), return_inverse=True)
                counted.append((keys, np.bincount(inverse, weights=table.count[group], minlength=len(keys))))
        if not counted:
            return
        pair, inverse = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
        hits = np.bincount(inverse, weights=np.concatenate([n for _, n in counted]), minlength=len(pair))
        pair_row, pair_item = pair // len(self.ids), pair % len(self.ids)
        size = np.diff(self.firsts)[pair_item]
        ways = np.diff(firsts)[pair_row] + size - 1
        dense = hits > ways
        # A hit as one number: its pair, and the begin moved so that it is not negative.
        longest = int(size.max(initial=0))
        single = [np.zeros(0, np.int64)]
        for table, mine, at in seeds:
            for spot, group in table.met(mine, at):
                which = np.searchsorted(pair, key(table, spot, group))
                thin = ~dense[which]
                which, spot, group = which[thin], spot[thin], group[thin]
                n = table.count[group]
                begin = np.repeat(spot, n) - table.place[spread_index(table.first[group], n)]
                single.append(np.unique((np.repeat(which, n) << 32) + begin + longest))
        hit = np.unique(np.concatenate(single))
        # Dense pairs are runs of begins, cut so that a run is compared at once.
        run = np.maximum(1, MOST_AT_ONCE // size)
        runs = np.where(dense, -(-ways // run), 0)
        of = np.repeat(np.arange(len(pair)), runs)
        start = spread_index(np.zeros_like(runs), runs) * run[of]
        which = np.concatenate([hit >> 32, of])
        begin = np.concatenate([(hit & 0xFFFFFFFF) - longest, firsts[pair_row[of]] - size[of] + 1 + start])
        count = np.concatenate([np.ones(len(hit), np.int64), np.minimum(run[of], ways[of] - start)])
        for part in _cuts(count * size[which], MOST_AT_ONCE):
            n = count[part]
            yield np.stack([np.repeat(pair_row[which[part]], n), np.repeat(pair_item[which[part]], n), spread_index(begin[part], n)], axis=1)

    def _verified(self, words: np.ndarray, firsts: np.ndarray, pairs: np.ndarray) -> dict[str, np.ndarray]:
        row, item, begin = pairs.T
        size = np.diff(self.firsts)[item]
        spot = spread_index(begin, size)
        owner = np.repeat(np.arange(len(pairs)), size)
        inside = (spot >= firsts[row][owner]) & (spot < firsts[row + 1][owner])
        same = inside & (words[np.where(inside, spot, 0)] == self.words[spread_index(self.firsts[item], size)])
        window = np.minimum(WINDOW, size)
        need = np.where(size < FULL_BELOW, size, -(-4 * window // 5))
        running = np.concatenate([[0], np.cumsum(same)])
        heads = np.cumsum(size) - size
        choices = size - window + 1
        start = spread_index(heads, choices)
        agreed = running[start + np.repeat(window, choices)] - running[start]
        best = np.maximum.reduceat(agreed, np.cumsum(choices) - choices) if len(pairs) else agreed
        first_best = np.flatnonzero(agreed == np.repeat(best, choices))
        of = np.repeat(np.arange(len(pairs)), choices)[first_best]
        _, once = np.unique(of, return_index=True)
        shift = start[first_best[once]] - heads
        good = best >= need
        return _best({
            "row": row[good], "item": item[good], "similarity": (best / window)[good], "first_word": (begin + shift - firsts[row])[good],
            "n_words": window[good], "item_words": size[good],
        })


def _best(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The best alignment of each item in each row, the first one among equals."""
    order = np.lexsort((found["first_word"], -found["similarity"], found["item"], found["row"]))
    row_item = np.stack([found["row"][order], found["item"][order]])
    keep = order[np.concatenate([[True], (row_item[:, 1:] != row_item[:, :-1]).any(axis=0)])] if len(order) else order
    return {name: values[keep] for name, values in found.items()}


def benchmark_slices(benchmark: DataFrame, slice_chars: int = SLICE_CHARS) -> Iterator[Benchmark]:
    """The benchmark (item_id, text) in slices of about `slice_chars` characters, one in memory at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = -(-total // slice_chars)
    for k in range(slices):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield Benchmark([r["item_id"] for r in rows], [r["text"] for r in rows])


_MATCHES = "doc_id long, item_id long, similarity double, first_word long, n_words long, item_words long"


def _matching(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = shared.value
        for rows in text_slices(batches):
            found = bench.matches(rows.column("text"))
            yield pa.record_batch(
                [
                    rows.column("doc_id").take(pa.array(found["row"].astype(np.int64))),
                    pa.array([bench.ids[k] for k in found["item"].astype(np.int64)], pa.int64()),
                    pa.array(found["similarity"], pa.float64()),
                    *(pa.array(found[n].astype(np.int64)) for n in ("first_word", "n_words", "item_words")),
                ],
                names=["doc_id", "item_id", "similarity", "first_word", "n_words", "item_words"],
            )

    return run


def contaminated(documents: DataFrame, benchmark: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """One row per document and benchmark item that it contains, with the best window's place and similarity."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    parts = [rows.mapInArrow(_matching(spark.sparkContext.broadcast(b)), _MATCHES) for b in benchmark_slices(benchmark, slice_chars)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _MATCHES)


def _clean_rows(shared, lowered: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, lowered):
            found = shared.value.matches(rows.column(rows.schema.get_field_index(lowered)))["row"].astype(np.int64)
            keep = np.ones(rows.num_rows, dtype=bool)
            keep[found] = False
            yield rows.filter(pa.array(keep)).select(names)

    return run


def decontaminated(documents: DataFrame, benchmark: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """`documents` without those that contain a benchmark item; all columns stay, nothing is shuffled."""
    out, names = documents, documents.columns
    lowered = free_name(documents, "lower_case_text")
    for bench in benchmark_slices(benchmark, slice_chars):
        shared = documents.sparkSession.sparkContext.broadcast(bench)
        marked = out.withColumn(lowered, F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))))
        out = marked.mapInArrow(_clean_rows(shared, lowered, names), documents.schema)
    return out
