"""Near-duplicate documents by SimHash, pairs found by meeting in the middle of their Hamming balls.

Two fingerprints that differ in at most three bits: one differing bit lies in some block of the 64 bits, the at most two
others are split, one flip on either side. So every distinct fingerprint emits, for each of three blocks (21, 21 and 22
bits), its bits outside the block as they are and with each single bit flipped (half the radius): 131 variants, each
with a short rest from which the fingerprint is restored. Variants are shuffled; only fingerprints that meet on one are
looked at.

In a bucket no pairs are listed. Equal blocks differ in two bits at most: a star around the first. Blocks one bit
apart differ in three at most: a star to that block's first. Three bits inside one block meet with no other flip. Every
other split of three bits meets in another block's bucket. So all links up to three bits connect and none beyond. A
bucket holds fingerprints that agree outside one block but for a flip, so it stays far below a task's memory.

Defined results: null text is empty; a text without words has fingerprint zero and links like any other; equal
fingerprints are one node; repeated rows keep a row each; a null id never names a component while another id is in it;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.base import row_key, rows_of_keys, stored, text_slices
from foldwright.llm.graph import components

BLOCKS = (21, 21, 22)
_STARTS = np.cumsum((0, *BLOCKS[:-1])).astype(np.uint64)
_SIZES = np.array(BLOCKS, dtype=np.uint64)
#: A variant: the block's number above the bits outside it. Its rest: the flip (0: none) above the bits inside the block.
_OUTSIDE = np.uint64(48)
_INSIDE = np.uint64(22)
_ONE = np.uint64(1)
_PART = 1 << 16


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """SimHash over word shingles: a bit is set where more than half of the shingle hashes have it."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    size = words if len(parts) >= words else len(parts)
    runs = zip(*(itertools.islice(parts, k, None) for k in range(size)), strict=False)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    counts, total = np.zeros(64, dtype=np.int64), 0
    while some := list(itertools.islice(runs, _PART)):
        hashes = np.fromiter((digest(join(s), seed) for s in some), dtype="<u8", count=len(some))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(some)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches):
            values = np.array([fingerprint(t, words, seed) for t in rows.column("text").to_pylist()], dtype=np.uint64)
            yield pa.record_batch([rows.column("doc_id"), rows.column("row_key"), pa.array(values.view(np.int64))], names=["doc_id", "row_key", "fp"])

    return run


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for block, (start, size) in enumerate(zip(_STARTS, _SIZES, strict=True)):
            inside = (fp >> start) & ((_ONE << size) - _ONE)
            # The bits above the last block are none; two shifts, as one by 64 is not defined.
            outside = fp & ((_ONE << start) - _ONE) | ((fp >> start >> size) << start)
            flips = np.arange(65 - BLOCKS[block], dtype=np.uint64)
            masks = np.where(flips == 0, np.uint64(0), _ONE << (np.maximum(flips, _ONE) - _ONE))
            keys = (outside[:, None] ^ masks).ravel() | (np.uint64(block) << _OUTSIDE)
            rests = (inside[:, None] | (flips << _INSIDE)).ravel()
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(rests.astype(np.int32))], names=["key", "rest"])


def restored(key: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, bits inside the block and flip (0: none) of variants."""
    key, rest = key.view(np.uint64), rest.astype(np.uint64)
    block = (key >> _OUTSIDE).astype(np.int64)
    start, size = _STARTS[block], _SIZES[block]
    inside, flip = rest & ((_ONE << _INSIDE) - _ONE), rest >> _INSIDE
    outside = (key & ((_ONE << _OUTSIDE) - _ONE)) ^ np.where(flip == 0, np.uint64(0), _ONE << (np.maximum(flip, _ONE) - _ONE))
    high = (outside >> start << start) << (size - _ONE) << _ONE
    return outside & ((_ONE << start) - _ONE) | (inside << start) | high, inside.astype(np.int64), flip.astype(np.int64)


def link_buckets(key: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Verified links (rows of two fingerprints) that connect what the buckets of sorted `key` connect."""
    same = key[1:] == key[:-1]
    met = np.zeros(len(key), dtype=bool)
    met[1:] |= same
    met[:-1] |= same
    key = key[met]
    if not len(key):
        return np.zeros((0, 2), np.uint64)
    fp, inside, flip = restored(key, rest[met])
    bits = int(_INSIDE)
    bucket = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])).astype(np.int64)
    place = bucket << bits | inside
    order = np.argsort(place, kind="stable")
    place, values, plain = place[order], fp[order], flip[order] == 0
    places, first, which = np.unique(place, return_index=True, return_inverse=True)
    heads = values[first]
    links = [np.stack([values, heads[which]], axis=1)]

    def meet(at: np.ndarray, who: np.ndarray, masks: list[int]) -> None:
        for mask in masks:
            other = at ^ mask
            found = np.minimum(np.searchsorted(at, other), len(at) - 1)
            hit = (at[found] == other) & (other > at)
            if hit.any():
                links.append(np.stack([who[hit], who[found[hit]]], axis=1))

    single = [1 << k for k in range(bits)]
    meet(places, heads, single)
    several = np.bincount(place[plain] >> bits, minlength=int(bucket[-1]) + 1) > 1
    chosen = plain & several[place >> bits]
    if chosen.any():
        at, head = np.unique(place[chosen], return_index=True)
        meet(at, values[chosen][head], [a | b | c for a, b, c in itertools.combinations(single, 3)])
    out = np.concatenate(links)
    distance = np.bitwise_count(out[:, 0] ^ out[:, 1])
    return np.unique(np.sort(out[(distance > 0) & (distance <= 3)], axis=1), axis=0)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by variant; a bucket that goes on in the next batch waits for it."""
    keys, rests = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def links(k: np.ndarray, r: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = link_buckets(k, r).view(np.int64)
        if len(pairs):
            yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        rests = np.concatenate([rests, batch.column("rest").to_numpy()])
        whole = int(np.searchsorted(keys, keys[-1]))
        if whole > _PART:
            yield from links(keys[:whole], rests[:whole])
            keys, rests = keys[whole:], rests[whole:]
    if len(keys):
        yield from links(keys, rests)


def _grouped(documents: DataFrame, words: int, seed: int) -> DataFrame:
    """doc_id, row_key (digest of id and text), fp, root (one fingerprint per component) and component_id of every row."""
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), text.alias("text"))
    prints = stored(rows.mapInArrow(_fingerprints(words, seed), "doc_id long, row_key long, fp long"), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "fingerprint-nodes")
    variants = nodes.select("fp").mapInArrow(_emit, "key long, rest int")
    links = variants.repartition("key").sortWithinPartitions("key").mapInArrow(_link, "a long, b long").distinct()
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = stored(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "fingerprint-roots")
    smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = stored(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fingerprint-components")
    return prints.join(named, "fp")


def simhash_groups(documents: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over links of 3 bits or fewer)."""
    return _grouped(documents, words, seed).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_groups(documents: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """One row of `documents` per component: that of the smallest doc_id, then of the smallest digest; all columns stay."""
    rows = _grouped(documents, words, seed)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("first"))
    kept = stored(first.select(F.col("first.row_key").alias("kept_row_key")), "kept-rows")
    return rows_of_keys(documents, kept)
