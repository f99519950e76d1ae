"""One document of each group of near copies: five-word shingle sets with a Jaccard similarity of at least 0.8.

Documents with equal shingle sets fold to one node. A node has eight independent fingerprints of seven places; a place
holds the least of one hash over the shingles, so two nodes agree on it with the probability of their similarity. Each
fingerprint is looked up by ball hashing with radius one: it emits seven variants, each without one place, and nodes meet
on a variant when at most one place differs. At a similarity of 0.8 a fingerprint meets with probability 0.577, one of
eight with 0.999; above 0.8 more.

Meeting is only a candidate. In a bucket, each node is paired with the bucket's smallest node and with the next four in
an order of the bucket's own, around a ring: all pairs of up to nine nodes, and a linear number beyond. Shingle sets are
compared exactly, first along the stars; ring pairs follow where the stars have not connected both sides yet. Only texts
of candidates are joined.

Defined results: words are split at ASCII blanks after ASCII lower-casing; a text of fewer than five words is one
shingle; texts without words (and null texts) are equal; groups are connected over links; rows equal in id and text are
one; a null id stays only where no other is in its group; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.base import row_key, rows_of_keys, stored, text_slices
from foldwright.llm.graph import components
from foldwright.llm.runs import mix

WORDS = 5
#: Least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
PRINTS, PLACES = 8, 7
RING = 4
_PART = 1 << 16
_ORDER = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_FACTORS = (mix(np.arange(101, 101 + PRINTS * PLACES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (mix(np.arange(301, 301 + PRINTS * PLACES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_PLACE = mix(np.arange(501, 501 + PRINTS * PLACES, dtype=np.uint64)).reshape(PRINTS, PLACES) | np.uint64(1)
_VARIANT = mix(np.arange(701, 701 + PRINTS * PLACES, dtype=np.uint64)).reshape(PRINTS, PLACES)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words."""
    parts = text.encode().lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64, count=len(parts))
    size = min(words, len(hashes))
    n = len(hashes) - size + 1 if size else 0
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _ORDER[k]
    return np.unique(mix(total))


def places(shingles: np.ndarray) -> np.ndarray:
    """The least of every hash over a shingle set: the places of all fingerprints, one after the other."""
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_FACTORS), np.iinfo(np.uint32).max, dtype=np.uint32)
    for k in range(0, len(high), 1024):
        np.minimum(out, (high[k : k + 1024] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1), out=out)
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in text_slices(batches):
        sets = [shingle_set(t) for t in rows.column("text").to_pylist()]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
        marks = pa.array([places(s).tobytes() for s in sets], pa.binary())
        yield pa.record_batch([rows.column("doc_id"), rows.column("row_key"), pa.array(node), marks], names=["doc_id", "row_key", "node", "marks"])


def variants(marks: np.ndarray) -> np.ndarray:
    """Keys of the fingerprints (rows of places) with each place left out in turn."""
    parts = marks.reshape(-1, PRINTS, PLACES).astype(np.uint64) * _PLACE
    return mix(parts.sum(axis=2, keepdims=True, dtype=np.uint64) - parts + _VARIANT).reshape(len(marks), -1)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = variants(np.frombuffer(b"".join(batch.column("marks").to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1))
        node = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
        yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(node)], names=["key", "node"])


def bucket_pairs(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (a < b) of rows sorted by key and node, and whether a is the bucket's smallest node."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    start, count = np.repeat(first, size), np.repeat(size, size)
    place = np.arange(len(key)) - start
    tail = place > 0
    a, b = [node[start[tail]]], [node[tail]]
    ring = node[np.lexsort((mix(node.view(np.uint64) ^ mix(key.view(np.uint64))), start))]
    for step in range(1, RING + 1):
        # The star has all pairs of two nodes; in a ring of 2 * step nodes or fewer each pair is met from one side only.
        some = (count > 2) & (count > step)
        one, two = ring[some], ring[start[some] + (place[some] + step) % count[some]]
        head = node[start[some]]
        new = (one != head) & (two != head)
        a.append(np.minimum(one, two)[new])
        b.append(np.maximum(one, two)[new])
    star = np.zeros(sum(map(len, a)), dtype=bool)
    star[: len(a[0])] = True
    return np.concatenate(a), np.concatenate(b), star


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows sorted by key and node; a bucket that goes on in the next batch waits for it."""
    keys, nodes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pairs(k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b, star = bucket_pairs(k, n)
        for at in range(0, len(a), _PART):
            yield pa.record_batch([pa.array(x[at : at + _PART]) for x in (a, b, star)], names=["a", "b", "star"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        nodes = np.concatenate([nodes, batch.column("node").to_numpy()])
        whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if whole > _PART:
            yield from pairs(keys[:whole], nodes[:whole])
            keys, nodes = keys[whole:], nodes[whole:]
    if len(keys):
        yield from pairs(keys, nodes)


def similar(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether two shingle sets reach the least similarity; two empty sets do."""
    few, many = sorted((len(left), len(right)))
    if few * LEAST[1] < many * LEAST[0]:
        return False
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both * LEAST[1] >= (few + many - both) * LEAST[0]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, known = None, None
    for batch in batches:
        good = np.zeros(batch.num_rows, dtype=bool)
        for k, (a, left, right) in enumerate(zip(*(batch.column(c) for c in ("a", "left", "right")), strict=True)):
            # Rows of one node follow each other.
            if a.as_py() != last:
                last, known = a.as_py(), shingle_set(left.as_py())
            good[k] = similar(known, shingle_set(right.as_py()))
        yield batch.select(["a", "b"]).filter(pa.array(good))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""
    right = pairs.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")).hint("merge"), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")).hint("merge"), "a")
    return both.select("a", "b", "left", "right").mapInArrow(_compared, "a long, b long")


def near_copy_roots(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(node, root) of the nodes (node, marks, first) that have a link; the root is the smallest node reachable."""
    emitted = nodes.select("node", "marks").mapInArrow(_emit, "key long, node long")
    met = emitted.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_candidates, "a long, b long, star boolean")
    pairs = stored(met.groupBy("a", "b").agg(F.max("star").alias("star")), "near-copy-candidates")
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    keys = nodes.select("node", F.col("first.row_key").alias("row_key")).join(involved, "node")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = stored(
        documents.select(row_key().alias("row_key"), text.alias("text")).join(keys.hint("merge"), "row_key").dropDuplicates(["row_key"]).select("node", "text"),
        "near-copy-texts",
    )
    stars = stored(components(stored(_links(pairs.where("star"), texts), "near-copy-stars")), "near-copy-star-roots")
    rest = pairs.where("not star").select("a", "b")
    for side in ("a", "b"):
        rest = rest.join(stars.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    rest = rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    more = stored(_links(stored(rest.select("a", "b"), "near-copy-rest"), texts), "near-copy-ring")
    return components(more.union(stars.select("root", "node")))


def first_of_near_copies(documents: DataFrame) -> DataFrame:
    """One row of `documents` per group: that of the smallest doc_id, then of the smallest digest; all columns stay."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.col("text").cast("string").alias("text"))
    prints = rows.mapInArrow(_nodes, "doc_id long, row_key long, node long, marks binary")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("first")
    nodes = stored(prints.groupBy("node").agg(first, F.first("marks").alias("marks")), "near-copy-nodes")
    roots = near_copy_roots(nodes, documents)
    named = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return rows_of_keys(documents, stored(named.select(F.col("first.row_key").alias("kept_row_key")), "kept-rows"))
