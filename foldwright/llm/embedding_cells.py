"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside them, one representative a group.

Equal vectors fold to one row with a weight first. Centroids are fitted on a bounded sample (`most_sample` rows in
digest order), for each vector length apart; every vector is indexed: it is a member of its nearest cell and a visitor of each cell with a smaller
number whose centroid is nearly as close (within `margin` of the best cosine). Pairs are members with members and
members with visitors, so a pair meets in one cell at most. A pair at the threshold whose halves lie in two cells is
missed only when the later half is further than the margin from the earlier half's centroid; the tests measure recall.

Cells are cut into blocks of `block` rows by digest, and block pairs are the groups: however many vectors share a
cell, a task holds two blocks. Products are taken in double precision. A task returns, per vector, the weight of its
links and the smallest vector of its component inside the task; never pairs. Components join these labels.

Vectors of a length that the sample lacks are few; they share one cell, cut into blocks like any other.

Defined results: a vector that is null, zero, or with null or non-finite components links with nothing; vectors of
different lengths never link; equal vectors link; repeated rows keep a row each; a row without vec_id links with
nothing; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.base import stored
from foldwright.llm.graph import components

THRESHOLD = 0.9
MARGIN = 0.2
CELL_ROWS = 1024
BLOCK = 1024
MOST_SAMPLE = 20_000


def unit_rows(values: list | np.ndarray) -> np.ndarray:
    x = np.asarray(values, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids: rows go to the largest cosine, a centroid is its rows' mean direction; empty cells keep theirs."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        cell = np.concatenate([(x[i : i + 2048] @ centroids.T).argmax(axis=1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centroids)
    return centroids


def fit_cells(distinct: DataFrame, most_sample: int, cell_rows: int) -> dict[int, np.ndarray]:
    """Centroids per vector length from a bounded sample; their number grows with the table until the sample has 4 rows a cell."""
    n = distinct.count()
    rows = distinct.orderBy(F.xxhash64("vec")).limit(most_sample).select("vec").toArrow().column("vec").to_pylist()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r), []).append(r)
    cells = lambda x: max(1, min(-(-n * len(x) // (len(rows) * cell_rows)), -(-len(x) // 4)))
    return {size: spherical_kmeans(unit_rows(x), cells(x)) for size, x in by_size.items()}


def _assign(shared, margin: float):
    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column("vec").offsets.to_numpy())
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                centroids = shared.value.get(int(size))
                if centroids is None:
                    row, cell, home = np.arange(part.num_rows), np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                else:
                    cosines = unit_rows(part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)) @ centroids.T
                    home = cosines.argmax(axis=1)
                    near = cosines >= cosines.max(axis=1, keepdims=True) - margin
                    near &= np.arange(cosines.shape[1]) <= home[:, None]
                    row, cell = np.nonzero(near)
                out = part.select(["vid", "weight", "vec"]).take(pa.array(row))
                length = pa.array(np.full(len(row), size), pa.int32())
                yield pa.record_batch([*out.columns, length, pa.array(cell, pa.int32()), pa.array(cell == home[row])], names=["vid", "weight", "vec", "size", "cell", "member"])

    return run


def local_labels(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of each row's and column's component in the graph `linked` between two blocks of ids."""
    big = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        new_b = np.minimum(b, np.where(linked, a[:, None], big).min(axis=0, initial=big))
        new_a = np.minimum(a, np.where(linked, new_b, big).min(axis=1, initial=big))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        is_left = table.column("is_left").to_numpy()
        is_right = table.column("is_right").to_numpy()
        vid, weight = table.column("vid").to_numpy(), table.column("weight").to_numpy()
        x = unit_rows(table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(vid), -1))
        left, right = np.flatnonzero(is_left), np.flatnonzero(is_right)
        linked = x[left] @ x[right].T >= threshold
        linked &= left[:, None] != right[None, :]
        same_block = bool((is_left & is_right).any())
        rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        linked = linked[np.ix_(rows, columns)]
        left, right = left[rows], right[columns]
        a, b = local_labels(linked, vid[left], vid[right])
        parts = [(vid[left], linked @ weight[right], a)]
        if not same_block:
            parts.append((vid[right], linked.T @ weight[left], b))
        return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)], names=["vid", "links", "label"])

    return run


def _block_pairs(assigned: DataFrame, block: int) -> DataFrame:
    """Rows of every group (size, cell, i, j): members of block i against members of block j >= i, or visitors of block j."""
    counts = assigned.groupBy("size", "cell").agg(F.ceil(F.count_if("member") / block).cast("int").alias("m"), F.ceil(F.count_if(~F.col("member")) / block).cast("int").alias("v"))
    rows = assigned.join(counts, ["size", "cell"]).where("m > 0")
    rows = rows.withColumn("b", F.when(F.col("member"), F.pmod(F.xxhash64("vid"), "m")).otherwise(F.pmod(F.xxhash64("vid"), "v") + F.col("m")).cast("int"))
    last = F.when(F.col("member"), F.col("m") + F.col("v") - 1).otherwise(F.col("m") - 1)
    # A member's block is the left side from its own number on and the right side below it; visitors are right sides only.
    others = F.explode(F.sequence(F.lit(0), last)).alias("o")
    spread = rows.select("vid", "weight", "vec", "size", "cell", "member", "b", others)
    return spread.select(
        "vid", "weight", "vec", "size", "cell", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"),
        (F.col("member") & (F.col("b") <= F.col("o"))).alias("is_left"), (F.col("b") >= F.col("o")).alias("is_right"),
    )


def embedding_groups(
    embeddings: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, cell_rows: int = CELL_ROWS, block: int = BLOCK, most_sample: int = MOST_SAMPLE
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `embeddings` (vec_id, embedding)."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    usable = (
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
        & F.coalesce(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("vec", lambda v: v != 0), F.lit(False))
    )
    # Scaled by the largest component, so that squares neither overflow nor vanish.
    largest = F.array_max(F.transform("vec", F.abs))
    scaled = F.transform("vec", lambda v: v / largest)
    valid = stored(rows.where(usable).select("vec_id", F.col("vec").alias("raw"), scaled.alias("vec")), "vectors")
    distinct = stored(valid.groupBy("raw").agg(F.min("vec_id").alias("vid"), F.count("*").alias("weight"), F.first("vec").alias("vec")), "distinct-vectors")
    centroids = fit_cells(distinct, most_sample, cell_rows)
    if not centroids:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    shared = spark.sparkContext.broadcast(centroids)
    assigned = stored(distinct.select("vid", "weight", "vec").mapInArrow(_assign(shared, margin), "vid long, weight long, vec array<double>, size int, cell int, member boolean"), "cells")
    found = _block_pairs(assigned, block).groupBy("size", "cell", "i", "j").applyInArrow(_compare(threshold), "vid long, links long, label long")
    found = stored(found, "cell-links")
    roots = components(found.where("vid <> label").select(F.col("vid").alias("a"), F.col("label").alias("b"))).withColumnRenamed("node", "vid")
    totals = found.groupBy("vid").agg(F.sum("links").alias("links"))
    known = distinct.select("raw", "vid", "weight").join(totals, "vid", "left").join(roots, "vid", "left")
    known = stored(known.select("raw", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("root", "vid").alias("root")), "vector-classes")
    linked = valid.join(known, "raw").select("vec_id", F.col("links").alias("n_links"), F.col("root").alias("component_id"))
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: All pairs, in double precision.
EMBEDDINGS_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reached(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.y, r.c FROM reached r JOIN links l ON l.x = r.id WHERE r.c < l.y),
named AS (SELECT id, min(c) AS c FROM reached GROUP BY id),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(c, e.vec_id) AS component_id, e.vec_id = coalesce(c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN named ON named.id = e.vec_id LEFT JOIN counted ON counted.x = e.vec_id"""
