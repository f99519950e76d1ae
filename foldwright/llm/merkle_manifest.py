"""Merkle manifest of a data set: per-document proofs, and a version of the tree for every tampered leaf.

Leaves of a tree stand in order; every two consecutive nodes become their parent, an odd last one a parent of its own,
until one node is left. Nodes are immutable, so a version with another leaf copies only that leaf's ancestors and shares
all else. A tree is held in aligned blocks of 2^8 nodes: a task builds the blocks of one tier, their tops are the leaves
of the next tier, and so on until every tree is one block. Then each tier hands the path above a block down to the nodes
inside. A version copies its ancestors inside its block and goes on along the path that the upper tiers gave the block,
so no task sees more than one block. The trees' roots are the leaves of one more tree, built the same way.

Digests are lower-case hexadecimal SHA-256 of joined text. Defined results: null and empty values are distinct (see
`leaf_of`); rows of equal tree and doc_id stand in order of their leaf, and repeated rows keep a leaf each; a null tree
and a null doc_id come first; other columns are ignored; an empty table has no leaves and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.base import stored
from foldwright.operators.ordering import join_null_safe, with_row_number

LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Node = tuple  # (digest, left, right); leaves have no children, an only child is the left one


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself, or `-` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def height_in_block(nodes_of_tier: int, levels: int) -> int:
    """Levels between the nodes of a block and its top: all of them unless the tree's tier is one block."""
    return min(levels, (nodes_of_tier - 1).bit_length())


def build(digests: Sequence[str], height: int) -> Node:
    nodes: list[Node] = [(d, None, None) for d in digests]
    for _ in range(height):
        nodes = [parent(nodes[k], nodes[k + 1] if k + 1 < len(nodes) else None) for k in range(0, len(nodes), 2)]
    return nodes[0]


def parent(left: Node, right: Node | None) -> Node:
    return (digest(left[0] + right[0] if right else left[0]), left, right)


def with_leaf(root: Node, height: int, place: int, leaf: str) -> Node:
    """A version of the tree with another leaf; only the ancestors of the leaf are new nodes."""
    if not height:
        return (leaf, None, None)
    _, left, right = root
    if place >> (height - 1) & 1:
        return parent(left, with_leaf(right, height - 1, place, leaf))
    return parent(with_leaf(left, height - 1, place, leaf), right)


def path_of(root: Node, height: int, place: int) -> tuple[str, str]:
    """Marks and joined digests of the siblings of a leaf, from the leaf up: L or R for the sibling's side, `-` for none."""
    marks, siblings = [], []
    for level in range(height - 1, -1, -1):
        _, left, right = root
        goes_right = place >> level & 1
        other = left if goes_right else right
        marks.append("L" if goes_right else "R" if other else "-")
        siblings.append(other[0] if other else "")
        root = right if goes_right else left
    return "".join(reversed(marks)), "".join(reversed(siblings))


def fold(top: str, marks: str, siblings: str) -> str:
    """The root that a digest reaches along a path."""
    at = 0
    for mark in marks:
        if mark == "-":
            top = digest(top)
            continue
        other = siblings[at : at + 64]
        at += 64
        top = digest(other + top if mark == "L" else top + other)
    return top


def _block(table: pa.Table, levels: int) -> tuple[pa.Table, Node, int, list[int]]:
    """Rows of one block in order, its tree, its height and the places of the rows."""
    table = table.sort_by("place")
    height = height_in_block(table["size"][0].as_py(), levels)
    return table, build(table["digest"].to_pylist(), height), height, [p & (1 << levels) - 1 for p in table["place"].to_pylist()]


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """The next tier: one node per block (tree, place, size, digest)."""

    def run(table: pa.Table) -> pa.Table:
        rows, root, _, _ = _block(table, levels)
        size = rows["size"][0].as_py()
        return pa.table({
            "tree": rows["tree"][:1], "place": pa.array([rows["place"][0].as_py() >> levels], pa.int64()),
            "size": pa.array([-(-size // (1 << levels))], pa.int64()), "digest": [root[0]],
        })

    return nodes.groupBy("tree", F.shiftright("place", levels)).applyInArrow(run, "tree long, place long, size long, digest string")


def _tiers(nodes: DataFrame, largest: int, levels: int) -> list[DataFrame]:
    """The tiers above `nodes`, the last one with one node per tree."""
    tiers = []
    while not tiers or largest > 1:
        nodes = stored(_tops(nodes, levels), "merkle-tier")
        tiers.append(nodes)
        largest = -(-largest // (1 << levels))
    return tiers


_PATHS = "tree long, place long, digest string, marks string, siblings string, root string"


def _paths(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """The whole path of every node of a tier; `above` holds the paths of the blocks' tops."""

    def run(inside: pa.Table, top: pa.Table) -> pa.Table:
        rows, root, height, places = _block(inside, levels)
        marks, siblings = top["marks"][0].as_py(), top["siblings"][0].as_py()
        own = [path_of(root, height, p) for p in places]
        return pa.table({
            "tree": rows["tree"], "place": rows["place"], "digest": rows["digest"],
            "marks": pa.array([m + marks for m, _ in own], pa.string()), "siblings": pa.array([s + siblings for _, s in own], pa.string()),
            "root": pa.array([top["root"][0].as_py()] * len(own), pa.string()),
        })

    block = F.shiftright("place", levels)
    return nodes.groupBy("tree", block).cogroup(above.groupBy("tree", "place")).applyInArrow(run, _PATHS)


def _down(tiers: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """Paths of the nodes of the lowest of `tiers`, from the paths of the nodes of the highest."""
    for nodes in reversed(tiers[:-1]):
        above = _paths(nodes, above, levels)
    return above


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Roots, proofs and versions for `leaves`: tree, doc_id, leaf, changed (the tampered leaf, null where there is none).

    Returns doc_id, leaf, subroot (of its tree), root (of all), marks and siblings (the whole path), folded_root (the root of
    the version with the changed leaf) and verified (whether that is the root).
    """
    rows = leaves.select("tree", F.col("doc_id").cast("long").alias("doc_id"), F.col("leaf").alias("digest"), "changed")
    numbered = with_row_number(rows, [F.col("tree").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "digest"], "number")
    sizes = numbered.groupBy("tree").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("size"))
    trees = stored(with_row_number(sizes, [F.col("tree").asc_nulls_first()], "rank").withColumn("rank", F.col("rank") - 1), "merkle-trees")
    largest, n_trees = trees.agg(F.max("size"), F.count(F.lit(1))).first()
    placed = join_null_safe(numbered, trees, ["tree"], "inner").select(
        F.col("rank").alias("tree"), (F.col("number") - F.col("first")).alias("place"), "size", "digest", "doc_id", "changed"
    )
    tiers = _tiers(placed.select("tree", "place", "size", "digest"), largest or 0, levels)
    roots = tiers[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n_trees).cast("long").alias("size"), "digest")
    upper = _tiers(roots, n_trees, levels)
    empty = F.lit("")
    top = upper[-1].select("tree", "place", "digest", empty.alias("marks"), empty.alias("siblings"), F.col("digest").alias("root"))
    subroots = _paths(roots, _down(upper, top, levels), levels)
    above = _down(tiers, subroots.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "digest", "marks", "siblings", "root"), levels)
    subroot = subroots.select(F.col("place").alias("tree"), F.col("digest").alias("subroot"))
    return _versions(placed, above.join(subroot, "tree"), levels)


_VERSIONS = "doc_id long, leaf string, subroot string, root string, marks string, siblings string, folded_root string, verified boolean"


def _versions(placed: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    def run(inside: pa.Table, top: pa.Table) -> pa.Table:
        rows, root, height, places = _block(inside, levels)
        marks, siblings, whole = (top[c][0].as_py() for c in ("marks", "siblings", "root"))
        own = [path_of(root, height, p) for p in places]
        leaves = rows["digest"].to_pylist()
        versions = (with_leaf(root, height, p, new or old) for p, new, old in zip(places, rows["changed"].to_pylist(), leaves, strict=True))
        folded = [fold(version[0], marks, siblings) for version in versions]
        n = len(leaves)
        return pa.table({
            "doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": pa.array([top["subroot"][0].as_py()] * n), "root": pa.array([whole] * n),
            "marks": pa.array([m + marks for m, _ in own], pa.string()), "siblings": pa.array([s + siblings for _, s in own], pa.string()),
            "folded_root": pa.array(folded), "verified": pa.array([f == whole for f in folded]),
        })

    block = F.shiftright("place", levels)
    return placed.groupBy("tree", block).cogroup(above.groupBy("tree", "place")).applyInArrow(run, _VERSIONS)


def tampered_manifest(documents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of `documents` with one tree per language; every seventh document by checksum gets one character too many."""
    fields = [F.col(f) for f in FIELDS]
    more = [F.col(f) if f != "n_chars" else F.col(f).cast("decimal(20,0)") + 1 for f in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = documents.select(F.col("lang").alias("tree"), "doc_id", leaf_of(fields).alias("leaf"), F.when(hit, leaf_of(more)).alias("changed"))
    return manifest(leaves, levels).select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


MERKLE_SQL = """
WITH RECURSIVE doc AS (
  SELECT doc_id, lang, n_chars,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(doc_id::VARCHAR), ':', doc_id) END, coalesce(concat(strlen(source) || ':', source), '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))
    ) AS turned
  FROM documents
), leaf AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size,
    sha256(concat(head, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-'), body)) AS leaf,
    CASE WHEN xor(turned, 4294967295) % 7 = 0 THEN sha256(concat(head, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-'), body)) END AS changed
  FROM doc
), up AS (
  SELECT lang, 0 AS level, place, size, leaf AS digest FROM leaf
  UNION ALL
  SELECT lang, level + 1, place // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM up WHERE size > 1 GROUP BY lang, level, place // 2, size
), subroot AS (
  SELECT lang, level AS height, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM up WHERE size = 1
), crown AS (
  SELECT 0 AS level, place, size, digest FROM subroot
  UNION ALL
  SELECT level + 1, place // 2, (size + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM crown WHERE size > 1 GROUP BY level, place // 2, size
), step AS (
  SELECT l.doc_id, u.level AS step, (l.place >> u.level) & 1 AS side, max(u.digest) FILTER (u.place <> l.place >> u.level) AS other
  FROM leaf l JOIN up u ON l.lang IS NOT DISTINCT FROM u.lang AND u.size > 1 AND u.place >> 1 = l.place >> (u.level + 1) GROUP BY ALL
  UNION ALL
  SELECT l.doc_id, s.height + c.level, (s.place >> c.level) & 1, max(c.digest) FILTER (c.place <> s.place >> c.level)
  FROM leaf l JOIN subroot s ON l.lang IS NOT DISTINCT FROM s.lang JOIN crown c ON c.size > 1 AND c.place >> 1 = s.place >> (c.level + 1) GROUP BY ALL
), folded AS (
  SELECT doc_id, 0 AS step, coalesce(changed, leaf) AS digest FROM leaf
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(CASE WHEN s.other IS NULL THEN f.digest WHEN s.side = 1 THEN s.other || f.digest ELSE f.digest || s.other END)
  FROM folded f JOIN step s ON f.doc_id = s.doc_id AND f.step = s.step
), proof AS (
  SELECT doc_id, sha256(coalesce(string_agg(other, '' ORDER BY step), '')) AS proof_sha256 FROM step GROUP BY doc_id
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM leaf l JOIN subroot s ON l.lang IS NOT DISTINCT FROM s.lang JOIN crown r ON r.size = 1 LEFT JOIN proof p ON p.doc_id = l.doc_id
JOIN (SELECT doc_id, max_by(digest, step) AS digest FROM folded GROUP BY doc_id) f ON f.doc_id = l.doc_id
"""
