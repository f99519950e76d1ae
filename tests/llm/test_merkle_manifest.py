"""Manifests against a plain level-by-level tree."""

import hashlib
import zlib

import pytest
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from foldwright.llm import merkle_manifest as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def plain_siblings(levels, k):
    out = []
    for level in levels[:-1]:
        other = k ^ 1
        out.append((level[other], other < k) if other < len(level) else None)
        k //= 2
    return out


def plain_fold(top, siblings):
    for s in siblings:
        top = h(top) if s is None else h(s[0], top) if s[1] else h(top, s[0])
    return top


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    leaf = lambda r: h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])
    trees = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r))):
        trees.setdefault(r[2], []).append(r)
    levels = [plain_levels([leaf(r) for r in t]) for t in trees.values()]
    crown = plain_levels([x[-1][0] for x in levels])
    out = []
    for k, (tree, own) in enumerate(zip(trees.values(), levels, strict=True)):
        for i, r in enumerate(tree):
            siblings = plain_siblings(own, i) + plain_siblings(crown, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            changed = leaf((*r[:3], None if r[3] is None else r[3] + 1, r[4])) if hit else leaf(r)
            folded = plain_fold(changed, siblings)
            out.append((r[0], leaf(r), own[-1][0], crown[-1][0], h(*[s[0] for s in siblings if s]), folded, folded == crown[-1][0]))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_of_many_sizes(spark, levels):
    rows = [
        (k, f"s{k % 3}", lang, None if k % 11 == 0 else k, None if k % 13 == 0 else "tëxt " * (k % 4))
        for size, lang, first in ((1, None, 0), (2, "", 10), (3, "de", 20), (37, "en", 100), (5, "é", 300), (16, "fr", 400))
        for k in range(first, first + size)
    ]
    assert rows_of(M.tampered_manifest(frame(spark, rows), levels)) == plain_manifest(rows)


def test_one_leaf_repeated_rows_null_ids_and_empty_table(spark):
    for rows in ([(1, "s", "en", 3, "abc")], [(None, None, None, None, None)] * 2 + [(5, "s", "en", 1, "a"), (5, "s", "en", 1, "a"), (5, "s", "en", 2, "b")]):
        assert rows_of(M.tampered_manifest(frame(spark, rows))) == plain_manifest(rows)
    assert M.tampered_manifest(frame(spark, [])).count() == 0


def test_largest_count_and_extra_columns(spark):
    rows = [(k, "s", "en", 2**63 - 1, "x" * 100_000) for k in range(20)]
    docs = frame(spark, rows).selectExpr("*", "1 AS place", "2 AS tree", "'d' AS digest", "3 AS leaf", "4 AS size", "5 AS number")
    assert rows_of(M.tampered_manifest(docs)) == plain_manifest(rows)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 70), st.data())
def test_versions_share_all_but_the_ancestors(n, data):
    digests = [h(str(k)) for k in range(n)]
    height = (n - 1).bit_length()
    root = M.build(digests, height)
    assert root[0] == plain_levels(digests)[-1][0]
    k = data.draw(st.integers(0, n - 1))
    version = M.with_leaf(root, height, k, "changed")
    assert version[0] == plain_levels([*digests[:k], "changed", *digests[k + 1 :]])[-1][0]
    marks, siblings = M.path_of(root, height, k)
    assert M.fold("changed", marks, siblings) == version[0] and M.fold(digests[k], marks, siblings) == root[0]

    def nodes(node):
        return {} if node is None else {id(node): node} | nodes(node[1]) | nodes(node[2])

    old, new = nodes(root), nodes(version)
    assert len(set(new) - set(old)) == height + 1
    assert len(new) == len(old)
