"""The pipeline's near-duplicate stage against all pairs of five-word shingle sets."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from foldwright.llm.near_copies import PLACES, PRINTS, bucket_pairs, first_of_near_copies, places, shingle_set, similar, variants


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)} - {()}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_ids(texts, least=0.8):
    sets, parent = [plain(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(sets[i], sets[j]) >= least:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [k for k in range(len(texts)) if parent[k] == k]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    out = [None, "", " ", "one", "One", "two words", "a b c d", "a b c d e", "a b c d e a b c d e"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(60, 500))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 90, len(base) // 45, len(base) // 30])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def test_stage_keeps_one_of_each_group(spark, documents, texts):
    want = kept_ids(texts)
    assert len(want) < len(texts)
    kept = corpus_pipeline.simhash_dedup(spark, documents(texts), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_similar_is_exact(texts):
    for a, b in itertools.islice(itertools.combinations(texts, 2), 2000):
        assert similar(shingle_set(a or ""), shingle_set(b or "")) == (jaccard(plain(a), plain(b)) >= 0.8)


def test_variants_meet_when_one_place_differs():
    rng = np.random.default_rng(9)
    one = rng.integers(0, 1 << 32, size=(1, PRINTS * PLACES), dtype=np.uint32)
    for differ, met in ((0, 7), (1, 1), (2, 0)):
        other = one.copy()
        other[0, :differ] ^= np.uint32(1)
        assert len(np.intersect1d(variants(one)[:, :PLACES], variants(other)[:, :PLACES])) == met


def test_recall_of_candidates_at_the_limit():
    rng = np.random.default_rng(10)
    found = 0
    for _ in range(500):
        pool = np.unique(rng.integers(0, 1 << 63, size=500, dtype=np.uint64))
        found += bool(np.isin(variants(places(pool[:450])[None]), variants(places(pool[50:])[None])).any())
    assert found >= 490  # similarity 0.8


def test_buckets_of_nine_give_all_pairs_and_large_ones_few():
    for n in (1, 2, 3, 4, 5, 8, 9):
        a, b, star = bucket_pairs(np.full(n, 5), np.arange(n) * 3 - 4)
        assert {(x, y) for x, y in zip(a, b, strict=True)} == set(itertools.combinations(np.arange(n) * 3 - 4, 2))
        assert star.sum() == max(0, n - 1)
    a, b, star = bucket_pairs(np.repeat([1, 2], 1000), np.tile(np.arange(1000), 2))
    assert len(a) <= 10_000 and (a < b).all() and star.sum() == 1998


def test_ids_of_other_types_null_ids_and_empty_table(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (7, text), (7, text), (8, text + " more"), (9, "other words here now"), (None, "alone in the text")]
    for kind in ("long", "int", "string"):
        frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text", "'x' AS node", "1 AS root")
        got = sorted((str(r["doc_id"]), r["text"]) for r in first_of_near_copies(frame).collect())
        assert got == sorted([("7", text), ("9", "other words here now"), ("None", "alone in the text")])
    assert first_of_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_stage_links_by_simhash_first(spark, documents):
    """Equal fingerprints although the shingle sets share little: the repeated words decide every bit."""
    often = "alpha beta gamma " * 200
    texts = [often, often + " ".join(f"word{k}" for k in range(20)), " ".join(f"other{k}" for k in range(60))]
    assert not similar(shingle_set(texts[0]), shingle_set(texts[1]))
    kept = corpus_pipeline.simhash_dedup(spark, documents(texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]
