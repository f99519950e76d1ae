"""SimHash links, components and embedding links against all pairs."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from foldwright.llm.embedding_cells import embedding_groups, local_labels
from foldwright.llm.graph import components
from foldwright.llm.simhash import _emit, first_of_groups, fingerprint, link_buckets, restored, simhash_groups


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "one", "One TWO", "a b c", "Ä b c d ä", "x " * 500, "a\x0bb\x0cc\rd e f"])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def variants(fps):
    import pyarrow as pa

    batches = list(_emit(iter([pa.RecordBatch.from_pydict({"fp": pa.array(np.array(fps, dtype=np.uint64).view(np.int64))})])))
    key = np.concatenate([b.column("key").to_numpy() for b in batches])
    rest = np.concatenate([b.column("rest").to_numpy() for b in batches])
    order = np.argsort(key, kind="stable")
    return key[order], rest[order]


def test_variants_restore_their_fingerprint():
    fps = [0, (1 << 64) - 1, 1 << 63, 0x0123456789ABCDEF]
    key, rest = variants(fps)
    assert len(key) == 131 * len(fps)
    assert set(restored(key, rest)[0].tolist()) == set(fps)


def test_every_distance_up_to_three_links_and_no_more():
    rng = random.Random(1)
    base = rng.getrandbits(64)
    picks = [*itertools.combinations(range(0, 64, 3), 3), *itertools.combinations(range(20, 24), 3), *itertools.combinations(range(60, 64), 3), *itertools.combinations(range(64), 2)]
    for bits in rng.sample(picks, 250):
        other = base
        for b in bits:
            other ^= 1 << b
        assert len(link_buckets(*variants([base, other]))) == 1
    for _ in range(50):
        other = base
        for b in rng.sample(range(64), 4):
            other ^= 1 << b
        assert len(link_buckets(*variants([base, other]))) == 0


def test_connectivity_of_dense_fingerprints():
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = set(seeds)
    while len(fps) < 400:
        value = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.randint(1, 5)):
            value ^= 1 << b
        fps.add(value)
    fps = sorted(fps)
    place = {f: k for k, f in enumerate(fps)}
    want = roots(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    links = link_buckets(*variants(fps))
    assert roots(len(fps), [(place[int(a)], place[int(b)]) for a, b in links]) == want


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1300)] + [(2000 + k, 2000 + (k + 1) % 30) for k in range(30)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 if k < 1000 else 1000 if k < 2000 else 2000 for e in edges for k in e}
    assert components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    out = [None, "", " ", "one", "one", "two words"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(40, 400))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def test_simhash_groups_against_all_pairs(documents, near_texts):
    fps = [plain_fingerprint(t or "") for t in near_texts]
    want = roots(len(fps), [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_groups(documents(near_texts)).collect()}
    assert got == {k: (f"{fps[k]:016x}", want[k]) for k in range(len(fps))}
    kept = first_of_groups(documents(near_texts))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_simhash_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (7, "other words here now"), (None, "alone in the text")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").selectExpr("doc_id", "text", "'x' AS fp", "1 AS root")
    got = sorted((repr(r["doc_id"]), r["component_id"]) for r in simhash_groups(frame).collect() if r["component_id"] is not None)
    assert got == [("7", 7), ("7", 7), ("7", 7), ("None", 7)]
    assert sorted(r["text"] for r in first_of_groups(frame).collect()) == ["a b c d", "alone in the text", "other words here now"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_groups(empty).count() == 0 and first_of_groups(empty).count() == 0


@pytest.mark.parametrize("kind", ["int", "string"])
def test_simhash_keeps_rows_of_other_id_types(spark, kind):
    frame = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "other words here now")], "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
    kept = first_of_groups(frame)
    assert kept.schema["doc_id"].dataType == frame.schema["doc_id"].dataType
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3"]


def test_local_labels_follow_paths():
    linked = np.array([[1, 0, 0], [1, 1, 0], [0, 1, 1], [0, 0, 0]], dtype=bool)
    a, b = local_labels(linked, np.array([9, 8, 7, 6]), np.array([5, 4, 3]))
    assert a.tolist() == [3, 3, 3, 6] and b.tolist() == [3, 3, 3]


def vectors(seed, n, size=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, size))
    spread = rng.choice([0.02, 0.1, 0.35], size=(n, 1))
    return (centres[rng.integers(0, len(centres), n)] / np.sqrt(size) + spread * rng.normal(size=(n, size)) / np.sqrt(size)).astype(float)


@pytest.mark.parametrize(("cell_rows", "block"), [(40, 16), (200, 1024), (10_000, 50)])
def test_embedding_links_against_all_pairs(spark, cell_rows, block):
    x = vectors(5, 400)
    x[10] = x[11] = x[12]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [None] * 24), (1003, [float("nan")] * 24), (1004, [1.0]), (1005, x[3].tolist())]
    got = {r["vec_id"]: r for r in embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cell_rows=cell_rows, block=block).collect()}
    assert len(got) == len(rows)
    y = np.vstack([x, x[3]])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    linked = y @ y.T >= 0.9
    np.fill_diagonal(linked, False)
    ids = [*range(400), 1005]
    found, true = sum(got[i]["n_links"] for i in ids), int(linked.sum())
    assert 0.98 * true <= found <= true
    assert all(got[i]["n_links"] <= linked[k].sum() for k, i in enumerate(ids))
    if cell_rows == 10_000:  # one cell: nothing can be missed
        assert [got[i]["component_id"] for i in ids] == [ids[r] for r in roots(401, np.argwhere(linked).tolist())]
    for i in range(1000, 1005):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


def test_embeddings_of_several_lengths(spark):
    rows = [(k, [1.0, float(k % 3)]) for k in range(12)] + [(20, [1.0, 2.0, 3.0]), (21, [1.0, 2.0, 3.1]), (22, [-1.0, 2.0, 0.0]), (30, [5.0]), (31, [7.0]), (32, [-7.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for most_sample in (20_000, 2):  # with two sampled rows most lengths have no centroids
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_groups(frame, most_sample=most_sample).collect()}
        assert [got[k] for k in (20, 21, 22, 30, 31, 32)] == [(1, 20), (1, 20), (0, 22), (1, 30), (1, 30), (0, 32)]
        cosine = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
        for k in range(12):
            assert got[k][0] == sum(cosine(rows[k][1], rows[j][1]) >= 0.9 for j in range(12) if j != k)


def test_embeddings_empty_table(spark):
    assert embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
