"""Inputs that the registered fixtures do not hold: nulls, foreign rows, low thresholds, long chains."""

import itertools
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from foldwright.operators import metrics as M
from foldwright.operators import oof as O
from foldwright.operators import runlog as L
from foldwright.operators import selection as K
from foldwright.operators import text as X
from foldwright.operators.audit import ContractError
from foldwright.session import scratch_path
from foldwright.sources import scores as task_source


def test_null_targets_and_folds_agree_with_nulls_only(spark):
    schema = "row_id string, target double, fold_id string, oof_prediction double, residual double"
    left = spark.createDataFrame([("a", None, "0", 0.5, None), ("b", 1.0, None, 0.5, 0.5), ("c", 1.0, "0", 0.5, 0.5), ("d", None, "1", 0.5, None), ("e", 0.0, "1", 0.5, None)], schema)
    right = spark.createDataFrame([("a", 1.0, "0", 0.4, 0.6), ("b", 1.0, "0", 0.4, 0.6), ("c", 1.0, "0", 0.4, 0.6), ("d", None, "1", 0.4, None), ("f", 0.0, "1", 0.4, None)], schema)
    pair = O.aligned_pair_join(left, right, ["row_id"])
    assert sorted(r["row_id"] for r in pair.result.collect()) == ["c", "d"]
    assert {r["row_id"]: r["problem"] for r in pair.violations.collect()} == {"a": "target", "b": "fold", "e": "missing_right", "f": "missing_left"}


def test_matrix_ignores_candidates_that_are_not_asked_for(spark):
    rows = [("1", "A", 0.1), ("1", "B", 0.2), ("1", "E", 9.0), ("2", "A", 0.3), ("2", "E", 9.0), ("3", "A", 0.5), ("3", "B", None), ("4", "A", 1.0), ("4", "A", 2.0), ("4", "B", 1.0)]
    made = M.audited_matrix(spark.createDataFrame(rows, "row string, candidate string, value double"), "row", "candidate", "value", ("A", "B"))
    assert [tuple(r) for r in made.result.collect()] == [("1", 0.1, 0.2)]
    assert {r["row"]: r["misaligned"] for r in made.violations.collect()} == {"2": ["B"], "3": ["B"], "4": ["A"]}


def test_requests_without_a_run_share_one_budget(spark):
    rows = [(run, k, "c", 20, False) for run in (None, 7) for k in range(4)]
    got = L.token_budget_gate(spark.createDataFrame(rows, "run long, sequence int, cluster string, tokens int, candidate boolean"), "run", "sequence", 50, 30, 1000, 0.0).collect()
    assert {(r["run"], r["sequence"]): r["refusal"] for r in got} == {(run, k): None if k < 2 else "total_budget" for run in (None, 7) for k in range(4)}


def test_dependency_levels_follow_a_chain_to_its_end(spark):
    nodes = spark.createDataFrame([(k,) for k in range(12)], "node int")
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, 12)], "node int, depends_on int")
    assert {r["node"]: r["level"] for r in K.dependency_levels(chain, nodes).collect()} == {k: k for k in range(12)}
    with pytest.raises(ContractError):
        K.dependency_levels(chain.union(spark.createDataFrame([(0, 11)], "node int, depends_on int")), nodes)


def _plain_levels(count, edges):
    level = {}
    for node in range(count):  # dependencies have smaller numbers
        level[node] = max((level[d] + 1 for n, d in edges if n == node), default=0)
    return level


@pytest.mark.parametrize("seed", [1])
def test_dependency_levels_of_chains_that_fork_and_meet(spark, seed):
    rng = random.Random(seed)
    edges = {(k, rng.randrange(max(0, k - 4), k)) for k in range(1, 120) for _ in range(1 if rng.random() < 0.8 else 3)}
    made = K.dependency_levels(spark.createDataFrame(sorted(edges), "node int, depends_on int"), spark.range(120).select(F.col("id").cast("int").alias("node")))
    assert sorted(tuple(r) for r in made.collect()) == sorted(_plain_levels(120, edges).items())


def test_a_chain_of_ten_thousand_nodes_takes_a_logarithmic_number_of_rounds(spark, monkeypatch):
    count, cuts, cut = 10_000, [], K.cut_lineage
    monkeypatch.setattr(K, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    nodes = spark.range(count).select(F.col("id").alias("node"))
    chain = nodes.filter("node > 0").select("node", (F.col("node") - 1).alias("depends_on"))
    made = K.dependency_levels(chain, nodes)
    assert made.count() == count and made.filter("node <> level").isEmpty()
    assert len(cuts) < 30


def test_dependency_rounds_broadcast_nothing(spark, monkeypatch):
    joins, cut = [], K.cut_lineage

    def noted(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins.extend(line for line in plan.splitlines() if "Join " in line)
        return cut(df)

    monkeypatch.setattr(K, "cut_lineage", noted)
    edges = spark.createDataFrame([(k, k // d) for k in range(1, 40) for d in (2, 3)], "node long, depends_on long")
    K.dependency_levels(edges, spark.range(40).withColumnRenamed("id", "node"))
    assert joins and all("strategy=merge" in line for line in joins)


def test_the_estimated_size_of_dependency_rounds_does_not_grow(spark, monkeypatch):
    bits, checkpoint, parquet = [], DataFrame.checkpoint, DataFrameWriter.parquet
    note = lambda df: bits.append(int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length())
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: note(self) or checkpoint(self, *a, **k))
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: note(self._df) or parquet(self, *a, **k))
    edges = spark.createDataFrame([(k, k // d) for k in range(1, 60) for d in (2, 3)], "node long, depends_on long")
    made = K.dependency_levels(edges, spark.range(60).withColumnRenamed("id", "node"))
    assert made.agg(F.max("level")).first()[0] == 6
    assert bits and max(bits) < 200


def test_dependency_edges_at_the_border(spark):
    nodes = spark.createDataFrame([(1,), (2,), (1,)], "node int")
    edges = lambda rows: spark.createDataFrame(rows, "node int, depends_on int")
    read = lambda e: sorted(tuple(r) for r in K.dependency_levels(e, nodes).collect())
    assert read(edges([])) == [(1, 0), (2, 0)]
    # A repeated edge counts once; edges of what is no node do not count.
    assert read(edges([(2, 1), (2, 1), (9, 8)])) == [(1, 0), (2, 1)]
    assert K.dependency_levels(edges([(2, 1)]), nodes.limit(0)).count() == 0
    for wrong in ([(1, 1)], [(2, 7)]):
        with pytest.raises(ContractError):
            K.dependency_levels(edges(wrong), nodes)


def test_the_later_row_of_one_append_is_the_latest(spark):
    path = scratch_path(spark, "scores-test")
    row = lambda v: ("A", "t", "candidate", {"m": v})
    schema = "candidate_id string, task_id string, kind string, metrics map<string,double>"
    task_source.append_task_scores(spark.createDataFrame([row(float(k)) for k in range(9)], schema), path)
    read = lambda: task_source.latest_task_scores(task_source.load_task_scores(spark, path)).first()["metrics"]["m"]
    assert read() == 8.0
    task_source.append_task_scores(spark.createDataFrame([row(3.0), row(1.0)], schema), path)
    assert read() == 1.0


def _signature_rows(seed, n):
    rng = random.Random(seed)
    pick = lambda k: [f"{rng.choice('xyz')} {rng.randint(0, 3)}" for _ in range(rng.randint(0, k))]
    return [(k, pick(4), pick(2), pick(1), pick(2), pick(1), rng.random() < 0.5, False) for k in range(n)]


def _similarity(a, b):
    clean = lambda terms: {"_".join(t.strip().lower().split()) for t in terms if t.strip()}
    total = float(a[6] == b[6])
    for x, y in zip(a[1:6], b[1:6], strict=True):
        x, y = clean(x), clean(y)
        total += len(x & y) / len(x | y) if x | y else 1.0
    return total / 6


SCHEMA = ", ".join(["id int", *(f"{f} array<string>" for f in X.SIGNATURE_FIELDS), "candidate_producing boolean", "replication boolean"])


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.6, 0.85, 0.95])
def test_signature_pairs_at_every_threshold(spark, threshold):
    rows = _signature_rows(1, 40)
    signatures, members = X.fold_signatures(spark.createDataFrame(rows, SCHEMA), "id")
    named = {r["signature"]: r["first_id"] for r in signatures.collect()}
    got = {frozenset((named[r["left_signature"]], named[r["right_signature"]])): r["similarity"] for r in X.signature_edges(signatures, threshold).collect()}
    kept = sorted(named.values())
    want = {frozenset((i, j)): _similarity(rows[i], rows[j]) for i, j in itertools.combinations(kept, 2) if _similarity(rows[i], rows[j]) >= threshold - 1e-12}
    assert got == pytest.approx(want)


def test_largest_similarity_below_the_threshold(spark):
    apart = [(k, [f"a{k}"], [f"b{k}"], [f"c{k}"], [f"d{k}"], [f"e{k}"], k % 2 == 0, False) for k in range(4)]
    for rows in (apart[:2], apart, [(0, [" A b"], ["b"], ["c"], ["d"], ["e"], True, False), (1, ["a_B "], ["b"], ["c"], ["x"], ["y"], True, False), *apart[2:]]):
        made = X.similarity_audit(spark.createDataFrame(rows, SCHEMA), "id").first()
        assert made["max_similarity"] == pytest.approx(max(_similarity(a, b) for a, b in itertools.combinations(rows, 2)))


def test_novelty_of_long_descriptors(spark):
    rng = random.Random(11)
    names = [f"d{k}" for k in range(12)]
    rows = [(rng.choice("ab"), k, *[rng.choice([None, "x", "y", "z"]) for _ in names]) for k in range(40)]
    rows += [("a", 50 + k, *rows[k][2:]) for k in range(4)] + [(None, 60, *["x"] * 12), (None, 61, *["x"] * 11, "q"), ("c", 70, *["x"] * 12)]
    got = {r["seq"]: r["novelty"] for r in K.local_novelty(spark.createDataFrame(rows, ", ".join(["agent string", "seq int", *(f"{n} string" for n in names)])), "agent", "seq", names).collect()}
    differ = lambda a, b: sum(x != y for x, y in zip(a[2:], b[2:], strict=True)) / 12
    assert got == pytest.approx({r[1]: min([differ(r, o) for o in rows if o[0] == r[0] and o[1] < r[1]], default=1.0) for r in rows})


def test_tier_walk_against_a_walk_over_pairs(spark, monkeypatch):
    from foldwright.operators import resample as B

    rng = random.Random(12)
    names = [f"c{k:03d}" for k in range(30)]
    apart = {(a, b) for a, b in itertools.combinations(names, 2) if rng.random() < 0.8}
    pairs = [(a, b, (a, b) in apart) for a, b in itertools.combinations(names, 2) if rng.random() < 0.95]
    monkeypatch.setattr(B, "compare_pairs", lambda *a, **o: spark.createDataFrame(pairs, "left_id string, right_id string, separated boolean"))
    scores = spark.createDataFrame([(n, "t", float(rng.randint(0, 20))) for n in names], "c string, task string, v double")
    known = {frozenset(p[:2]): p[2] for p in pairs}
    tiers = []
    for name in [r["c"] for r in scores.orderBy(scores["v"].desc(), "c").collect()]:
        if tiers and not all(known.get(frozenset((name, o)), False) for o in tiers[-1]):
            tiers[-1].append(name)
        else:
            tiers.append([name])
    want = {n: (k, len(t)) for k, t in enumerate(tiers, 1) for n in t}
    assert {r["c"]: (r["tier"], r["tier_size"]) for r in B.gated_ranking(scores, "c", "task", "v").collect()} == want
