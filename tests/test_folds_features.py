"""Fold invariants and leakage attacks."""

import random

import pytest
from pyspark.sql import functions as F

from foldwright.operators import features as E
from foldwright.operators import folds as S


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    data = [(i, rng.randrange(60), f"u{rng.randrange(6)}", rng.random() * 9, rng.randrange(2)) for i in range(200)]
    return spark.createDataFrame(data, "id long, t long, u string, v double, y int").cache()


def test_time_folds_are_disjoint_and_forward(events):
    folds = S.time_folds(events, "id", "t", 4, 3, keep=["t"]).cache()
    assert S.fold_audit(folds, "id").isEmpty()
    for fold in folds.collect():
        assert fold.role in ("train", "validation", "purged")
    edges = folds.groupBy("fold_id").agg(
        F.max(F.when(F.col("role") == "train", F.struct("t", "id"))).alias("last"),
        F.min(F.when(F.col("role") == "validation", F.struct("t", "id"))).alias("first"),
    )
    assert all(tuple(r.last) < tuple(r.first) for r in edges.collect())
    sizes = folds.filter("role = 'validation'").groupBy("fold_id").count().collect()
    assert {r["count"] for r in sizes} == {40}


def test_entity_purge(events):
    folds = S.time_group_folds(events, "id", "t", "u", 3)
    by = {}
    for r in folds.collect():
        by.setdefault((r.fold_id, r.role), set()).add(r.u)
    for fold in "012":
        assert not by.get((fold, "train"), set()) & by[(fold, "validation")]


def test_random_folds_are_seeded_and_balanced(events):
    first = {r.id: r.fold for r in S.random_folds(events, "id", 3, 5).collect()}
    again = {r.id: r.fold for r in S.random_folds(events.repartition(7), "id", 3, 5).collect()}
    other = {r.id: r.fold for r in S.random_folds(events, "id", 3, 6).collect()}
    assert first == again != other
    counts = [list(first.values()).count(f) for f in range(3)]
    assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("seed", range(6))
def test_greedy_plan_equals_the_walk(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.choice([1, 1, 1, 2, 3, 5, 8, 40]) for _ in range(80)), reverse=True)
    loads, walk = [0] * 4, []
    for size in sizes:
        fold = min(range(4), key=lambda f: (loads[f], f))
        loads[fold] += size
        walk.append(fold)
    histogram = [(s, sizes.count(s)) for s in set(sizes)]
    planned = []
    for size, starts, rotations in S._greedy_plan(histogram, 4):
        for rank in range(sizes.count(size)):
            piece = sum(s <= rank for s in starts) - 1
            planned.append(rotations[piece][(rank - starts[piece]) % len(rotations[piece])])
    assert planned == walk


@pytest.mark.parametrize("max_rows", [9, 10_000])
def test_history_is_strictly_earlier_and_blind_to_validation_labels(events, max_rows):
    fit, transform = events.filter("id % 3 < 2"), events.filter("id % 3 = 2")
    made = {r.id: (r.uid_history_count, r.uid_history_rate) for r in E.strictly_earlier_history(fit, transform, "u", "y", "t", max_rows=max_rows).collect()}
    attacked = E.strictly_earlier_history(fit, transform.withColumn("y", 1 - F.col("y")), "u", "y", "t", max_rows=max_rows)
    assert made == {r.id: (r.uid_history_count, r.uid_history_rate) for r in attacked.collect()}
    known = fit.collect()
    for r in transform.collect():
        prior = [o for o in known if o.u == r.u and o.t < r.t]
        assert made[r.id][0] == len(prior)
        assert made[r.id][1] == pytest.approx(sum(o.y for o in prior) / len(prior) if prior else 0.0)


def test_aggregates_use_fit_rows_only(events):
    fit, transform = events.filter("t < 30"), events.filter("t >= 30")
    plain = E.fold_safe_entity_aggregates(fit, transform, "u", "v", "t").select("id", "uid_amount_mean", "uid_count")
    shifted = E.fold_safe_entity_aggregates(fit, transform.withColumn("v", F.col("v") * 1000), "u", "v", "t").select("id", "uid_amount_mean", "uid_count")
    assert sorted(plain.collect()) == sorted(shifted.collect())


def test_causal_rate_and_decay_on_hot_keys(events):
    small = {r.id: round(r.rate, 9) for r in E.causal_group_rate(events, "u", "y", ["t", "id"], max_rows=7).collect()}
    plain = {r.id: round(r.rate, 9) for r in E.causal_group_rate(events, "u", "y", ["t", "id"]).collect()}
    assert small == plain
    small = {r.id: round(r.decayed, 9) for r in E.decayed_history(events, "u", "v", ["t", "id"], 0.3, max_rows=40, chunk=7).collect()}
    plain = {r.id: round(r.decayed, 9) for r in E.decayed_history(events, "u", "v", ["t", "id"], 0.3).collect()}
    assert small == plain


def test_entity_candidates_stop_at_the_maximum():
    families = (("a", "b"), ("c",), ("d", "e"))
    found = E.entity_candidates(["a", "b", "c", "d", "e"], families)
    assert found[:2] == [("a",), ("b",)] and ("a", "c", "e") in found and len(found) == len(set(found))
    assert len(E.entity_candidates(["a", "b", "c", "d", "e"], families, 5)) == 5
