"""Metrics against brute force, blends against row-wise descent."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.operators import metrics as M
from foldwright.operators import oof as P
from foldwright.operators.audit import ContractError


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(4)
    data = [(i, str(i % 3), rng.randrange(2), rng.randrange(12) / 12, rng.random(), rng.randrange(5)) for i in range(150)]
    return spark.createDataFrame(data, "id long, fold string, y int, p double, q double, r int").cache()


@pytest.mark.parametrize("max_rows", [4, 10_000])
def test_auc_matches_pair_counting(scores, max_rows):
    data = scores.collect()
    wins = [1.0 if a.p > b.p else 0.5 if a.p == b.p else 0.0 for a in data if a.y for b in data if not b.y]
    assert M.auc(scores, "y", "p", max_rows=max_rows).first()["auc"] == pytest.approx(sum(wins) / len(wins))


def test_auc_degenerate_policies(scores):
    ones = scores.filter("y = 1")
    assert M.auc(ones, "y", "p").first()["auc"] is None
    assert M.auc(ones, "y", "p", degenerate="half").first()["auc"] == 0.5
    with pytest.raises(M.DegenerateMetric):
        M.auc(ones, "y", "p", degenerate="error")


def test_kendall_counts_match_all_pairs(scores):
    data = scores.collect()
    expected = {"concordant": 0, "discordant": 0, "tied_left": 0, "tied_right": 0}
    for a, b in itertools.combinations(data, 2):
        x, y = a.p - b.p, a.r - b.r
        if x and y:
            expected["concordant" if x * y > 0 else "discordant"] += 1
        elif x or y:
            expected["tied_left" if not x else "tied_right"] += 1
    got = M.pair_order_counts(scores, "p", "r").first().asDict()
    assert {k: got[k] for k in expected} == expected


def test_effective_rank_limits(scores):
    same = scores.select(F.col("p").alias("a"), F.col("p").alias("b"))
    assert M.effective_rank(same, ["a", "b"]).first()["effective_rank"] == pytest.approx(1.0, abs=1e-6)


def test_gram_blend_equals_row_descent_and_ignores_own_fold(scores):
    table = scores.collect()

    def descend(rows):
        x, y = np.array([[r.p, r.q] for r in rows]), np.array([r.y for r in rows], float)
        w = np.full(2, 0.5)
        for _ in range(400):
            w = P.project_simplex(w - 0.2 * 2 * x.T @ (x @ w - y) / len(y))
        return w

    made = P.simplex_blend_crossfit(scores, "y", "fold", ["p", "q"])
    weights = {(r.fold_id, r.candidate_id): r.weight for r in made.collect()}
    for fold in "012":
        w = descend([r for r in table if r.fold != fold])
        assert weights[(fold, "p")] == pytest.approx(w[0], abs=1e-9)
    attacked = scores.withColumn("y", F.when(F.col("fold") == "1", 1 - F.col("y")).otherwise(F.col("y")))
    after = {(r.fold_id, r.candidate_id): r.weight for r in P.simplex_blend_crossfit(attacked, "y", "fold", ["p", "q"]).collect()}
    assert after[("1", "p")] == pytest.approx(weights[("1", "p")], abs=1e-12)


def test_isotonic_steps_rise_and_are_right_closed(spark, scores):
    steps = P.fit_isotonic(scores, "p", "y")
    values = [v for _, v in steps]
    assert values == sorted(values)
    asked = spark.createDataFrame([(steps[0][0],), (steps[0][0] + 1e-6,), (2.0,)], "p double")
    got = [r.calibrated for r in P.apply_steps(asked, steps, "p").orderBy("p").collect()]
    assert got == [values[0], values[1], values[-1]]
    with pytest.raises(ContractError):
        P.fit_isotonic(scores.limit(5), "p", "y")


def test_pair_join_reports_misaligned_rows(spark):
    columns = "row_id string, target double, fold_id string, oof_prediction double, residual double"
    left = spark.createDataFrame([("a", 1.0, "0", 0.5, 0.5), ("b", 0.0, "1", 0.2, -0.2)], columns)
    right = spark.createDataFrame([("a", 0.0, "0", 0.5, -0.5), ("c", 0.0, "1", 0.2, -0.2)], columns)
    pair = P.aligned_pair_join(left, right, ["row_id"])
    assert {(r.row_id, r.problem) for r in pair.violations.collect()} == {("a", "target"), ("b", "missing_right"), ("c", "missing_left")}
    with pytest.raises(ContractError):
        pair.checked()
