"""Queries that fit models; their values depend on the learner, so they have no SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.operators import features as E
from foldwright.operators import folds as S
from foldwright.operators import metrics as M
from foldwright.operators import models as J
from foldwright.operators import oof as O
from foldwright.plans.fixtures import rounded
from foldwright.plans.registry import query


def _probe_rows(t):
    """Events as control rows whose target follows the unit (user % 5)."""
    user, key = F.col("user_id"), F.col("event_id")
    rows = t.entity_events()
    low, high = rows.agg(F.min("t"), F.max("t")).first()
    return rows.select(
        "event_id", (F.col("value") / 100).alias("signal"), ((F.col("t") - low) / float(high - low)).alias("time"), (key % 3).alias("missing_count"),
        (key % 3).alias("missing_pattern"), (key % 2).alias("route"), user.alias("unit"), (user % 7).cast("double").alias("held_out"),
        (user % 5 == 0).cast("int").alias("target"),
    )


@query("mlj6_operator_feature_probe")
def _(t):
    rows = _probe_rows(t)
    made = J.operator_feature_probe(rows.filter("time < 0.6"), rows.filter("time >= 0.6"), "event_id", 1)
    doubles = ("gain", "null_gain", "implication", "worst_block_gain")
    return made.select("operator", "selected", *[rounded(c).alias(c) for c in doubles])


def _raw(train, valid):
    return train, valid, ["value", "hour"]


def _entity(train, valid):
    add = lambda d: E.fold_safe_entity_aggregates(train, d, "user_id", "value", "t")
    # A train row is encoded by strictly earlier train rows, so that its own label is not among its features.
    seen = E.causal_group_rate(add(train), "user_id", "y", ["t", "event_id"], name="user_rate")
    later = E.smoothed_target_encoding(train, add(valid), "user_id", "y", name="user_rate")
    return seen, later, ["value", "hour", "uid_count", "uid_amount_mean", "uid_amount_std", "user_rate"]


def _crossfit(t):
    rows = t.events.select(
        "event_id", "user_id", "value", F.unix_micros("ts").alias("t"), F.hour("ts").alias("hour"), (F.col("event_type") == "error").cast("int").alias("y")
    )
    day = S.SECONDS_PER_DAY * 1_000_000
    folds = S.fraction_horizon_folds(rows, "event_id", "t", 3, day).select("event_id", "fold", "role")
    learners = {"logistic": J.logistic, "boosted": J.boosted}
    return J.crossfit_oof(rows, folds, "event_id", "y", {"raw": _raw, "entity": _entity}, learners, (0,))


@query("mlj7_crossfit_oof")
def _(t):
    oof = J.seed_average(_crossfit(t), "event_id")
    scored = M.auc(oof, "target", "oof_prediction", ["candidate_id", "fold_id"])
    return scored.select("candidate_id", "fold_id", "n", "positives", rounded("auc").alias("auc"))


@query("mlj7_crossfit_report")
def _(t):
    oof = J.seed_average(_crossfit(t), "event_id")
    names = ("raw:logistic", "raw:boosted", "entity:logistic", "entity:boosted")
    safe = {n: n.replace(":", "_") for n in names}
    shaped = oof.withColumn("candidate_id", F.replace("candidate_id", F.lit(":"), F.lit("_")))
    wide = M.candidate_matrix(shaped, "event_id", "candidate_id", "oof_prediction", list(safe.values()))
    placed = wide.join(shaped.select("event_id", "fold_id", "target").distinct(), "event_id")
    blend = O.simplex_blend_crossfit(placed, "target", "fold_id", list(safe.values()))
    return blend.select("fold_id", "candidate_id", *[rounded(c).alias(c) for c in ("weight", "loss", "best_single_loss", "gain")])


@query("mlj8_capacity_matched_baseline")
def _(t):
    orders = t.orders.select(
        "o_orderkey", "o_custkey", "o_totalprice", F.month("o_orderdate").alias("month"), F.unix_seconds("o_orderdate").alias("t"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"),
    )
    segments = S.segments_60_20_20(orders, "o_orderkey", ["t", "o_orderkey"], ["t", "o_custkey", "o_totalprice", "month", "urgent"])
    research, transfer = segments.filter("segment = 'research'"), segments.filter("segment = 'transfer'")
    binary = J.capacity_matched_baseline(research, transfer, ["o_custkey", "o_totalprice", "month"], "urgent")
    regression = J.capacity_matched_baseline(research, transfer, ["o_custkey", "month"], "o_totalprice", "regression")
    made = binary.withColumn("task", F.lit("classification")).unionByName(regression.withColumn("task", F.lit("regression")))
    return made.select("task", "n", rounded("score").alias("score"), "control")


@query("mlj9_adversarial_shift_test")
def _(t):
    rows = t.entity_events().withColumn("x", F.col("value")).withColumn("u", F.col("user_id").cast("double"))
    made = J.adversarial_shift_test(rows.filter("is_fit"), rows.filter("NOT is_fit"), "event_id", ["x", "u"])
    return made.select("n", "positives", rounded("auc").alias("auc"))
