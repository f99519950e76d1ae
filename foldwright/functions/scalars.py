"""Scalar rules: key building, belief updates, missing-value handling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Evidence weight per level, and the range beliefs are kept in.
EVIDENCE_WEIGHTS = {
    "decisive_support": 2.0,
    "strong_support": 1.0,
    "weak_support": 0.5,
    "neutral": 0.0,
    "weak_refutation": -0.5,
    "strong_refutation": -1.0,
    "decisive_refutation": -2.0,
}
BELIEF_RANGE = (0.05, 0.95)
LIKELIHOOD_FLOOR = 1e-12
STRENGTH_RANGE = (-2.0, 2.0)


def safe_number(value: Column) -> Column:
    """Null, text that is no number, and NaN all become null (PRJ15)."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def entity_key(*columns: str) -> Column:
    """First 24 hex digits of SHA-256 over pipe-joined values, null written as <NA> (SCA4)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in columns]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def opaque_identifier(value: Column, salt: str, prefix: str = "anonymous-", digits: int = 12) -> Column:
    """Salted digest prefix of an identifier (PRJ7)."""
    return F.concat(
        F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", F.lit(salt), value.cast("string")), 256), 1, digits)
    )


def direction_normalised(value: Column, direction: Column | str) -> Column:
    """Larger is better after this; null for an unknown direction (PRJ14)."""
    direction = F.lit(direction) if isinstance(direction, str) else direction
    return F.when(direction == "maximize", value).when(direction == "minimize", -value)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def clipped_belief(value: Column) -> Column:
    return clip(value, *BELIEF_RANGE)


def _shift(prior: Column, amount: Column) -> Column:
    p = clipped_belief(prior)
    return clipped_belief(1 / (1 + F.exp(-(F.log(p / (1 - p)) + amount))))


def evidence_weight(level: Column, verifier: Column) -> Column:
    """Weight of an evidence level; a failed check gives 0, a disputed one half."""
    table = F.create_map(*[F.lit(x) for pair in EVIDENCE_WEIGHTS.items() for x in pair])
    weight = F.try_element_at(table, level)
    return F.when(verifier == "fail", 0.0).when(verifier == "disputed", weight * 0.5).otherwise(weight)


def log_odds_update(prior: Column, level: Column, verifier: Column) -> Column:
    """Belief after adding an evidence weight in log-odds, clipped before and after (SCA1)."""
    return _shift(prior, evidence_weight(level, verifier))


def bayes_factor_update(
    prior: Column, p_true: Column, p_false: Column, verifier: Column, reliability: Column
) -> tuple[Column, Column]:
    """Belief after a tempered Bayes factor, and the clipped strength (SCA2)."""
    tempered = (
        F.when(verifier == "fail", 0.0).when(verifier == "disputed", reliability * 0.5).otherwise(reliability)
    )
    floor = F.lit(LIKELIHOOD_FLOOR)
    factor = F.log(F.greatest(p_true, floor) / F.greatest(p_false, floor)) * tempered
    return _shift(prior, factor), clip(factor, *STRENGTH_RANGE)


def information_gain(prior: Column, outcomes: Column) -> Column:
    """Bits of I(H;Y) for an array of (p_true, p_false) structs, never below 0 (SCA3)."""
    log2 = lambda x: F.log2(x)

    def contribution(acc, o):
        mixed = prior * o["p_true"] + (1 - prior) * o["p_false"]
        share = lambda w, p: F.when((w * p > 0) & (mixed > 0), w * p * log2(p / mixed)).otherwise(0.0)
        return acc + share(prior, o["p_true"]) + share(1 - prior, o["p_false"])

    return F.greatest(F.lit(0.0), F.aggregate(outcomes, F.lit(0.0), contribution))


def outcome_disposition(supporting: Column, contradicting: Column, confounders: Column) -> Column:
    """Verdict of a falsification test from its match lists (SCA8); survival needs checked confounders."""
    s, c = F.size(supporting), F.size(contradicting)
    return (
        F.when((c > 0) & (s == 0), "falsified")
        .when((c > 0) & (s > 0), "weakened")
        .when((s > 0) & (F.size(confounders) > 0), "survives")
        .otherwise("inconclusive")
    )


def canonical_fingerprint(fields: Mapping[str, Column]) -> Column:
    """SHA-256 of JSON with fields in name order and nulls kept (SCA5)."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)
