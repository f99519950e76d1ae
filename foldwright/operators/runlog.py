"""Folds of an append-only experiment log: integrity, latest states, running budgets, gates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from foldwright.functions.scalars import BELIEF_RANGE, canonical_fingerprint
from foldwright.operators.metrics import forecast_calibration
from foldwright.operators.ordering import (
    fold_before,
    hot_keys,
    join_null_safe,
    number_by_key,
    prefix_by_key,
    with_neighbours,
)

# Fixed values of the log rules.
COLLAPSE_LIMITS = {"dominant": 0.70, "families": 2.0, "budget": 0.50, "similarity": 0.80}
USAGE_FIELDS = ("cpu_hours", "wall_hours", "tokens", "cost")
# Entries folded inside one array; longer keys are folded level by level.
FOLD_CHUNK = 256


def hash_chain_violations(
    events: DataFrame, run: str, sequence: str, fields: Sequence[str], previous_hash: str, event_hash: str,
    *, max_rows: int | None = None,
) -> DataFrame:
    """Rows that break the chain of a run, with the reason (WIN8).

    Sequence must rise by one from 1, `previous_hash` must be the prior row's hash (null on the first),
    and the hash must be the digest of the canonical row over `fields`.
    """
    linked = with_neighbours(
        events, [run], [sequence],
        lambda w: {"_seq": F.lag(sequence).over(w), "_hash": F.lag(event_hash).over(w)},
        before=1, max_rows=max_rows,
    )
    digest = canonical_fingerprint({f: F.col(f) for f in fields})
    problem = (
        F.when(F.col(sequence) != F.coalesce("_seq", F.lit(0)) + 1, "sequence")
        .when(~F.col(previous_hash).eqNullSafe(F.col("_hash")), "chain")
        .when(F.col(event_hash) != digest, "digest")
    )
    return linked.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(run, sequence, "problem")


def first_violation(violations: DataFrame, run: str, sequence: str) -> DataFrame:
    """The first bad row of each run."""
    return violations.groupBy(run).agg(
        F.min(sequence).alias(sequence), F.min_by("problem", sequence).alias("problem")
    )


def stagnation_runs(
    snapshots: DataFrame, run: str, cycle: str, tolerance: float = 0.0, required: int = 2, *, max_rows: int | None = None
) -> DataFrame:
    """Consecutive cycles in which all four progress checks fail (WIN9).

    Columns read: occupancy, metric, structures, debts. Run length is the distance to the latest
    progressing row, a running maximum instead of a sequential counter.
    """
    cols = ("occupancy", "metric", "structures", "debts")
    seen = with_neighbours(
        snapshots, [run], [cycle],
        lambda w: {**{f"_p_{c}": F.lag(c).over(w) for c in cols}, "_first": F.lag(cycle).over(w).isNull()},
        before=1, max_rows=max_rows,
    )
    improved = (
        F.when(F.col("metric").isNull(), False)
        .when(F.col("_p_metric").isNull(), True)
        .otherwise(F.col("metric") > F.col("_p_metric") + tolerance)
    )
    stalled = (
        ~F.col("_first")
        & (F.col("occupancy") <= F.col("_p_occupancy"))
        & (F.col("structures") <= F.col("_p_structures"))
        & ~improved
        & (F.col("debts") >= F.col("_p_debts"))
    )
    marked = seen.withColumn("stalled", stalled)
    numbered = number_by_key(marked, [run], [cycle], "_no", max_rows=max_rows)
    broke = F.when(~F.col("stalled"), F.col("_no"))
    placed = prefix_by_key(numbered, [run], ["_no"], maxima={"_last": broke}, max_rows=max_rows)
    length = F.when(F.col("stalled"), F.col("_no") - F.coalesce("_last", F.lit(0))).otherwise(0)
    return placed.select(
        run, cycle, "stalled", length.cast("long").alias("stagnant_cycles"), (length >= required).alias("stagnated")
    )


def collapse_detection(snapshots: DataFrame, group: Sequence[str], cycle: str, *, max_rows: int | None = None) -> DataFrame:
    """Cycles sharing at least two of five collapse symptoms with the cycle before (WIN10).

    Columns read: dominant, families, occupancy, budget, similarity.
    """
    def conditions(previous: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(F.col("dominant") >= COLLAPSE_LIMITS["dominant"], "dominant_cluster_fraction"),
                F.when(F.col("families") < COLLAPSE_LIMITS["families"], "effective_family_count"),
                F.when(F.col("occupancy") <= previous, "qd_occupancy_stalled"),
                F.when(F.col("budget") >= COLLAPSE_LIMITS["budget"], "hypothesis_budget_concentration"),
                F.when(F.col("similarity") > COLLAPSE_LIMITS["similarity"], "mean_agent_similarity"),
            )
        )

    first = with_neighbours(
        snapshots, group, [cycle], lambda w: {"_occ": F.lag("occupancy").over(w)}, before=1, max_rows=max_rows
    ).withColumn("conditions", conditions(F.col("_occ")))
    second = with_neighbours(
        first, group, [cycle], lambda w: {"_before": F.lag("conditions").over(w)}, before=1, max_rows=max_rows
    )
    shared = F.size(F.array_intersect("conditions", F.coalesce("_before", F.array().cast("array<string>"))))
    return second.select(*group, cycle, F.array_sort("conditions").alias("conditions"), (shared >= 2).alias("collapsed"))


def lineage_violations(cycles: DataFrame, pack: str, cycle: str, *, max_rows: int | None = None) -> DataFrame:
    """Cycles that left a lineage without closing, falsifying or converting it (WIN11)."""
    ahead = with_neighbours(
        cycles, [pack], [cycle], lambda w: {"_next": F.lead("lineage").over(w)}, before=0, after=1, max_rows=max_rows
    )
    released = F.col("closed") | F.col("falsified") | F.col("converted")
    return ahead.filter(F.col("_next").isNotNull() & (F.col("_next") != F.col("lineage")) & ~released).select(
        pack, cycle, "lineage"
    )


def recent_run_violations(
    selections: DataFrame, run: str, order: str, is_kind: Column, limit: int, *, max_rows: int | None = None
) -> DataFrame:
    """Selections of a kind whose previous `limit` selections were all of that kind too (WIN12)."""
    flagged = selections.withColumn("_kind", is_kind.cast("int"))
    recent = with_neighbours(
        flagged, [run], [order],
        lambda w: {
            "_same": F.sum("_kind").over(w.rowsBetween(-limit, -1)), "_seen": F.count("_kind").over(w.rowsBetween(-limit, -1))
        },
        before=limit, max_rows=max_rows,
    )
    return recent.filter((F.col("_kind") == 1) & (F.col("_seen") == limit) & (F.col("_same") == limit)).drop(
        "_kind", "_same", "_seen"
    )


def last_n(df: DataFrame, key: str, order: str, n: int, *, max_rows: int | None = None) -> DataFrame:
    """The most recent n rows per key, newest first (WIN13); the count per key replaces a falling sort."""
    numbered = number_by_key(df, [key], [order], "_no", max_rows=max_rows)
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_all"))
    return (
        join_null_safe(numbered, sizes, [key])
        .withColumn("recency", F.col("_all") - F.col("_no") + 1)
        .filter(F.col("recency") <= n)
        .drop("_no", "_all")
    )


def event_dedup(events: DataFrame, event_id: str, arrival: str) -> DataFrame:
    """Insert-or-ignore by event id: the first arrival stays (STR1)."""
    others = [c for c in events.columns if c != event_id]
    return events.groupBy(event_id).agg(F.min_by(F.struct(*others), F.col(arrival)).alias("_row")).select(event_id, "_row.*")


def latest_fields(
    events: DataFrame, entity: Sequence[str], sequence: str, fields: Mapping[str, tuple[Column, Column]],
    exists: Column | None = None,
) -> DataFrame:
    """Latest value of each patched field per entity (STR2).

    `fields` maps a name to (condition, value): the value of the last row whose condition holds. An
    entity appears when some row satisfies `exists`. Partial aggregation keeps one candidate per task,
    so no entity is ever collected.
    """
    order = F.col(sequence)
    aggregates = [
        F.max_by(F.struct(value.alias("v")), F.when(condition, order)).alias(f"_f_{name}")
        for name, (condition, value) in fields.items()
    ]
    present = F.max(exists if exists is not None else F.lit(True))
    made = events.groupBy(*entity).agg(present.alias("_exists"), *aggregates).filter("_exists")
    return made.select(*entity, *[F.col(f"_f_{n}.v").alias(n) for n in fields])


def run_state_fold(events: DataFrame, run: str, sequence: str) -> DataFrame:
    """Run status, phase, loop state, live brief and counters (STR3).

    Columns read: event_type, phase, run_status, loop_state. A brief lives until the phase leaves
    exploitation after it.
    """
    kind, order = F.col("event_type"), F.col(sequence)
    status = (
        F.when(kind == "VIOLATION_DETECTED", "blocked")
        .when(kind == "RUN_FINALIZED", "completed")
        .when(kind.isin("RUN_CREATED", "STATE_CHANGED"), F.col("run_status"))
    )
    phase = F.when(kind == "RUN_FINALIZED", "finalized").when(kind.isin("RUN_CREATED", "PHASE_CHANGED"), F.col("phase"))
    leaves = (kind == "PHASE_CHANGED") & (F.col("phase") != "exploitation")
    made = events.groupBy(run).agg(
        F.max_by(status, F.when(status.isNotNull(), order)).alias("status"),
        F.max_by(phase, F.when(phase.isNotNull(), order)).alias("phase"),
        F.coalesce(
            F.max_by("loop_state", F.when(kind == "STATE_CHANGED", order)), F.lit("created")
        ).alias("loop_state"),
        F.max(F.when(kind == "RESEARCH_BRIEF_CREATED", order)).alias("_brief"),
        F.max(F.when(leaves, order)).alias("_left"),
        F.count_if(kind == "VIOLATION_DETECTED").alias("violations"),
        F.max(F.when(kind == "RUN_FINALIZED", order)).alias("finalized_at"),
    )
    alive = F.col("_brief").isNotNull() & (F.col("_left").isNull() | (F.col("_brief") > F.col("_left")))
    return made.withColumn("brief_sequence", F.when(alive, F.col("_brief"))).drop("_brief", "_left")


def experiment_statuses(events: DataFrame, run: str, experiment: str, sequence: str) -> DataFrame:
    """Latest decided status per experiment; the first proposal's status until then (STR3)."""
    kind, order = F.col("event_type"), F.col(sequence)
    decided = (
        F.when(kind == "EXPERIMENT_REJECTED", "rejected")
        .when(kind == "EXPERIMENT_SELECTED", "selected")
        .when(kind == "EXPERIMENT_STARTED", "running")
        .when(kind == "EXPERIMENT_COMPLETED", "completed")
        .when(kind == "EXPERIMENT_FAILED", "failed")
    )
    made = events.groupBy(run, experiment).agg(
        F.max_by(decided, F.when(decided.isNotNull(), order)).alias("_decided"),
        F.min_by("status", F.when(kind == "EXPERIMENT_PROPOSED", order)).alias("_proposed"),
    )
    return made.select(run, experiment, F.coalesce("_decided", "_proposed").alias("status"))


def budget_running_totals(
    deltas: DataFrame, run: str, sequence: str, fields: Sequence[str] = USAGE_FIELDS, *, max_rows: int | None = None
) -> DataFrame:
    """Usage after each event, never below zero (STR4).

    A sum held at zero equals the plain running sum plus its deepest shortfall so far, so two
    prefix passes replace the sequential fold.
    """
    # Both passes order the same rows, so one check of their sizes is enough.
    small = hot_keys(deltas, [run], max_rows)[1] == 0
    summed = prefix_by_key(deltas, [run], [sequence], {f"_s_{f}": F.col(f) for f in fields}, max_rows=max_rows, known_small=small)
    summed = summed.withColumns({f"_s_{f}": F.col(f"_s_{f}") + F.col(f) for f in fields})
    floored = prefix_by_key(
        summed, [run], [sequence], maxima={f"_m_{f}": -F.col(f"_s_{f}") for f in fields}, max_rows=max_rows, known_small=small
    )
    return floored.select(
        run, sequence,
        *[
            (F.col(f"_s_{f}") + F.greatest(F.lit(0.0), F.coalesce(f"_m_{f}", F.lit(0.0)), -F.col(f"_s_{f}"))).alias(f)
            for f in fields
        ],
    )


def _compose(first: Column, then: Column) -> Column:
    """The move x -> clip(x + a, b, c) that does `first` and then `then`; such moves are closed."""
    held = lambda v: F.greatest(then["b"], F.least(then["c"], v + then["a"]))
    return F.struct(
        (first["a"] + then["a"]).alias("a"), held(first["b"]).alias("b"), held(first["c"]).alias("c")
    )


def _moves_before(moves: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Composition of all earlier moves of a key."""
    identity = F.struct(
        F.lit(0.0).alias("a"), F.lit(float("-inf")).alias("b"), F.lit(float("inf")).alias("c")
    )
    return fold_before(moves, keys, index, identity, "struct<a:double,b:double,c:double>", _compose, FOLD_CHUNK)


def belief_trajectory(
    updates: DataFrame, priors: DataFrame, hypothesis: str, sequence: str, weight: str, prior: str, *, max_rows: int | None = None
) -> DataFrame:
    """Confidence after each evidence update, clipped after every step (STR5).

    In log-odds a step is a shift held in a range. Such moves compose, so long histories fold in
    chunks of bounded size instead of one sequential pass.
    """
    low, high = (math.log(p / (1 - p)) for p in BELIEF_RANGE)
    numbered = number_by_key(updates, [hypothesis], [sequence], "_no", max_rows=max_rows).withColumn("_no", F.col("_no") - 1)
    move = F.struct(F.col(weight).alias("a"), F.lit(low).alias("b"), F.lit(high).alias("c"))
    before = _moves_before(numbered.select(hypothesis, "_no", move.alias("_move")), [hypothesis], "_no")
    rows = numbered.join(before, [hypothesis, "_no"]).join(priors.select(hypothesis, prior), hypothesis)
    p = F.greatest(F.lit(BELIEF_RANGE[0]), F.least(F.lit(BELIEF_RANGE[1]), F.col(prior)))
    held = lambda m, x: F.greatest(m["b"], F.least(m["c"], x + m["a"]))
    start = held(F.col("_prior"), F.log(p / (1 - p)))
    after = F.greatest(F.lit(low), F.least(F.lit(high), start + F.col(weight)))
    return rows.select(hypothesis, sequence, (1 / (1 + F.exp(-after))).alias("confidence"))


def query_budget_gate(
    queries: DataFrame, run: str, sequence: str, policy: str, max_queries: int, *, max_rows: int | None = None
) -> DataFrame:
    """Verdict per holdout query (STR6): only accepted queries use the budget.

    Columns read: score, threshold (nullable), reveal_score.
    """
    strict, gated = policy == "strict_blind", policy == "gated_binary"
    bad = (
        F.when(F.col("threshold").isNull(), "THRESHOLD_REQUIRED").when(F.col("reveal_score"), "NUMERIC_SCORE_REQUEST")
        if gated
        else F.lit(None).cast("string")
    )
    marked = queries.withColumn("_bad", F.lit("STRICT_BLIND_QUERY") if strict else bad)
    placed = prefix_by_key(marked, [run], [sequence], {"_valid": F.col("_bad").isNull().cast("int")}, max_rows=max_rows)
    spent = F.lit(bool(max_queries)) & (F.col("_valid") >= max_queries) & F.lit(not strict)
    refusal = F.when(spent, "QUERY_BUDGET_EXCEEDED").otherwise(F.col("_bad"))
    made = placed.withColumn("refusal", refusal)
    accepted = F.col("refusal").isNull()
    return made.select(
        run, sequence, "refusal", accepted.alias("accepted"),
        F.when(accepted, F.col("score") >= F.col("threshold")).alias("passed"),
        (F.when(accepted, F.col("score")) if not gated else F.lit(None).cast("double")).alias("revealed_score"),
    )


def _token_pass(total: int, proposal_limit: int, cluster_limit: int, reserve: int):
    """Streaming fold over rows sorted by (run, sequence); state is one run's counters."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, spent, for_candidates, clusters = None, 0, 0, {}
        for batch in batches:
            verdicts = []
            for key, cluster, tokens, candidate in zip(batch.run, batch.cluster, batch.tokens, batch.candidate):
                if key != run:
                    run, spent, for_candidates, clusters = key, 0, 0, {}
                used = clusters.get(cluster, 0)
                left = total - spent - tokens
                if tokens <= 0 or tokens > proposal_limit:
                    verdict = "proposal_limit"
                elif used + tokens > cluster_limit:
                    verdict = "cluster_limit"
                elif left < 0:
                    verdict = "total_budget"
                elif not candidate and left < max(0, reserve - for_candidates):
                    verdict = "candidate_reserve"
                else:
                    verdict = None
                    spent += tokens
                    clusters[cluster] = used + tokens
                    for_candidates += tokens if candidate else 0
                verdicts.append(verdict)
            yield batch[["run", "sequence"]].assign(refusal=verdicts)

    return fold


def token_budget_gate(
    requests: DataFrame, run: str, sequence: str, total: int, proposal_limit: int, cluster_limit: int, reserve_fraction: float = 0.35,
    *, max_rows: int | None = None,
) -> DataFrame:
    """Refusal reason per token request, null when accepted (STR7). Columns read: cluster, tokens, candidate.

    Refused requests use nothing, so a run that never hits a limit is decided by running sums alone.
    Runs that do hit one take an ordered pass per run which holds only the run's counters.
    """
    reserve = int(total * reserve_fraction)
    tokens, candidate = F.col("tokens"), F.col("candidate").cast("boolean")
    by_run = prefix_by_key(
        requests, [run], [sequence],
        {"_spent": tokens, "_cand": F.when(candidate, tokens).otherwise(0)}, max_rows=max_rows,
    )
    by_cluster = prefix_by_key(by_run, [run, "cluster"], [sequence], {"_used": tokens}, max_rows=max_rows)
    left = F.lit(total) - F.col("_spent") - tokens
    breaks = (
        (tokens <= 0) | (tokens > proposal_limit) | (F.col("_used") + tokens > cluster_limit) | (left < 0)
        | (~candidate & (left < F.greatest(F.lit(0), F.lit(reserve) - F.col("_cand"))))
    )
    # Runs meet by their JSON text, so that requests without a run are a run of their own.
    keyed = lambda d: d.withColumn("_run_key", F.to_json(F.struct(F.col(run).alias("r"))))
    contested = keyed(by_cluster.filter(breaks)).select("_run_key").distinct()
    requests = keyed(requests)
    free = requests.join(contested, "_run_key", "left_anti").select(run, sequence, F.lit(None).cast("string").alias("refusal"))
    contended = requests.join(contested, "_run_key", "left_semi").select(
        F.col("_run_key").alias("run"), F.col(sequence).alias("sequence"), "cluster", "tokens", candidate.alias("candidate")
    )
    ordered = contended.repartition("run").sortWithinPartitions("run", "sequence")
    types = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    decided = ordered.mapInPandas(
        _token_pass(total, proposal_limit, cluster_limit, reserve),
        f"run string, sequence {types['sequence']}, refusal string",
    )
    kind = requests.schema[run].dataType
    back = F.from_json("run", StructType([StructField("r", kind)]))["r"].alias(run)
    return free.unionByName(decided.select(back, F.col("sequence").alias(sequence), "refusal"))


def niche_budget(
    charges: DataFrame, minimums: Mapping[str, float], keys: Sequence[str], niche: str, sequence: str, amount: str,
    *, max_rows: int | None = None,
) -> DataFrame:
    """Spend per niche after each charge and whether it is still below its protected minimum (STR8)."""
    table = F.create_map(*[F.lit(x) for pair in minimums.items() for x in pair])
    placed = prefix_by_key(charges, [*keys, niche], [sequence], {"_s": F.col(amount)}, max_rows=max_rows)
    return placed.select(
        *keys, niche, sequence, (F.col("_s") + F.col(amount)).alias("spent"),
        (F.col("_s") + F.col(amount) < F.try_element_at(table, F.col(niche))).alias("protected"),
    )


def evidence_routing(
    evidence: DataFrame, recipients: Sequence[str], current_cycle: Column, mode: str, interval: int = 3,
    phase_boundary: Column | None = None,
) -> DataFrame:
    """Which evidence reaches which agent, and under whose name (STR9).

    Columns read: producer, visibility, challenge_target, created_cycle. The agents of a study are a
    short list, so each evidence row expands to them in place.
    """
    boundary = F.lit(False) if phase_boundary is None else phase_boundary
    spread = evidence.withColumn("recipient", F.explode(F.array(*[F.lit(r) for r in recipients])))
    own = F.col("recipient") == F.col("producer")
    safety = F.col("visibility") == "global_safety"
    challenge = (F.col("visibility") == "shared_challenge") & (F.col("recipient") == F.col("challenge_target"))
    fact = (F.col("visibility") == "shareable_fact") & (boundary | (current_cycle >= F.col("created_cycle") + interval))
    selective = {"no_sharing": F.lit(False), "full_live_sharing": F.lit(True)}.get(mode, challenge | fact)
    hidden = ~own & ~safety & challenge & F.lit(mode not in ("no_sharing", "full_live_sharing"))
    return spread.filter(own | safety | selective).withColumn(
        "shown_producer", F.when(hidden, "withheld").otherwise(F.col("producer"))
    )


def calibration_prior_shrink(
    hypotheses: DataFrame, records: DataFrame, minimum_records: int, poor_brier: float, shrinkage: float
) -> DataFrame:
    """Priors of agents or categories with poor calibration, pulled toward one half (STR10).

    Records match by agent or by category; a record matching both counts once, so the two groups are
    added and their overlap subtracted.
    """
    scored = forecast_calibration(
        records, "probabilities", "observed_label", "coverage", ["agent", "category"]
    ).select("agent", "category", F.col("n").alias("_n"), (F.col("brier") * F.col("n")).alias("_b"))
    by_agent = scored.groupBy("agent").agg(F.sum("_n").alias("_na"), F.sum("_b").alias("_ba"))
    by_category = scored.groupBy("category").agg(F.sum("_n").alias("_nc"), F.sum("_b").alias("_bc"))
    joined = (
        hypotheses.join(by_agent, "agent", "left").join(by_category, "category", "left").join(scored, ["agent", "category"], "left")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = zero("_na") + zero("_nc") - zero("_n")
    brier = F.try_divide(zero("_ba") + zero("_bc") - zero("_b"), n)
    poor = (n >= minimum_records) & (brier > poor_brier)
    shrunk = 0.5 + (F.col("prior") - 0.5) * (1 - shrinkage)
    return joined.select(
        *hypotheses.columns, n.alias("records"),
        F.when(poor, shrunk).otherwise(F.col("prior")).alias("used_prior"),
        F.when(poor, F.col("prior")).alias("original_prior"),
    )
