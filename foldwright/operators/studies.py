"""Study scorecards over (suite, run, agent, seed, item) tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.operators.audit import Audited
from foldwright.operators.metrics import auc, binary_calibration, effective_count, spearman
from foldwright.operators.ordering import number_by_key, with_medians
from foldwright.operators.rates import rate, rate_where, validation_fidelity
from foldwright.operators.resample import paired_bootstrap_interval

# Preflight thresholds, support share of a seed family, and the measured state dimensions.
SUPPORT_SHARE = 2 / 3
MINIMUM_SEEDS = 3
RESEARCH_GAIN, INDEPENDENT_GAIN, NON_ACTIONABLE_INDEPENDENT, SMALL_TRANSFER = 0.02, 0.05, 0.10, 0.02
RESOLVED = ("supported", "contested", "falsified")


def alias_resolution(rows: DataFrame, aliases: DataFrame, truth: DataFrame) -> Audited:
    """Opaque (run, pack, context) to canonical truth (JOI11).

    Violations: contexts without an alias, and opaque packs that map to several canonical packs.
    """
    key = ["run_id", "opaque_pack", "opaque_context"]
    named = rows.join(aliases, key, "left")
    unknown = named.filter(F.col("pack_id").isNull()).select(
        "run_id", "opaque_pack", F.lit("unknown_alias").alias("problem")
    )
    split = (
        named.filter(F.col("pack_id").isNotNull())
        .groupBy("run_id", "opaque_pack")
        .agg(F.count_distinct("pack_id").alias("_k"))
        .filter("_k > 1")
        .select("run_id", "opaque_pack", F.lit("several_packs").alias("problem"))
    )
    resolved = named.join(truth, ["pack_id", "context_id"])
    return Audited(resolved, unknown.distinct().unionByName(split))


def matched_negative_gate(packs: DataFrame) -> DataFrame:
    """A positive with a ladder level keeps its discovery only if its paired negative was rejected (JOI12).

    The pair is unique per (suite, run, pair), so the join adds no rows.
    """
    key = ["suite_id", "run_id", "pair_id"]
    negatives = packs.filter(~F.col("structure_present")).select(
        *key, (F.col("rejected") & ~F.col("false_promotion")).alias("_ok")
    )
    joined = packs.join(negatives, key, "left")
    blocked = (
        F.col("structure_present")
        & F.col("ladder_level").isNotNull()
        & F.col("discovered")
        & ~F.coalesce("_ok", F.lit(False))
    )
    return joined.withColumns(
        {
            "failure_stage": F.when(blocked, "matched_negative").otherwise(F.col("failure_stage")),
            "discovered": F.col("discovered") & ~blocked,
        }
    ).drop("_ok")


def mechanism_calibration(predictions: DataFrame, observations: DataFrame, key: Sequence[str]) -> Audited:
    """Sign, range, rank, slice and transfer hit rates per group (JOI13).

    Both sides hold `component`; a component on one side only is a violation.
    """
    on = [*key, "component"]
    merged = predictions.withColumn("_p", F.lit(True)).join(observations.withColumn("_o", F.lit(True)), on, "full_outer")
    lonely = merged.filter(F.col("_p").isNull() | F.col("_o").isNull()).select(*on)
    effect = F.col("effect")
    sign = F.when(effect > 1e-12, "positive").when(effect < -1e-12, "negative").otherwise("neutral")
    hits = {
        "sign_accuracy": sign == F.col("expected_sign"),
        "range_accuracy": (F.col("minimum_effect") <= effect) & (effect <= F.col("maximum_effect")),
        "rank_accuracy": F.col("predicted_rank") == F.col("observed_rank"),
        "slice_accuracy": F.arrays_overlap("predicted_slices", "observed_slices"),
        "transfer_accuracy": F.col("predicted_transfer") == F.col("observed_transfer"),
    }
    both = merged.filter(F.col("_p") & F.col("_o"))
    made = both.groupBy(*key).agg(F.count(F.lit(1)).alias("components"), *[rate(c).alias(n) for n, c in hits.items()])
    perfect = F.lit(True)
    for name in hits:
        perfect = perfect & (F.col(name) == 1)
    return Audited(made.withColumn("status", F.when(perfect, "pass").otherwise("partial")), lonely)


def decision_audit(locks: DataFrame, outcomes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sign accuracy, false rejection, false adoption and regret of locked decisions (JOI14)."""
    parent, challenger = F.col("parent_auc"), F.col("challenger_auc")
    chose = F.col("selected") == "challenger"
    rejected, adopted = ~chose & (challenger > parent), chose & (challenger < parent)
    regret = F.greatest(parent, challenger) - F.when(chose, challenger).otherwise(parent)
    joined = locks.join(outcomes, "decision_id")
    grouped = joined.groupBy(*keys) if keys else joined
    return grouped.agg(
        F.count(F.lit(1)).alias("decisions"),
        rate(~rejected & ~adopted).alias("sign_accuracy"),
        rate(rejected).alias("false_rejection"),
        rate(adopted).alias("false_adoption"),
        F.avg(regret).alias("mean_regret"),
        F.sum(regret).alias("total_regret"),
    )


def lock_violations(locks: DataFrame, fields: Sequence[str], digest: str) -> DataFrame:
    """Locks whose digest no longer matches their fields (JOI14)."""
    ordered = F.struct(*[F.col(f) for f in sorted(fields)])
    return locks.filter(F.col(digest) != F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256))


def ledger_reveal_join(records: DataFrame, competition: str) -> DataFrame:
    """Spent submissions with the score they carry or the last one revealed later (JOI15)."""
    revealed = (
        records.filter((F.col("mode") == "score_revealed") & F.col("score_id").isNotNull())
        .groupBy("score_id")
        .agg(F.max_by(F.struct("public_score"), "sequence")["public_score"].alias("_revealed"))
    )
    spent = records.filter((F.col("competition") == competition) & (F.col("mode") == "execute"))
    return spent.join(revealed, "score_id", "left").select(
        "sequence", "fingerprint", "local_estimate", F.coalesce("public_score", "_revealed").alias("public_score")
    )


def run_scorecard(packs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rates of one run or of any pooling of runs, in one grouped pass (AGG25)."""
    positive = F.col("structure_present")
    actionable = positive & F.col("discovered") & F.col("predictive_utility")
    cycles = F.col("mode") != "exploit"
    done = F.col("lineage_followup") | F.col("lineage_closed")
    card = packs.groupBy(*keys).agg(
        F.count_if(positive).alias("positives"),
        F.count_if(~positive).alias("negatives"),
        rate_where(F.col("discovered"), positive).alias("tsdr"),
        rate_where(F.col("rejected"), ~positive).alias("tsrr"),
        rate_where(F.col("false_promotion"), ~positive).alias("fspr"),
        rate(F.col("resolution") != "inconclusive").alias("resolution_rate"),
        rate_where(F.col("transfer_gain") > 0, actionable).alias("ustr"),
        F.count_distinct("family").alias("families"),
        F.count_distinct("mode").alias("action_types"),
        F.coalesce(rate_where(F.col("converted"), cycles), F.lit(0.0)).alias("eecr"),
        F.coalesce(rate_where(done, cycles), F.lit(0.0)).alias("deep_completion"),
        F.avg("regret").alias("mean_regret"),
    )
    families = effective_count(packs, "family", list(keys)).withColumnRenamed("effective_count", "effective_families")
    return card.join(families.drop("dominant_share"), list(keys))


def run_calibrations(packs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Four calibrations of a run, long: structure, evidence, actionable and transfer (AGG25)."""
    pairs = {
        "structure": ("p_structure", F.col("structure_present")),
        "evidence": ("p_evidence", F.col("discovered")),
        "actionable": ("p_actionable", F.col("structure_present") & F.col("predictive_utility")),
        "transfer": ("p_transfer", F.col("transfer_gain") > 0),
    }
    arms = F.array(
        *[F.struct(F.lit(n).alias("claim"), F.col(p).alias("p"), o.alias("outcome")) for n, (p, o) in pairs.items()]
    )
    return binary_calibration(packs.select(*keys, F.inline(arms)), "p", "outcome", [*keys, "claim"])


def population_block(packs: DataFrame, keys: Sequence[str], agent: str, item: str) -> DataFrame:
    """Union rates, blind spots, complementarity and leave-one-agent-out rates per block (AGG26).

    Items fold to the number of agents that found them. An item is lost without an agent exactly when
    that agent alone found it, so no agent set is ever formed.
    """
    keys = list(keys)
    by_agent = packs.groupBy(*keys, item, agent).agg(
        F.max("structure_present").alias("positive"),
        F.max("discovered").alias("_d"),
        F.max(F.col("rejected") & ~F.col("structure_present")).alias("_r"),
        F.max("false_promotion").alias("_f"),
    )
    items = by_agent.groupBy(*keys, item).agg(
        F.max("positive").alias("positive"),
        F.count_if("_d").alias("_nd"),
        F.count_if("_r").alias("_nr"),
        F.max("_f").alias("_f"),
    )
    union = items.groupBy(*keys).agg(
        F.count_if("positive").alias("positives"),
        F.count_if(~F.col("positive")).alias("negatives"),
        F.count_if((F.col("_nd") > 0)).alias("_ud"),
        F.count_if((F.col("_nr") > 0)).alias("_ur"),
        F.count_if("_f").alias("_uf"),
        F.count_if(F.col("positive") & (F.col("_nd") == 0)).alias("_missed"),
    )
    agents = by_agent.join(items.select(*keys, item, "_nd", "_nr"), [*keys, item]).groupBy(*keys, agent).agg(
        F.count_if("_d").alias("_own_d"),
        F.count_if("_r").alias("_own_r"),
        F.count_if(F.col("_d") & (F.col("_nd") == 1)).alias("_only_d"),
        F.count_if(F.col("_r") & (F.col("_nr") == 1)).alias("_only_r"),
    )
    best = agents.groupBy(*keys).agg(
        F.max("_own_d").alias("_best_d"), F.max("_own_r").alias("_best_r"), F.max("_only_r").alias("_worst_loss")
    )
    p, n = F.col("positives"), F.col("negatives")
    return union.join(best, keys).select(
        *keys, "positives", "negatives",
        F.try_divide(F.col("_ud"), p).alias("union_tsdr"),
        F.try_divide(F.col("_ur"), n).alias("union_tsrr"),
        F.try_divide(F.col("_uf"), n).alias("union_fspr"),
        F.try_divide(F.col("_missed"), p).alias("blind_spot"),
        F.try_divide(F.col("_ud") - F.col("_best_d"), p).alias("discovery_complementarity"),
        F.try_divide(F.col("_ur") - F.col("_best_r"), n).alias("rejection_complementarity"),
        F.try_divide(F.col("_ur") - F.col("_worst_loss"), n).alias("leave_one_out_tsrr"),
    )


def marginal_contribution(packs: DataFrame, keys: Sequence[str], agent: str, item: str) -> DataFrame:
    """Discovery rate a block loses without an agent (AGG26)."""
    keys = list(keys)
    found = packs.filter("discovered").select(*keys, item, agent).distinct()
    lone = found.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_n"), F.min(agent).alias(agent)).filter("_n = 1")
    losses = lone.groupBy(*keys, agent).agg(F.count(F.lit(1)).alias("_lost"))
    positives = packs.filter("structure_present").groupBy(*keys).agg(F.count_distinct(item).alias("_p"))
    agents = packs.select(*keys, agent).distinct()
    return (
        agents.join(losses, [*keys, agent], "left")
        .join(positives, keys)
        .select(*keys, agent, (F.coalesce("_lost", F.lit(0)) / F.col("_p")).alias("marginal_tsdr"))
    )


def grid_violations(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing, unexpected and repeated runs of a study grid (AGG27)."""
    keys = list(keys)
    counts = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    merged = expected.select(*keys).distinct().withColumn("_e", F.lit(1)).join(counts, keys, "full_outer")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_n") > 1, "repeated")
    return merged.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(*keys, "problem")


def population_rollup(agents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Medians over agents, worst cases and block minima, one row (AGG27)."""
    a = agents.agg(
        F.count(F.lit(1)).alias("agents"), F.max("fspr").alias("worst_fspr"),
    )
    a = with_medians(a, agents, [], {f"median_{m}": F.col(m) for m in ("tsdr", "tsrr", "ustr")})
    b = blocks.agg(
        F.min("leave_one_out_tsrr").alias("minimum_leave_one_out_tsrr"), F.avg("blind_spot").alias("mean_blind_spot")
    )
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def failure_stage_counts(packs: DataFrame) -> DataFrame:
    """Missed positives per failure stage (AGG27)."""
    missed = packs.filter(F.col("structure_present") & ~F.col("discovered"))
    return missed.groupBy("failure_stage").agg(F.count(F.lit(1)).alias("missed"))


def arm_summary(cards: DataFrame, arm: str, metrics: Sequence[str] = ("tsdr", "tsrr", "fspr")) -> DataFrame:
    """Mean, median and maximum of run rates per arm (AGG28)."""
    made = cards.groupBy(arm).agg(
        F.count(F.lit(1)).alias("runs"), *[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("max", F.max))]
    )
    return with_medians(made, cards, [arm], {f"median_{m}": F.col(m) for m in metrics})


def sign_test_p(positive: Column, total: Column) -> Column:
    """Exact two-sided sign test from the smaller tail (AGG29); 1 when nothing differs."""
    tail = F.least(positive, total - positive)
    # The sum is kept in units of its latest term and that term as a logarithm: 2 ** -total leaves the range of doubles.
    start = F.struct(F.lit(1.0).alias("sum"), (-total * F.log(F.lit(2.0))).alias("log"))
    ratio = lambda i: (total - i + 1) / i
    added = F.aggregate(
        F.filter(F.sequence(F.lit(0).cast("long"), tail.cast("long")), lambda i: i > 0),
        start,
        lambda acc, i: F.struct((acc["sum"] / ratio(i) + 1).alias("sum"), (acc["log"] + F.log(ratio(i))).alias("log")),
        lambda acc: F.exp(acc["log"] + F.log(acc["sum"])),
    )
    return F.when(total > 0, F.least(F.lit(1.0), 2 * added)).otherwise(F.lit(1.0))


def paired_arm_statistics(
    scores: DataFrame, arm: str, seed: str, score: str, pairs: Sequence[tuple[str, str]], resamples: int = 10_000, draw_seed: int | str = 0
) -> DataFrame:
    """Differences of arm pairs over shared seeds: centre, extremes, positive share, sign test and the 95 % bootstrap
    interval of the mean (AGG29)."""
    wanted = scores.sparkSession.createDataFrame(list(pairs), "treatment string, comparator string")
    left = scores.select(F.col(arm).alias("treatment"), seed, F.col(score).alias("_t"))
    right = scores.select(F.col(arm).alias("comparator"), seed, F.col(score).alias("_c"))
    joined = left.join(wanted, "treatment").join(right, ["comparator", seed])
    rows = joined.withColumn("delta", F.col("_t") - F.col("_c"))
    made = rows.groupBy("treatment", "comparator").agg(
        F.count(F.lit(1)).alias("seeds"),
        F.avg("delta").alias("mean"),
        rate(F.col("delta") > 0).alias("positive_rate"),
        F.min("delta").alias("worst"),
        F.max("delta").alias("best"),
        F.count_if(F.col("delta") > 0).alias("_pos"),
        F.count_if(F.col("delta") != 0).alias("_all"),
    )
    made = with_medians(made, rows, ["treatment", "comparator"], {"median": F.col("delta")})
    bounds = paired_bootstrap_interval(rows, ["treatment", "comparator"], seed, "delta", resamples, seed=draw_seed)
    tested = made.withColumn("sign_p", sign_test_p(F.col("_pos"), F.col("_all"))).drop("_pos", "_all")
    return tested.join(bounds.select("treatment", "comparator", "low", "high"), ["treatment", "comparator"])


def arm_outcomes(scores: DataFrame, arm: str, seed: str, score: str, local: str) -> DataFrame:
    """Per arm mean and median score, win rate (ties count for all) and local rank correlation (AGG29)."""
    top = scores.groupBy(seed).agg(F.max(score).alias("_top"))
    made = scores.join(top, seed).groupBy(arm).agg(
        F.avg(score).alias("mean_score"),
        rate(F.col(score) == F.col("_top")).alias("win_rate"),
    )
    made = with_medians(made, scores.filter(F.col(seed).isNotNull()), [arm], {"median_score": F.col(score)})
    ranks = spearman(scores, local, score, [arm], degenerate=None).select(arm, "spearman")
    return made.join(ranks, arm)


def discovery_share(text: Column, findings: Sequence[tuple[str, Sequence[str], int]]) -> Column:
    """Weighted share of findings whose patterns a text names (AGG31); findings are a fixed study plan."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    total, named = 0, F.lit(0)
    for _, patterns, weight in findings:
        found = F.lit(False)
        for p in patterns:
            found = found | F.contains(lowered, F.lit(p.lower()))
        named = named + F.when(found, weight).otherwise(0)
        total += weight
    return named / F.lit(float(total)) if total else F.lit(0.0)


def paired_benchmark_report(runs: DataFrame, baseline: str, contender: str, systems: int) -> Audited:
    """Per scenario: win rate, regrets, overhead, local-private gaps, discovery and efficiency (AGG31).

    Runs are pivoted to one row per (scenario, replicate); pairs without every system are violations.
    """
    take = lambda c, s: F.max(F.when(F.col("system") == s, F.col(c)))
    values = ("regret", "private_score", "cv_score", "cpu_hours", "discovery")
    pairs = runs.groupBy("scenario", "replicate").agg(
        F.count_distinct("system").alias("_systems"),
        F.max("negative_control").alias("negative_control"),
        *[take(v, baseline).alias(f"{v}_a") for v in values],
        *[take(v, contender).alias(f"{v}_b") for v in values],
    )
    unpaired = pairs.filter(F.col("_systems") != systems).select("scenario", "replicate")
    extra, removed = F.col("cpu_hours_b") - F.col("cpu_hours_a"), F.col("regret_a") - F.col("regret_b")
    report = (
        pairs.filter(F.col("_systems") == systems)
        .groupBy("scenario")
        .agg(
            F.max("negative_control").alias("negative_control"),
            F.count(F.lit(1)).alias("pairs"),
            rate(F.col("regret_b") < F.col("regret_a")).alias("win_rate"),
            F.avg("regret_a").alias("mean_regret_a"),
            F.avg("regret_b").alias("mean_regret_b"),
            F.avg(F.try_divide("cpu_hours_b", "cpu_hours_a") - 1).alias("mean_overhead"),
            F.avg(F.col("cv_score_a") - F.col("private_score_a")).alias("mean_gap_a"),
            F.avg(F.col("cv_score_b") - F.col("private_score_b")).alias("mean_gap_b"),
            F.avg("discovery_a").alias("discovery_a"),
            F.avg("discovery_b").alias("discovery_b"),
            F.avg(F.when(extra > 1e-9, removed / extra)).alias("regret_removed_per_hour"),
        )
    )
    return Audited(report, unpaired)


def arm_activity_summary(experiments: DataFrame, run: str, non_scoring: Sequence[str], direction: str) -> DataFrame:
    """Completed work, non-scoring share, best local score and lineages per run (AGG32)."""
    done = F.col("status") == "completed"
    best = F.max if direction == "maximize" else F.min
    return experiments.groupBy(run).agg(
        F.count_if(done).alias("completed"),
        F.coalesce(F.round(F.try_divide(F.count_if(done & F.col("kind").isin(*non_scoring)), F.count_if(done)), 3), F.lit(0.0)).alias("non_scoring_share"),
        best("metric").alias("best_local_score"),
        F.count_distinct(F.when(done, F.col("lineage"))).alias("lineages"),
        F.count_if(F.col("status") == "violation").alias("violations"),
    )


def signed_gap(steering: Column, public: Column, direction: str) -> Column:
    """Positive when the local estimate looked better than the public score (AGG32)."""
    gap = steering - public if direction == "maximize" else public - steering
    return F.round(gap, 4)


def preflight(df: DataFrame, pack: str, context: str, segment: str, target: str, oracle: str, control: str, *, metric: str = "auc") -> DataFrame:
    """Median over contexts of metric(oracle) - metric(control) per segment and the design verdict (AGG38).

    Columns structure_present, predictive_utility and independent are constant per context.
    """
    keys = [pack, context, segment]
    long = df.select(*keys, target, F.inline(F.array(
        F.struct(F.lit("oracle").alias("side"), F.col(oracle).alias("score")),
        F.struct(F.lit("control").alias("side"), F.col(control).alias("score")),
    )))
    if metric == "auc":
        scored = auc(long, target, "score", [*keys, "side"], degenerate="half").withColumnRenamed("auc", "_v")
    else:
        scored = spearman(long, target, "score", [*keys, "side"], degenerate=0.0).withColumnRenamed("spearman", "_v")
    signed = F.when(F.col("side") == "oracle", F.col("_v")).otherwise(-F.col("_v"))
    gains = scored.groupBy(*keys).agg(F.sum(signed).alias("_gain"))
    medians = with_medians(
        gains.select(pack).distinct(), gains, [pack], {s: F.when(F.col(segment) == s, F.col("_gain")) for s in ("research", "confirmation", "transfer")}
    )
    contexts = df.groupBy(pack, context).agg(
        F.max("structure_present").alias("_s"), F.max("predictive_utility").alias("_u"), F.max("independent").alias("_i")
    )
    design = contexts.groupBy(pack).agg(F.max("_s").alias("structure_present"), F.max("_u").alias("predictive_utility"))
    design = with_medians(design, contexts, [pack], {"independent": F.col("_i")})
    s, u, i = F.col("structure_present"), F.col("predictive_utility"), F.col("independent")
    verdict = (
        F.when(
            s & u,
            (F.col("research") > RESEARCH_GAIN) & (F.col("confirmation") > 0) & (F.col("transfer") > 0)
            & (i > INDEPENDENT_GAIN),
        )
        .when(s, (i > NON_ACTIONABLE_INDEPENDENT) & (F.abs("transfer") < SMALL_TRANSFER))
        .when(u, F.abs(i) < INDEPENDENT_GAIN)
        .otherwise((F.abs("research") < 1e-12) & (F.abs("transfer") < 1e-12))
    )
    return medians.join(design, pack).withColumn("identifiable", verdict)


def leave_one_context_out(df: DataFrame, pack: str, value: str, order: Sequence[str]) -> DataFrame:
    """Smallest median left after dropping any one context, and whether it stays positive (AGG39).

    Dropping a value above the middle gives the lowest remaining median, so two order statistics per
    pack decide; no context is compared with another. A single context has no remainder.
    """
    numbered = number_by_key(df, [pack], [value, *order], "_r")
    sizes = df.groupBy(pack).agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered.join(sizes, pack)
    half = F.floor(F.col("_n") / 2)
    # n = 2m: x_m. n = 2m+1: mean of x_m and x_(m+1).
    middle = F.when(F.col("_n") % 2 == 0, F.col("_r") == half).otherwise((F.col("_r") == half) | (F.col("_r") == half + 1))
    made = placed.groupBy(pack).agg(F.max("_n").alias("contexts"), F.avg(F.when(middle, F.col(value))).alias("_low"))
    lowest = F.when(F.col("contexts") > 1, F.col("_low"))
    return made.select(pack, "contexts", lowest.alias("lowest_median"), (lowest > 0).alias("stable"))


def leave_one_seed_out(df: DataFrame, family: str, seed: str, supports: str, share: float = SUPPORT_SHARE) -> Audited:
    """Whether support holds over all seeds and after dropping each one (AGG40).

    With s of n seeds in support, the hardest drop is a supporting seed: (s-1)/(n-1). Violations:
    families with too few seeds, repeated seeds, or a truth that changes between seeds.
    """
    made = df.groupBy(family).agg(
        F.count(F.lit(1)).alias("seeds"), F.count_distinct(seed).alias("_distinct"),
        F.count_if(supports).alias("supporting"), F.max("structure_present").alias("structure_present"),
        F.count_distinct("structure_present").alias("_truths"),
    )
    n, s = F.col("seeds"), F.col("supporting")
    full = s / n >= share
    dropped = F.try_divide(F.when(s > 0, s - 1).otherwise(s), n - 1) >= share
    bad = made.filter((n < MINIMUM_SEEDS) | (F.col("_distinct") != n) | (F.col("_truths") != 1)).select(family)
    result = made.withColumn("full_pass", full).withColumn("promoted", full & F.coalesce(dropped, F.lit(False)))
    return Audited(result.drop("_distinct", "_truths"), bad)


def adjudicated_stage(has_claim: Column, has_test: Column, has_code: Column, reported: Column) -> Column:
    """First failed stage from artifacts, the reported stage only after them (AGG49)."""
    return (
        F.when(~has_claim, "hypothesis_generation")
        .when(~has_test, "experiment_design")
        .when(~has_code, "implementation")
        .otherwise(reported)
    )


def null_provenance_audit(replicates: DataFrame, declared: DataFrame, pack: str, hashes: Sequence[str]) -> DataFrame:
    """Packs whose null replicates do not match what was declared, with the failed checks (AGG50)."""
    seen = replicates.join(declared.select(pack, "replicate", F.col("gain").alias("_declared")), [pack, "replicate"], "left")
    made = seen.groupBy(pack).agg(
        F.count(F.lit(1)).alias("replicates"),
        F.min("replicate").alias("_lo"), F.max("replicate").alias("_hi"), F.count_distinct("replicate").alias("_k"),
        F.count_if(F.coalesce(F.abs(F.col("gain") - F.col("_declared")) > 1e-9, F.lit(True))).alias("_off"),
        *[F.count_distinct(h).alias(f"_h_{h}") for h in hashes],
    )
    sizes = declared.groupBy(pack).agg(F.count(F.lit(1)).alias("_declared"))
    joined = made.join(sizes, pack, "full_outer").withColumn("replicates", F.coalesce("replicates", F.lit(0)))
    n = F.col("replicates")
    failed = F.array_compact(
        F.array(
            F.when(n != F.coalesce("_declared", F.lit(0)), "count"),
            F.when((F.col("_lo") != 1) | (F.col("_hi") != n) | (F.col("_k") != n), "indices"),
            F.when(F.col("_off") > 0, "gain"),
            *[F.when(F.col(f"_h_{h}") != n, h) for h in hashes],
        )
    )
    return joined.select(pack, "replicates", failed.alias("failed")).filter(F.size("failed") > 0)


def research_state(
    worlds: DataFrame, hypotheses: DataFrame, attacks: DataFrame, targets: Mapping[str, float], hypothesis_types: int
) -> DataFrame:
    """Fidelity, resolution, coverage, entropy and the gap to optional targets per run (AGG51).

    A dimension without a target stays out of the gap; with no targets the gap is null, never 0.
    """
    fidelity = validation_fidelity(
        F.col("rank_stability"), F.col("pseudo_future"), F.col("score_variance"), F.col("leakage_risk")
    )
    w = worlds.withColumn("_f", fidelity).groupBy("run_id").agg(
        F.try_divide(
            F.sum(F.when(F.col("_f").isNotNull(), F.col("posterior") * F.col("_f"))),
            F.sum(F.when(F.col("_f").isNotNull(), F.col("posterior"))),
        ).alias("validation_fidelity")
    )
    q = F.col("confidence")
    entropy = F.when((q > 0) & (q < 1), -(q * F.log2(q) + (1 - q) * F.log2(1 - q))).otherwise(0.0)
    active = F.col("status") != "retired"
    attacked = attacks.select("run_id", "hypothesis_id").distinct().withColumn("_a", F.lit(True))
    h = hypotheses.join(attacked, ["run_id", "hypothesis_id"], "left").groupBy("run_id").agg(
        F.count_if(active).alias("active"),
        rate(F.col("status").isin(*RESOLVED)).alias("hypothesis_resolution"),
        F.sum(F.when(active, entropy).otherwise(0.0)).alias("entropy_bits"),
        (F.count_distinct(F.when(active, F.col("kind"))) / F.lit(float(hypothesis_types))).alias("hypothesis_coverage"),
        F.coalesce(rate_where(F.col("_a"), active), F.lit(0.0)).alias("falsification_coverage"),
    )
    state = h.join(w, "run_id", "left")
    if not targets:
        return state.withColumn("total_gap", F.lit(None).cast("double"))
    gaps = [F.greatest(F.lit(0.0), F.lit(v) - F.coalesce(F.col(n), F.lit(0.0))) for n, v in targets.items()]
    return state.withColumn("total_gap", sum(gaps[1:], gaps[0]) / len(gaps))


def portfolio_scorecard(outcomes: DataFrame, agent: str) -> DataFrame:
    """Families, repeats, improvements, regret and best candidates per agent (AGG53).

    Regret is the best sealed value of any candidate or parent minus the last selected one.
    """
    sealed = F.col("sealed").isNotNull() & F.col("sealed_parent").isNotNull()
    made = outcomes.groupBy(agent).agg(
        F.count(F.lit(1)).alias("outcomes"),
        F.count_distinct("family").alias("families"),
        F.count_if("improved").alias("improvements"),
        F.max_by("candidate", F.struct("local", -F.col("sequence"))).alias("best_local"),
        F.max(F.when(sealed, F.greatest("sealed", "sealed_parent"))).alias("_oracle"),
        F.max_by(F.struct("selected"), F.when(sealed, F.col("sequence")))["selected"].alias("_last"),
        rate_where(F.col("sealed") > F.col("sealed_parent"), sealed & F.col("is_shadow")).alias("shadow_recovery"),
        F.count_if((F.col("uncertainty_reduction") > 0) & F.col("is_epistemic")).alias("falsification_tests"),
    )
    spread = effective_count(outcomes, "family", [agent]).select(agent, "effective_count")
    return made.join(spread, agent).withColumns(
        {
            "repeat_rate": 1 - F.col("families") / F.col("outcomes"),
            "regret": F.col("_oracle") - F.col("_last"),
            "qualifies": (F.col("families") >= 2) | (F.col("falsification_tests") >= 2),
        }
    ).drop("_oracle", "_last")


def population_portfolio(outcomes: DataFrame, scorecards: DataFrame) -> DataFrame:
    """Population gates over the agents' scorecards, one row (AGG53)."""
    families = effective_count(outcomes, "family").withColumn("_k", F.lit(1))
    actions = outcomes.groupBy("action").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.count(F.lit(1)).alias("action_types"), (F.max("_n") / F.sum("_n")).alias("dominant_action")
    ).withColumn("_k", F.lit(1))
    agents = scorecards.agg(
        F.count_if("qualifies").alias("qualifying"), rate(F.col("qualifies")).alias("independent_diversity")
    ).withColumn("_k", F.lit(1))
    joined = agents.join(families, "_k").join(actions, "_k").drop("_k")
    return joined.withColumns(
        {
            "diversity_gate": (F.col("qualifying") >= 2) & (F.col("effective_count") >= 2.5) & (F.col("dominant_share") <= 0.6),
            "action_gate": (F.col("action_types") >= 3) & (F.col("dominant_action") <= 0.70),
        }
    )


def run_event_report(events: DataFrame, run: str, kinds: Sequence[str]) -> DataFrame:
    """Event counts per type and the last sequence per run (AGG55)."""
    return events.groupBy(run).agg(
        F.count(F.lit(1)).alias("events"),
        *[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds],
        F.max("sequence").alias("last_sequence"),
        F.max_by("event_type", "sequence").alias("last_event_type"),
    )


def submission_diagnostics(predictions: DataFrame, labels: DataFrame, calls: DataFrame, run: str, row: str, baseline: float) -> DataFrame:
    """AUC of each run against sealed labels and its scorer-call history (AGG56)."""
    scored = predictions.join(labels.select(row, "target"), row)
    result = auc(scored, "target", "prediction", [run], degenerate="half").select(run, "n", "auc")
    history = calls.groupBy(run).agg(
        F.count(F.lit(1)).alias("calls"),
        (F.max_by("call_auc", "call_index") > F.min_by("call_auc", "call_index")).alias("_up"),
    )
    history = with_medians(history, calls, [run], {"median_call_auc": F.col("call_auc")})
    joined = result.join(history, run, "left")
    return joined.select(
        run, "n", "auc", (F.col("auc") > baseline).alias("beats_baseline"),
        F.coalesce("calls", F.lit(0)).alias("calls"), "median_call_auc",
        F.when(F.col("calls") >= 2, F.col("_up")).alias("trajectory_improved"),
    )


def operator_overlap(df: DataFrame, agent: str, operator: str) -> DataFrame:
    """Mean Jaccard of operator sets over all agent pairs, distinct operators counted (JOI20).

    Agents with equal sets fold to one weighted set, so copies of one behaviour never form pairs.
    Different sets meet through an equi-join on a shared operator; pairs that share nothing add 0.
    An agent's set is bounded by the operator vocabulary.
    """
    held = df.select(agent, F.trim(F.lower(operator)).alias("_op")).distinct()
    sets = (
        held.groupBy(agent)
        .agg(F.sort_array(F.collect_set("_op")).alias("_set"))
        .groupBy("_set")
        .agg(F.count(F.lit(1)).alias("_w"))
        .withColumn("_id", F.sha2(F.to_json("_set"), 256))
    )
    members = sets.select("_id", "_w", F.size("_set").alias("_n"), F.explode("_set").alias("_op"))
    left = members.select("_op", F.col("_id").alias("_a"), F.col("_w").alias("_wa"), F.col("_n").alias("_na"))
    right = members.select("_op", F.col("_id").alias("_b"), F.col("_w").alias("_wb"), F.col("_n").alias("_nb"))
    shared = left.join(right, "_op").filter(F.col("_a") < F.col("_b")).groupBy("_a", "_b").agg(
        F.count(F.lit(1)).alias("_s"), F.max(F.col("_wa") * F.col("_wb")).alias("_w"), F.max(F.col("_na") + F.col("_nb")).alias("_n")
    )
    apart = shared.agg(F.sum(F.col("_w") * F.col("_s") / (F.col("_n") - F.col("_s"))).alias("_apart")).withColumn("_k", F.lit(1))
    agents = sets.agg(
        F.sum("_w").alias("agents"), F.max(F.size("_set")).alias("largest_set"),
        F.sum(F.col("_w") * (F.col("_w") - 1) / 2).alias("_equal"),
    ).withColumn("_k", F.lit(1))
    total = agents.join(apart, "_k").withColumn("_sum", F.col("_equal") + F.coalesce("_apart", F.lit(0.0)))
    pairs = F.col("agents") * (F.col("agents") - 1) / 2
    return total.select(
        "agents", F.col("largest_set").cast("long").alias("largest_set"),
        F.when(pairs > 0, F.col("_sum") / pairs).otherwise(0.0).alias("mean_jaccard"),
    )
