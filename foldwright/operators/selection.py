"""Utilities, portfolios, elites and spend decisions."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from foldwright.operators.audit import ContractError
from foldwright.operators.columns import relative_gain
from foldwright.operators.metrics import kendall_tau_b
from foldwright.operators.ordering import join_null_safe, prefix_by_key
from foldwright.operators.text import proposal_similarity
from foldwright.session import cut_lineage, remove, scratch_path, stored

# Resource scales, gain penalties, quality and final-choice weights, decision impacts.
COST_SCALES = {"cpu_hours": 10.0, "gpu_hours": 5.0, "wall_hours": 10.0, "llm_tokens": 100_000.0, "monetary_cost": 25.0}
GAIN_PENALTIES = {"fold_std": 1.0, "seed_std": 1.0, "worst_group_gap": 1.0, "uncertainty": 0.5}
UTILITY_TERMS = (
    "pragmatic", "epistemic", "robustness", "diversity", "structural_leverage", "discrimination", "validation_debt_reduction",
)
COST_LAMBDA, RISK_LAMBDA = 0.15, 0.5
QUALITY = {"variance": 1.0, "cost": 0.1, "leakage": 1.0}
FINAL = {"robustness": 0.15, "diversity": 0.15, "variance": 1.0, "cost": 0.1, "leakage": 1.0}
QUALITY_FLOOR = 0.97
SIMILARITY_PENALTY = 0.25
DECISION_IMPACT = {"low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}
BUCKETS = {"exploit": ("exploit", "optimization"), "qd_explore": ("solution_explore", "ensemble", "ablation")}


def normalised_cost() -> Column:
    """Mean of the five scaled resources, kept in [0, 1]."""
    total = sum((F.col(c) / F.lit(s) for c, s in COST_SCALES.items()), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / len(COST_SCALES)))


def robust_gain() -> Column:
    """Mean gain minus fold, seed, group and half the uncertainty penalties."""
    return F.col("mean_gain") - sum((F.col(c) * w for c, w in GAIN_PENALTIES.items()), F.lit(0.0))


def utility_scores(proposals: DataFrame, decision: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """Weighted terms minus cost and risk, the gain rescaled inside each decision (TOP1).

    A decision with a single proposal keeps its raw gain.
    """
    staged = proposals.withColumns({"pragmatic": robust_gain(), "cost": normalised_cost()})
    sizes = staged.groupBy(*decision).agg(F.count(F.lit(1)).alias("_size"))
    scaled = relative_gain(staged, decision, "pragmatic", "_scaled").join(sizes, list(decision))
    risk = F.least(F.lit(1.0), F.col("failure_probability") + F.col("contamination"))
    scaled = scaled.withColumns(
        {"pragmatic": F.when(F.col("_size") > 1, F.col("_scaled")).otherwise(F.col("pragmatic")), "risk": risk}
    )
    total = sum((F.col(t) * float(weights.get(t, 0.0)) for t in UTILITY_TERMS), F.lit(0.0))
    return scaled.withColumn(
        "utility", total - COST_LAMBDA * F.col("cost") - RISK_LAMBDA * F.col("risk")
    ).drop("_scaled", "_size")


def experiment_bucket(kind: Column) -> Column:
    return F.when(kind.isin(*BUCKETS["exploit"]), "exploit").when(kind.isin(*BUCKETS["qd_explore"]), "qd_explore").otherwise("epistemic")


def _as_literal(row: Row) -> dict[str, Column]:
    made = {f: F.lit(row[f]) for f in ("lineage", "experiment_type")}
    for f in ("hypotheses", "metrics"):
        made[f] = F.array(*[F.lit(x) for x in row[f]]).cast("array<string>")
    return made


def diversified_top_k(
    proposals: DataFrame,
    size: int,
    penalty: float = SIMILARITY_PENALTY,
    minimum_utility: float = float("-inf"),
    allocation: Mapping[str, float] | None = None,
) -> DataFrame:
    """Greedy portfolio: each pick maximises utility minus its similarity to earlier picks (TOP2).

    Every round is one aggregate over the table; the few picks enter the next round as literals, so
    pairs never exist. Ties go to the larger id. With an allocation the furthest-behind bucket picks.
    """
    here = {f: F.col(f) for f in ("lineage", "experiment_type", "hypotheses", "metrics")}
    # Every round reads the same few columns, so they are computed and kept once.
    rows = cut_lineage(proposals.select("id", "utility", *here.values()))
    rows = rows.withColumns({"bucket": experiment_bucket(F.col("experiment_type")), "_sim": F.lit(0.0)})
    picked: list[tuple] = []
    counts = dict.fromkeys(allocation or (), 0)
    while len(picked) < size:
        taken = F.col("id").isin(*[p[0] for p in picked]) if picked else F.lit(False)
        free = rows.filter(~taken).withColumn("_marginal", F.col("utility") - penalty * F.col("_sim"))
        columns = ["id", "_marginal", "bucket", *here]
        best = F.max_by(F.struct(*columns), F.struct("_marginal", "id"))
        if allocation:
            want = max(allocation, key=lambda b: (allocation[b] * (len(picked) + 1) - counts.get(b, 0), b))
            pick = free.agg(
                F.max_by(F.struct(*columns), F.when(F.col("bucket") == want, F.struct("_marginal", "id"))).alias("w"), best.alias("b")
            ).first()
            chosen = pick["w"] or pick["b"]
        else:
            chosen = free.agg(best.alias("b")).first()["b"]
        if chosen is None or chosen["_marginal"] < minimum_utility:
            break
        counts[chosen["bucket"]] = counts.get(chosen["bucket"], 0) + 1
        picked.append((chosen["id"], len(picked) + 1, chosen["_marginal"]))
        rows = rows.withColumn("_sim", F.greatest("_sim", proposal_similarity(here, _as_literal(chosen))))
    kind = proposals.schema["id"].dataType.simpleString()
    return proposals.sparkSession.createDataFrame(picked, f"id {kind}, position long, marginal double")


def candidate_quality() -> Column:
    return (
        F.col("score") - QUALITY["variance"] * F.col("variance") - QUALITY["cost"] * F.col("cost")
        - QUALITY["leakage"] * F.col("leakage")
    )


def cell_elites(candidates: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Best quality, lowest cost, highest robustness and error diversity per cell (TOP3).

    The last three come from rows within 3% of the cell's best quality. The rule is stated on the
    whole cell, so it does not depend on the order in which candidates arrived.
    """
    scored = candidates.withColumn("quality", candidate_quality())
    top = scored.groupBy(*cell).agg(F.max("quality").alias("_top"))
    near = scored.join(top, list(cell)).withColumn(
        "_near", F.col("quality") >= F.col("_top") - F.abs("_top") * (1 - QUALITY_FLOOR)
    )
    elite = lambda order: F.max_by("id", F.when(F.col("_near"), F.struct(order.alias("o"), F.col("quality"), F.col("id"))))
    return near.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.max_by("id", F.struct("quality", "id")).alias("best_quality"),
        elite(-F.col("cost")).alias("lowest_cost"),
        elite(F.col("robustness")).alias("highest_robustness"),
        elite(F.col("error_diversity")).alias("highest_error_diversity"),
    )


def final_candidate(candidates: DataFrame) -> DataFrame:
    """The candidate with the best final utility, the larger id on ties (TOP4): one aggregate, no sort."""
    value = (
        F.col("score") + FINAL["robustness"] * F.col("robustness") + FINAL["diversity"] * F.col("error_diversity")
        - FINAL["variance"] * F.col("variance") - FINAL["cost"] * F.col("cost") - FINAL["leakage"] * F.col("leakage")
    )
    best = F.max_by(F.struct("id", "utility"), F.struct("utility", "id"))
    return candidates.withColumn("utility", value).agg(best.alias("b")).select("b.id", "b.utility")


def shortlist(candidates: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Candidates past the leakage, reproducibility and OOF gates by final utility, id on ties (TOP5).

    A missing forward score falls back to the primary score, a missing new-entity score counts 0.
    """
    forward = F.coalesce("forward_score", "primary_score")
    value = (
        weights["forward"] * forward + weights["robustness"] * F.col("robustness")
        + weights["new_entity"] * F.coalesce("new_entity_auc", F.lit(0.0)) + weights["ensemble_gain"] * F.col("ensemble_gain")
        - weights["uncertainty"] * F.col("uncertainty") - weights["leakage"] * F.col("leakage")
    )
    passed = candidates.filter(F.col("leakage_passed") & F.col("reproduced") & F.col("has_oof"))
    return passed.withColumn("utility", value).orderBy(F.desc("utility"), "id")


def ensemble_beats_members(candidates: DataFrame) -> DataFrame:
    """Eligible candidates: singles by their flag, ensembles only above every member (TOP6)."""
    members = candidates.filter("is_ensemble").select("id", F.explode("members").alias("member"))
    singles = candidates.filter("NOT is_ensemble").select(F.col("id").alias("member"), F.col("auc").alias("_m"))
    best = members.join(singles, "member", "left").groupBy("id").agg(
        F.max("_m").alias("_best"), F.bool_and(F.col("_m").isNotNull()).alias("_known")
    )
    joined = candidates.join(best, "id", "left")
    ensemble = F.col("ensemble_eligible") & F.col("past_only") & F.coalesce("_known", F.lit(False)) & (F.col("auc") > F.col("_best"))
    return joined.filter(F.when(F.col("is_ensemble"), ensemble).otherwise(F.col("standalone_eligible"))).drop("_best", "_known")


def final_selection(eligible: DataFrame) -> DataFrame:
    """Lexicographic best: AUC, worst horizon, smaller seed deviation, larger id (TOP6)."""
    order = F.struct("auc", "worst_horizon", (-F.col("seed_std")).alias("s"), "id")
    return eligible.agg(F.max_by(F.struct("id", "auc", "worst_horizon", "seed_std"), order).alias("b")).select("b.*")


def agent_elites(outcomes: DataFrame, agent: str) -> DataFrame:
    """Best performance, information and structural outcome per agent among valid rows (TOP7).

    The earlier outcome wins a tie. Columns read: sequence, candidate, valid, metric, reduction, claim, leverage.
    """
    valid = outcomes.filter("valid")
    first = lambda v, when=None: F.max_by(
        "candidate", F.when(F.lit(True) if when is None else when, F.struct(v.alias("v"), (-F.col("sequence")).alias("s")))
    )
    return valid.groupBy(agent).agg(
        first(F.col("metric")).alias("performance"),
        first(F.col("reduction")).alias("information"),
        first(F.col("leverage"), F.col("claim")).alias("structural"),
    )


def local_novelty(items: DataFrame, agent: str, sequence: str, descriptor: Sequence[str]) -> DataFrame:
    """Smallest share of differing descriptor values to any earlier item of the agent, 1 when none (TOP8).

    Two items differ in d of m values exactly when they agree on some choice of m-d. Distinct descriptors
    ask for choices of many values first; those that found an earlier one leave, so long descriptors do
    not ask for all 2^m choices.
    """
    m, keys = len(descriptor), [agent, *descriptor]
    firsts = cut_lineage(items.groupBy(*keys).agg(F.min(sequence).alias("_first")))
    begun = firsts.groupBy(agent).agg(F.min("_first").alias("_begin"))
    waiting = join_null_safe(firsts, begun, [agent]).filter(F.col("_first") > F.col("_begin")).drop("_begin")
    kept = [
        F.when(F.getbit(F.col("_mask"), F.lit(i)) == 1, F.coalesce(F.col(d).cast("string"), F.lit("<NA>"))) for i, d in enumerate(descriptor)
    ]

    def asked(df: DataFrame, agreeing: int) -> DataFrame:
        masks = [sum(1 << i for i in chosen) for chosen in itertools.combinations(range(m), agreeing)]
        # One text literal keeps the plan small however many choices there are.
        choices = F.split(F.lit(",".join(map(str, masks))), ",")
        rows = df.withColumn("_choice", F.explode(choices)).withColumn("_mask", F.col("_choice").cast("long")).drop("_choice")
        return rows.withColumn("_ask", F.concat_ws(":", "_mask", F.to_json(F.array(*kept))))

    near = None
    for agreeing in range(m - 1, 0, -1):
        if waiting.isEmpty():
            break
        earliest = asked(firsts, agreeing).groupBy(agent, "_ask").agg(F.min("_first").alias("_min"))
        met = join_null_safe(asked(waiting, agreeing), earliest, [agent, "_ask"]).filter(F.col("_min") < F.col("_first"))
        found = cut_lineage(met.select(*keys).distinct().withColumn("_near", F.lit((m - agreeing) / m)))
        near = found if near is None else near.unionByName(found)
        waiting = cut_lineage(join_null_safe(waiting, found.drop("_near"), keys, "left_anti"))
    joined = join_null_safe(items, firsts, keys)
    joined = join_null_safe(joined, near, keys) if near is not None else joined.withColumn("_near", F.lit(None).cast("double"))
    value = F.when(F.col(sequence) > F.col("_first"), 0.0).otherwise(F.coalesce("_near", F.lit(1.0)))
    return joined.select(*items.columns, value.alias("novelty"))


def nearest_distance(candidates: DataFrame, measured: DataFrame, value: str) -> DataFrame:
    """Distance from each candidate value to the nearest measured one (TOP9).

    On the union in value order, the nearest measured neighbours are a running maximum from the left
    and, with signs turned, from the right.
    """
    both = candidates.withColumn("_known", F.lit(False)).unionByName(
        measured.select(value).withColumn("_known", F.lit(True)), allowMissingColumns=True
    )
    left = prefix_by_key(
        both.withColumn("_o", F.when(F.col("_known"), 0).otherwise(1)), [], [value, "_o"],
        maxima={"_below": F.when(F.col("_known"), F.col(value))},
    ).withColumn("_neg", -F.col(value))
    around = prefix_by_key(left, [], ["_neg", "_o"], maxima={"_above": F.when(F.col("_known"), F.col("_neg"))})
    gap = F.least(F.col(value) - F.col("_below"), -F.col("_above") - F.col(value))
    return around.filter(~F.col("_known")).select(*candidates.columns, gap.alias("distance"))


def spend_decision(
    candidates: DataFrame,
    submitted: DataFrame,
    remaining: int,
    direction: str,
    minimum_points: int = 3,
    agreement: float = 0.3,
    noise_multiplier: float = 1.0,
) -> DataFrame:
    """Whether to spend a submission, on what, and why (TOP9): one row (spend, reason, name, tau).

    candidates: name, fingerprint, estimate, noise. submitted: fingerprint, estimate, public_score.
    """
    spark, sign = candidates.sparkSession, -1.0 if direction == "minimize" else 1.0

    def verdict(spend: bool, reason: str, name: str | None, tau: float | None) -> DataFrame:
        return spark.createDataFrame([(spend, reason, name, tau)], "spend boolean, reason string, name string, tau double")

    paired = submitted.filter(F.col("estimate").isNotNull() & F.col("public_score").isNotNull())
    agreed = kendall_tau_b(
        paired.select((sign * F.col("estimate")).alias("l"), (sign * F.col("public_score")).alias("r")), "l", "r"
    ).first() if not paired.isEmpty() else None
    points, tau = (agreed["n"], agreed["tau_b"]) if agreed else (0, None)
    if remaining <= 0:
        return verdict(False, "allowance_spent", None, tau)
    if candidates.isEmpty():
        return verdict(False, "no_candidates", None, tau)
    available = candidates.join(submitted.select("fingerprint").distinct(), "fingerprint", "left_anti")
    rank = F.struct((sign * F.col("estimate")).alias("e"), F.col("name"))
    best = available.agg(F.max_by(F.struct("name", "estimate", "noise"), rank).alias("b")).first()["b"]
    if best is None:
        return verdict(False, "all_submitted", None, tau)
    known = submitted.filter(F.col("estimate").isNotNull())
    top = known.agg(F.max(sign * F.col("estimate"))).first()[0]
    if top is None:
        return verdict(True, "first_point", best["name"], tau)

    def farthest() -> Row:
        order = F.struct("distance", (sign * F.col("estimate")).alias("e"), "name")
        spread = nearest_distance(available.select("name", "estimate"), known, "estimate")
        return spread.agg(F.max_by(F.struct("name", "distance"), order).alias("b")).first()["b"]

    if points < minimum_points:
        return verdict(True, "calibrating", farthest()["name"], tau)
    threshold = noise_multiplier * best["noise"]
    if tau is not None and tau >= agreement:
        if sign * best["estimate"] - top > threshold:
            return verdict(True, "ranking_transfers", best["name"], tau)
        return verdict(False, "within_noise", None, tau)
    distant = farthest()
    if distant["distance"] <= threshold:
        return verdict(False, "nothing_constrains", None, tau)
    return verdict(True, "constrains_relationship", distant["name"], tau)


def falsification_targets(hypotheses: DataFrame, run: str) -> DataFrame:
    """The most urgent falsifiable hypothesis per run, the larger id on ties (TOP10).

    Columns read: id, confidence, consequence, requirements (array), predictions_if_false (array).
    """
    table = F.create_map(*[F.lit(x) for pair in DECISION_IMPACT.items() for x in pair])
    confidence = F.col("confidence")
    testable = F.least(F.lit(1.0), 0.25 * F.size("requirements") + 0.25 * F.size("predictions_if_false"))
    priority = (
        confidence * F.try_element_at(table, F.col("consequence"))
        * F.greatest(F.lit(0.1), 2 * F.abs(confidence - 0.5)) * testable
    )
    eligible = (F.size("requirements") > 0) & (F.size("predictions_if_false") > 0) & (confidence >= 0.5)
    scored = hypotheses.filter(eligible).withColumn("priority", priority)
    return scored.groupBy(run).agg(F.max_by(F.struct("id", "priority"), F.struct("priority", "id")).alias("b")).select(
        run, "b.id", "b.priority"
    )


def _end_of_chains(pointers: DataFrame, folder: str) -> DataFrame:
    """Pointers (node, depends_on, weight, floor) moved to the end of their chain by doubling, kept in `folder`.

    A pointer states level = max(floor, level of depends_on + weight); two of them in a row compose to one. The
    round count is the logarithm of the longest chain; pointers that still move after as many doublings as the
    table can need form a cycle.
    """
    limit = pointers.count().bit_length() + 1
    for number in range(limit):
        further = pointers.select(
            F.col("node").alias("depends_on"), F.col("depends_on").alias("_next"), F.col("weight").alias("_weight"), F.col("floor").alias("_floor")
        )
        joined = pointers.join(further.hint("merge"), "depends_on", "left")
        moved = stored(joined.select(
            "node", F.coalesce("_next", "depends_on").alias("depends_on"), (F.col("weight") + F.coalesce("_weight", F.lit(0))).alias("weight"),
            F.greatest("floor", F.col("_floor") + F.col("weight")).alias("floor"), F.col("_next").isNotNull().alias("moved"),
        ), f"{folder}/{number}")
        if number:
            remove(pointers.sparkSession, f"{folder}/{number - 1}")
        pointers = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return pointers
    raise ContractError("the dependency graph has a cycle")


def dependency_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Topological level of every node of `depends_on` edges (JOI21).

    A round places the nodes that wait for nothing. Rounds 0, 1, 3, 7 and so on also contract all chains: a node that
    waits for one other is replaced by a weighted edge to the end of its chain, found by pointer doubling. So a
    chain takes a logarithmic number of joins, and only nodes that wait for two or more ends cost rounds of their own.
    Contracted nodes get their levels from their ends, latest first. All joins sort: dozens of small broadcasts would
    gather in the driver, each a hash table of a round's nodes. Every table is written to the shared folder,
    the levels and the contracted nodes each to one table with a folder per round; a round's other tables go when the
    next round has its own. Nothing to place means a cycle.
    """
    spark = nodes.sparkSession
    kind = nodes.select("node").schema["node"].dataType.simpleString()
    placed, held, work = scratch_path(spark, "levels"), scratch_path(spark, "contracted"), scratch_path(spark, "rounds")
    levels = lambda: spark.read.schema(f"node {kind}, level long").option("recursiveFileLookup", "true").parquet(placed)
    waiting = nodes.select("node", F.lit(0).cast("long").alias("floor")).distinct()
    links = edges.select("node", "depends_on").distinct().join(waiting.select("node").hint("merge"), "node", "left_semi")
    links = cut_lineage(links.withColumn("weight", F.lit(1).cast("long")))
    if not links.join(waiting.withColumnRenamed("node", "depends_on").hint("merge"), "depends_on", "left_anti").isEmpty():
        raise ContractError("a dependency is not a node")
    waits = links.groupBy("node").agg(F.count(F.lit(1)).alias("waits"))
    waiting = cut_lineage(waiting.join(waits.hint("merge"), "node", "left").fillna(0, ["waits"]))
    if waiting.isEmpty():
        return waiting.select("node", F.col("floor").alias("level"))
    contracted = 0
    for number in itertools.count():
        ready = waiting.filter("waits = 0").select("node", F.col("floor").alias("level"))
        if ready.isEmpty():
            raise ContractError("the dependency graph has a cycle")
        ready.write.parquet(f"{placed}/{number}")
        waiting = waiting.filter("waits > 0")
        if waiting.isEmpty():
            break
        # Edges to what is placed become floors.
        reached = links.join(ready.withColumnRenamed("node", "depends_on").hint("merge"), "depends_on", "left")
        reached = stored(reached.withColumn("least", F.col("level") + F.col("weight")), f"{work}/{number}/reached")
        floors = reached.groupBy("node").agg(F.max("least").alias("least"), F.count_if(F.col("least").isNull()).alias("waits"))
        waiting = waiting.drop("waits").join(floors.hint("merge"), "node").select("node", F.greatest("floor", "least").alias("floor"), "waits")
        waiting = stored(waiting, f"{work}/{number}/waiting")
        links = reached.filter(F.col("least").isNull()).select("node", "depends_on", "weight")
        if number:
            remove(spark, f"{work}/{number - 1}")
        single = waiting.filter("waits = 1").select("node", "floor")
        if number & (number + 1) or single.isEmpty():
            continue
        ends = _end_of_chains(links.join(single.hint("merge"), "node").select("node", "depends_on", "weight", "floor"), f"{work}/{number}/chains")
        ends.write.parquet(f"{held}/{contracted}")
        contracted += 1
        via = ends.select(F.col("node").alias("depends_on"), F.col("depends_on").alias("_end"), F.col("weight").alias("_weight"), F.col("floor").alias("_floor"))
        others = links.join(single.hint("merge"), "node", "left_anti").join(via.hint("merge"), "depends_on", "left").select(
            "node", F.coalesce("_end", "depends_on").alias("depends_on"), (F.col("weight") + F.coalesce("_weight", F.lit(0))).alias("weight"),
            (F.col("_floor") + F.col("weight")).alias("least"),
        )
        links = stored(others.groupBy("node", "depends_on").agg(F.max("weight").alias("weight"), F.max("least").alias("least")), f"{work}/{number}/links")
        floors = links.groupBy("node").agg(F.max("least").alias("least"), F.count(F.lit(1)).alias("waits"))
        waiting = waiting.filter("waits <> 1").drop("waits").join(floors.hint("merge"), "node", "left")
        waiting = waiting.select("node", F.greatest("floor", "least").alias("floor"), F.coalesce("waits", F.lit(0)).alias("waits"))
        waiting = stored(waiting, f"{work}/{number}/left")
        links = links.drop("least")
    remove(spark, work)
    for number in reversed(range(contracted)):
        ends = spark.read.parquet(f"{held}/{number}")
        known = ends.join(levels().withColumnRenamed("node", "depends_on").hint("merge"), "depends_on")
        known.select("node", F.greatest("floor", F.col("level") + F.col("weight")).alias("level")).write.parquet(f"{placed}/end-{number}")
    return levels()
