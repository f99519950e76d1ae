"""Rates, weighted scores, posteriors and small-model tables built by grouped aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.operators.audit import Audited
from foldwright.operators.ordering import prefix_by_key

# Fidelity weights, shrinkage strength, alarm budget, cell slots and reliability targets.
FIDELITY_WEIGHTS = {"rank": 0.35, "pseudo_future": 0.35, "variance": 0.15, "leakage": 0.15}
SHRINKAGE_STRENGTH = 5
ALARM_BUDGET = 2
CELL_SLOTS = 4
DERIVED_METRIC_NAMES = ("composite", "combined", "combined_score", "score", "total", "weighted")
CLASSES = (-1, 0, 1)
LOG_LOSS_FLOOR = 1e-12


def rate(flag: Column) -> Column:
    """Share of rows with a true flag; null flags count as false."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def rate_where(flag: Column, condition: Column) -> Column:
    """Share of true flags among the rows of a condition; null when it selects none."""
    return F.avg(F.when(condition, F.coalesce(flag, F.lit(False)).cast("double")))


def score_violations(scores: DataFrame) -> DataFrame:
    """Task scores that name a composite, hold no metric, or are not finite (SRC4)."""
    bad_number = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    problem = (
        F.when(F.size("metrics") == 0, "empty")
        .when(F.exists(F.map_keys("metrics"), lambda k: F.lower(k).isin(*DERIVED_METRIC_NAMES)), "composite_name")
        .when(F.exists(F.map_values("metrics"), bad_number), "not_finite")
    )
    return scores.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def per_task_composite(
    scores: DataFrame,
    weights: Mapping[str, float],
    gate: tuple[str, float, Sequence[str]] | None = None,
) -> Audited:
    """Weighted sum of raw metrics per task (AGG19).

    `gate` is (metric, minimum, kept metrics): below the minimum only the kept metrics count. Rows
    without a required metric are violations, never zeros.
    """
    required = sorted({*weights, *([gate[0]] if gate else [])})
    metric = lambda n: F.try_element_at(F.col("metrics"), F.lit(n))
    total = sum((F.lit(float(w)) * metric(n) for n, w in weights.items()), F.lit(0.0))
    if gate:
        kept = sum((F.lit(float(weights[n])) * metric(n) for n in gate[2] if n in weights), F.lit(0.0))
        total = F.when(metric(gate[0]) >= gate[1], total).otherwise(kept)
    missing = F.array_compact(F.array(*[F.when(metric(n).isNull(), F.lit(n)) for n in required]))
    marked = scores.withColumn("missing", missing)
    return Audited(
        marked.filter(F.size("missing") == 0).withColumn("composite", total).drop("missing"),
        marked.filter(F.size("missing") > 0).select("candidate_id", "task_id", "missing"),
    )


def composite_scores(composites: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """Mean composite per candidate over all its tasks or a given task list (AGG19)."""
    rows = composites.join(tasks.select("task_id").distinct(), "task_id", "left_semi") if tasks is not None else composites
    return rows.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("tasks"), F.avg("composite").alias("composite"))


def metric_vectors(scores: DataFrame, metric: str) -> DataFrame:
    """One raw metric per (candidate, task), rows without it left out (AGG20)."""
    value = F.try_element_at(F.col("metrics"), F.lit(metric))
    return scores.select("candidate_id", "task_id", value.alias("value")).filter(F.col("value").isNotNull())


def world_posterior(worlds: DataFrame, evidence: DataFrame) -> Audited:
    """Posterior over active worlds from likelihoods tempered by reliability (AGG21).

    Evidence multiplies, so its order does not matter: sums of logs per world, then a normaliser per
    run. Violations are evidence rows that miss an active world or name an inactive one.
    """
    active = worlds.filter("active")
    per_world = evidence.groupBy("run_id", "world_id").agg(
        F.sum(F.col("reliability") * F.log("likelihood")).alias("_ll"), F.count(F.lit(1)).alias("updates")
    )
    logs = active.join(per_world, ["run_id", "world_id"], "left").withColumn(
        "_lp", F.log("prior") + F.coalesce("_ll", F.lit(0.0))
    )
    top = logs.groupBy("run_id").agg(F.max("_lp").alias("_top"))
    scaled = logs.join(top, "run_id").withColumn("_w", F.exp(F.col("_lp") - F.col("_top")))
    mass = scaled.groupBy("run_id").agg(F.sum("_w").alias("_mass"))
    posterior = scaled.join(mass, "run_id").select(
        "run_id", "world_id", "prior", F.coalesce("updates", F.lit(0)).alias("updates"),
        (F.col("_w") / F.col("_mass")).alias("posterior"),
    )
    asked = evidence.select("run_id", "evidence_id").distinct().join(active.select("run_id", "world_id"), "run_id")
    given = evidence.select("run_id", "evidence_id", "world_id")
    keys = ["run_id", "evidence_id", "world_id"]
    missing = asked.join(given, keys, "left_anti").select(*keys, F.lit("missing").alias("problem"))
    extra = given.join(asked, keys, "left_anti").select(*keys, F.lit("extra").alias("problem"))
    return Audited(posterior, missing.unionByName(extra))


def posterior_entropy(df: DataFrame, probability: str, keys: Sequence[str]) -> DataFrame:
    """Entropy in bits and as a share of log2(k) per group (AGG22).

    H = log2(S) - sum(p log2 p)/S for unnormalised p with sum S: one aggregate, no window.
    """
    p = F.col(probability)
    total = F.sum(p)
    bits = F.log2(total) - F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0)) / total
    made = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("worlds"), bits.alias("bits"))
    return made.withColumn(
        "normalised", F.when(F.col("worlds") > 1, F.col("bits") / F.log2("worlds")).otherwise(F.col("bits"))
    )


def validation_fidelity(rank_stability: Column, pseudo_future: Column, variance: Column, leakage: Column) -> Column:
    """Weighted mean of the observed diagnostics, weights renormalised, null when none (AGG23)."""
    parts = [
        (FIDELITY_WEIGHTS["rank"], (rank_stability + 1) / 2),
        (FIDELITY_WEIGHTS["pseudo_future"], pseudo_future),
        (FIDELITY_WEIGHTS["variance"], 1 / (1 + variance)),
        (FIDELITY_WEIGHTS["leakage"], 1 - leakage),
    ]
    weight = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for w, v in parts), F.lit(0.0))
    value = sum((F.coalesce(w * v, F.lit(0.0)) for w, v in parts), F.lit(0.0))
    return F.when(weight > 0, value / weight)


def expected_score(df: DataFrame, probability: str, score: str, keys: Sequence[str]) -> DataFrame:
    """Posterior-weighted mean score per group (AGG23)."""
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col(probability) * F.col(score)), F.sum(probability)).alias("expected_score")
    )


def reliability_rates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Completion, invalid, resource, OOF and reproduction rates with the target flag (AGG24).

    Columns read: terminal_status, is_candidate, has_oof, reproduction_passed (null when not tried).
    """
    status, tried = F.col("terminal_status"), F.col("reproduction_passed").isNotNull()
    passed = (status == "completed") & (F.col("reproduction_passed") >= 1)
    made = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        rate(status == "completed").alias("completion"),
        rate(status == "invalid_artifact").alias("invalid_artifact"),
        rate(status == "failed_resource").alias("resource_failure"),
        F.coalesce(rate_where(F.col("has_oof"), F.col("is_candidate")), F.lit(0.0)).alias("oof_generation"),
        F.coalesce(F.try_divide(F.count_if(passed), F.count_if(tried)), F.lit(0.0)).alias("reproduction"),
    )
    target = (
        (F.col("completion") >= 0.90)
        & (F.col("invalid_artifact") <= 0.05)
        & (F.col("resource_failure") <= 0.05)
        & (F.col("oof_generation") >= 0.90)
        & (F.col("reproduction") >= 0.90)
    )
    return made.withColumn("target_met", target)


def runtime_ratio(observed: DataFrame, declared: DataFrame, run: str) -> DataFrame:
    """Observed against declared wall hours, retries included (AGG33)."""
    wall = F.coalesce(F.col("wall_hours"), F.coalesce("wall_seconds", F.lit(0.0)) / 3600)
    seen = observed.groupBy(run).agg(
        F.count_if(~F.col("is_retry")).alias("observed"),
        F.count_if("is_retry").alias("retries"),
        F.round(F.sum(wall), 4).alias("wall_hours"),
        F.round(F.sum(F.coalesce("cpu_hours", F.lit(0.0))), 4).alias("cpu_hours"),
        F.sum(wall).alias("_wall"),
    )
    promised = declared.groupBy(run).agg(F.sum("estimated_wall_hours").alias("_est"))
    joined = seen.join(promised, run, "left")
    ratio = F.when(F.coalesce("_est", F.lit(0.0)) != 0, F.round(F.col("_wall") / F.col("_est"), 2)).otherwise(0.0)
    return joined.select(
        run, "observed", "retries", "wall_hours", "cpu_hours",
        F.round(F.coalesce("_est", F.lit(0.0)), 4).alias("estimated_wall_hours"), ratio.alias("estimate_ratio"),
    )


def validation_fingerprint(split: Column, metrics: Column) -> Column:
    """Identity of a validation scheme: normalised split text and sorted metric names (AGG34)."""
    normalised = F.lower(F.trim(F.regexp_replace(split, r"\s+", " ")))
    names = F.array_join(F.array_sort(F.transform(metrics, F.lower)), "|")
    return F.sha2(F.concat(normalised, F.lit("|"), names), 256)


def validation_reuse(df: DataFrame, budget: int) -> DataFrame:
    """Selecting queries spent per validation scheme and whether one more would exceed the budget (AGG34).

    Columns read: fingerprint, settled, selecting.
    """
    used = df.groupBy("fingerprint").agg(F.count_if(F.col("settled") & F.col("selecting")).alias("used"))
    return used.withColumn("exhausted", F.lit(budget > 0) & (F.col("used") >= budget))


def token_efficiency(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tokens per completed experiment, valid candidate, new family and unit of gain (AGG35)."""
    spent = F.sum("tokens").cast("double")
    gain = F.sum(F.greatest(F.col("gain"), F.lit(0.0)))
    return df.groupBy(*keys).agg(
        F.sum("tokens").alias("tokens"),
        F.try_divide(spent, F.count_if("completed")).alias("per_completed"),
        F.try_divide(spent, F.count_if("valid_candidate")).alias("per_valid_candidate"),
        F.try_divide(spent, F.count_distinct("family")).alias("per_family"),
        F.when(gain > 0, spent / gain).alias("per_gain"),
    )


def stable_groups(df: DataFrame, run: str, group: str, completed: Column, minimum: int = 2) -> DataFrame:
    """Groups per run with at least `minimum` completed members (AGG36)."""
    counts = df.groupBy(run, group).agg(F.count_if(completed).alias("_n"))
    return counts.groupBy(run).agg(F.count_if(F.col("_n") >= minimum).alias("stable_groups"))


def widest_spread(metrics: str) -> Column:
    """Largest max-min over the arrays of a metric map; arrays with fewer than two numbers count 0 (AGG37)."""
    spread = lambda a: F.when(F.size(a) >= 2, F.array_max(a) - F.array_min(a)).otherwise(0.0)
    return F.coalesce(F.array_max(F.transform(F.map_values(metrics), spread)), F.lit(0.0))


def _class_counts(label: str) -> list[Column]:
    return [F.count_if(F.col(label) == v).alias(f"_n{i}") for i, v in enumerate(CLASSES)]


def _argmax_class(columns: Sequence[str]) -> Column:
    """Class with the largest value; the earlier class wins a tie."""
    best = F.greatest(*columns)
    choice = F.lit(CLASSES[-1])
    for value, name in reversed(list(zip(CLASSES, columns))):
        choice = F.when(F.col(name) == best, F.lit(value)).otherwise(choice)
    return choice


def _shrunk(prefix: str) -> dict[str, Column]:
    """Laplace global prior and the cell distribution shrunk toward it, from count columns."""
    made = {}
    all_total = sum((F.col(f"_g{i}") for i in range(3)), F.lit(0))
    cell_total = sum((F.col(f"_n{i}") for i in range(3)), F.lit(0))
    for i in range(3):
        made[f"{prefix}prior{i}"] = (F.col(f"_g{i}") + 1) / (all_total + 3)
    for i in range(3):
        prior = (F.col(f"_g{i}") + 1) / (all_total + 3)
        made[f"{prefix}cell{i}"] = (F.col(f"_n{i}") + SHRINKAGE_STRENGTH * prior) / (cell_total + SHRINKAGE_STRENGTH)
    return made


def context_shrinkage_model(df: DataFrame, state: str, cell: Sequence[str], label: str) -> DataFrame:
    """Class distribution per (state, cell) shrunk to a Laplace prior, and the predicted class (AGG41)."""
    cells = df.groupBy(state, *cell).agg(*_class_counts(label))
    overall = cells.groupBy(state).agg(*[F.sum(f"_n{i}").alias(f"_g{i}") for i in range(3)])
    model = cells.join(overall, state).withColumns(_shrunk(""))
    return model.select(
        state, *cell, F.col("cell0").alias("p_minus"), F.col("cell1").alias("p_zero"), F.col("cell2").alias("p_plus"),
        _argmax_class(["cell0", "cell1", "cell2"]).alias("predicted"),
        _argmax_class(["prior0", "prior1", "prior2"]).alias("checklist"),
    )


def _complement(df: DataFrame, domain: str, state: str, cell: Sequence[str], label: str) -> DataFrame:
    """Class counts of all other domains, per (domain, state, cell): total minus own, no refits."""
    own = df.groupBy(domain, state, *cell).agg(*_class_counts(label))
    cell_all = own.groupBy(state, *cell).agg(*[F.sum(f"_n{i}").alias(f"_a{i}") for i in range(3)])
    state_own = own.groupBy(domain, state).agg(*[F.sum(f"_n{i}").alias(f"_so{i}") for i in range(3)])
    state_all = own.groupBy(state).agg(*[F.sum(f"_n{i}").alias(f"_sa{i}") for i in range(3)])
    joined = own.join(cell_all, [state, *cell]).join(state_own, [domain, state]).join(state_all, state)
    return joined.withColumns(
        {
            **{f"_own{i}": F.col(f"_n{i}") for i in range(3)},
            **{f"_g{i}": F.col(f"_sa{i}") - F.col(f"_so{i}") for i in range(3)},
        }
    ).withColumns({f"_n{i}": F.col(f"_a{i}") - F.col(f"_own{i}") for i in range(3)})


def leave_one_domain_out(df: DataFrame, domain: str, state: str, cell: Sequence[str], label: str) -> DataFrame:
    """Accuracy and log loss of the cell model and the plain prior on held-out domains (AGG42)."""
    scored = _complement(df, domain, state, cell, label).withColumns(_shrunk("_"))
    # A cell the other domains never saw has zero counts, so its shrunk distribution is the prior.
    scored = scored.withColumns(
        {
            "_pick": _argmax_class(["_cell0", "_cell1", "_cell2"]),
            "_list": _argmax_class(["_prior0", "_prior1", "_prior2"]),
        }
    )
    n = sum((F.col(f"_own{i}") for i in range(3)), F.lit(0))
    hits = lambda c: sum((F.when(F.col(c) == v, F.col(f"_own{i}")).otherwise(0) for i, v in enumerate(CLASSES)), F.lit(0))
    loss = lambda p: -sum((F.col(f"_own{i}") * F.log(F.greatest(F.col(f"{p}{i}"), F.lit(LOG_LOSS_FLOOR))) for i in range(3)), F.lit(0.0))
    return scored.groupBy(domain).agg(
        F.sum(n).alias("n"),
        (F.sum(hits("_pick")) / F.sum(n)).alias("context_accuracy"),
        (F.sum(hits("_list")) / F.sum(n)).alias("checklist_accuracy"),
        (F.sum(loss("_cell")) / F.sum(n)).alias("context_log_loss"),
        (F.sum(loss("_prior")) / F.sum(n)).alias("checklist_log_loss"),
    )


def two_part_model(df: DataFrame, state: str, cell: Sequence[str], label: str) -> DataFrame:
    """P(mentioned) and P(minus given mentioned) per cell, both shrunk (AGG43)."""
    cells = df.groupBy(state, *cell).agg(*_class_counts(label))
    overall = cells.groupBy(state).agg(*[F.sum(f"_n{i}").alias(f"_g{i}") for i in range(3)])
    said, total = F.col("_n0") + F.col("_n2"), F.col("_n0") + F.col("_n1") + F.col("_n2")
    g_said, g_total = F.col("_g0") + F.col("_g2"), F.col("_g0") + F.col("_g1") + F.col("_g2")
    g_mentioned, g_minus = (g_said + 1) / (g_total + 2), (F.col("_g0") + 1) / (g_said + 2)
    k = SHRINKAGE_STRENGTH
    mentioned = (said + k * g_mentioned) / (total + k)
    minus = (F.col("_n0") + k * g_minus) / (said + k)
    return cells.join(overall, state).select(
        state, *cell, total.alias("n"), F.col("_n0").alias("true_minus"),
        mentioned.alias("p_mentioned"), minus.alias("p_minus"), (mentioned * minus).alias("alarm_score"),
    )


def alarm_threshold(model: DataFrame) -> DataFrame:
    """Smallest alarm score whose rows fit in twice the true minus count, whole tie blocks only (AGG43).

    Infinite when no score fits or no minus exists; zero when the budget covers every row.
    """
    blocks = model.groupBy("alarm_score").agg(F.sum("n").alias("_n"), F.sum("true_minus").alias("_m"))
    falling = blocks.withColumn("_key", -F.col("alarm_score"))
    placed = prefix_by_key(falling, [], ["_key"], {"_before": F.col("_n")})
    budget = placed.agg(F.sum("_m").alias("_minus"), F.sum("_n").alias("_rows")).withColumn("_k", F.lit(1))
    fits = placed.withColumn("_k", F.lit(1)).join(F.broadcast(budget), "_k")
    limit = F.max(ALARM_BUDGET * F.col("_minus"))
    lowest = F.min(
        F.when(F.col("_before") + F.col("_n") <= ALARM_BUDGET * F.col("_minus"), F.col("alarm_score"))
    )
    value = (
        F.when(F.max("_minus") == 0, F.lit(float("inf")))
        .when(limit >= F.max("_rows"), F.lit(0.0))
        .otherwise(F.coalesce(lowest, F.lit(float("inf"))))
    )
    return fits.agg(F.max("_minus").alias("true_minus"), value.alias("threshold"))


def class_promotion(
    df: DataFrame, key: str, minimum_problem_classes: int = 2, minimum_competitions: int = 2, minimum_models: int = 2
) -> DataFrame:
    """Which technique classes are promoted; only direct observations count (AGG44).

    The model bar applies only when every direct row names a model.
    """
    direct = F.col("strength") == "direct"
    made = df.groupBy(key).agg(
        F.count_if(direct).alias("direct"),
        F.count_if(~direct).alias("arguable"),
        F.count_distinct(F.when(direct, F.col("problem_class"))).alias("problem_classes"),
        F.count_distinct(F.when(direct, F.col("competition"))).alias("competitions"),
        F.count_distinct(F.when(direct, F.col("agent_model"))).alias("models"),
        F.count_if(direct & F.col("agent_model").isNotNull()).alias("_named"),
        F.max("previous_status").alias("_previous"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("problem_classes") < minimum_problem_classes, "problem_classes"),
            F.when(F.col("competitions") < minimum_competitions, "competitions"),
            F.when(
                (F.col("direct") > 0) & (F.col("_named") == F.col("direct")) & (F.col("models") < minimum_models),
                "models",
            ),
        )
    )
    made = made.withColumn("reasons", reasons).withColumn(
        "status", F.when(F.size("reasons") == 0, "promoted").otherwise("candidate")
    )
    return made.withColumn(
        "demoted", (F.col("_previous") == "promoted") & (F.col("status") != "promoted")
    ).drop("_named", "_previous")


def overlap_classification(df: DataFrame, cluster: str) -> DataFrame:
    """Unique, independent replication or redundant duplication per cluster (AGG45)."""
    dimensions = ("model", "observable", "data_slice", "falsification_path")
    made = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("experiments"),
        F.count_distinct("agent").alias("agents"),
        F.count_distinct(F.struct("claim", "operation", "downstream_decision")).alias("_cores"),
        F.bool_and(F.col("preregistered") & ~F.col("source_seen")).alias("_clean"),
        *[F.count_distinct(d).alias(f"_d_{d}") for d in dimensions],
    )
    varying = F.array_compact(F.array(*[F.when(F.col(f"_d_{d}") > 1, F.lit(d)) for d in dimensions]))
    independent = (F.col("_cores") == 1) & (F.col("agents") >= 2) & F.col("_clean") & (F.size(varying) > 0)
    label = (
        F.when(F.col("experiments") == 1, "unique")
        .when(independent, "independent_replication")
        .otherwise("redundant_duplication")
    )
    return made.select(
        cluster, "experiments", "agents",
        F.when(F.col("experiments") > 1, varying).otherwise(F.array().cast("array<string>")).alias("varying"),
        label.alias("classification"),
    )


def cell_census(df: DataFrame, descriptors: Sequence[str]) -> DataFrame:
    """Occupancy per descriptor cell and the room left in it (AGG46)."""
    counts = df.groupBy(*descriptors).agg(F.count(F.lit(1)).alias("occupancy"))
    room = 1 - F.least(F.col("occupancy"), F.lit(CELL_SLOTS)) / F.lit(float(CELL_SLOTS))
    return counts.withColumn("contribution", room)


def cell_contribution(proposals: DataFrame, census: DataFrame, descriptors: Sequence[str]) -> DataFrame:
    """Room left for each proposal; a new cell gives 1, a proposal without descriptors null (AGG46)."""
    known = proposals.join(census.drop("occupancy"), list(descriptors), "left")
    stated = F.lit(True)
    for d in descriptors:
        stated = stated & F.col(d).isNotNull()
    return known.withColumn("contribution", F.when(stated, F.coalesce("contribution", F.lit(1.0))))


def posterior_weighted_metric(observations: DataFrame, worlds: DataFrame, metric: str) -> DataFrame:
    """Posterior-weighted `metric@world` entries when every world has one, else the plain metric (AGG60).

    Each observation explodes its own few metric entries; worlds are a small dimension per run.
    """
    entries = observations.select(
        "run_id", "observation_id", F.explode(F.map_entries("metrics")).alias("_e")
    ).select("run_id", "observation_id", F.col("_e.key").alias("_key"), F.col("_e.value").alias("_value"))
    parsed = entries.select(
        "run_id", "observation_id",
        F.regexp_extract("_key", r"^(.*?)[@:]", 1).alias("_metric"),
        F.regexp_extract("_key", r"[@:](.*)$", 1).alias("world_id"),
        F.when(F.col("_key").contains("@"), 0).otherwise(1).alias("_form"),
        "_value",
    ).filter(F.col("_metric") == metric)
    chosen = parsed.groupBy("run_id", "observation_id", "world_id").agg(F.min_by("_value", "_form").alias("_value"))
    sizes = worlds.groupBy("run_id").agg(F.count(F.lit(1)).alias("_worlds"))
    weighted = chosen.join(worlds.select("run_id", "world_id", "posterior"), ["run_id", "world_id"]).groupBy(
        "run_id", "observation_id"
    ).agg(
        F.count(F.lit(1)).alias("_seen"),
        F.try_divide(F.sum(F.col("posterior") * F.col("_value")), F.sum("posterior")).alias("_mean"),
    )
    joined = observations.join(weighted, ["run_id", "observation_id"], "left").join(sizes, "run_id", "left")
    plain = F.try_element_at(F.col("metrics"), F.lit(metric))
    return joined.select(
        "run_id", "observation_id",
        F.when(F.col("_seen") == F.col("_worlds"), F.col("_mean")).otherwise(plain).alias("value"),
    )


def forecast_records(forecasts: DataFrame, results: DataFrame) -> DataFrame:
    """Label probabilities, observed label and interval hits of settled forecasts (AGG61).

    forecasts: experiment_id, agent, category, prior, outcomes array<struct<label,p_true,p_false>>,
    intervals array<struct<metric,level,low,high>>. results: experiment_id, status, failed,
    observed_label, metrics map.
    """
    settled = results.filter((F.col("status") == "completed") & ~F.col("failed") & F.col("observed_label").isNotNull())
    mixed = lambda o: F.struct(
        o["label"], F.col("prior") * o["p_true"] + (1 - F.col("prior")) * o["p_false"]
    )
    hit = lambda i: F.struct(
        i["level"],
        (F.element_at("metrics", i["metric"]) >= i["low"]) & (F.element_at("metrics", i["metric"]) <= i["high"]),
    )
    reported = F.filter("intervals", lambda i: F.map_contains_key("metrics", i["metric"]))
    return forecasts.join(settled, "experiment_id").select(
        "experiment_id", "agent", "category",
        F.map_from_entries(F.transform("outcomes", mixed)).alias("probabilities"),
        "observed_label",
        F.map_from_entries(F.transform(reported, hit)).alias("coverage"),
    )
