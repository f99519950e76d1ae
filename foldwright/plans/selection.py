"""Queries for utilities, portfolios, elites and spend decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.operators import selection as K
from foldwright.plans.fixtures import rounded
from foldwright.plans.registry import query, r6

WEIGHTS = {"pragmatic": 1.0, "epistemic": 0.7, "robustness": 0.4, "diversity": 0.3, "structural_leverage": 0.2, "discrimination": 0.1, "validation_debt_reduction": 0.15}
KINDS = ("exploit", "ablation", "diagnostic", "ensemble", "optimization")

UTILITY = """raw AS (SELECT p_partkey AS id, p_brand AS lineage, ['exploit', 'ablation', 'diagnostic', 'ensemble', 'optimization'][p_partkey % 5 + 1] AS experiment_type, p_type AS decision,
      list_distinct(string_split(p_name, ' ')) AS hypotheses, [CAST(p_size % 4 AS VARCHAR)] AS metrics, p_size,
      (p_retailprice - 1000) / 100 - p_size % 7 / 10.0::DOUBLE - p_size % 5 / 10.0::DOUBLE - p_size % 3 / 10.0::DOUBLE - 0.5 * (p_size % 11) / 10.0::DOUBLE AS gain,
      least(1, greatest(0, (p_size / 10.0::DOUBLE + (p_size % 4) / 5.0::DOUBLE + (p_size % 9) / 10.0::DOUBLE + p_partkey * 10 / 100000.0::DOUBLE + (p_size % 13) / 25.0::DOUBLE) / 5)) AS cost,
      least(1, (p_size % 6) / 10.0::DOUBLE + CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.5 ELSE 1 END) AS risk FROM part),
    top AS (SELECT decision, max(abs(gain)) AS top, count(*) AS n FROM raw GROUP BY decision),
    util AS (SELECT raw.*, CASE WHEN n > 1 THEN CASE WHEN top = 0 THEN 0 ELSE gain / top END ELSE gain END * 1.0 + 0.7 * (p_size % 8) / 8.0::DOUBLE + 0.4 * (p_size % 10) / 10.0::DOUBLE + 0.3 * (p_size % 12) / 12.0::DOUBLE
      + 0.2 * (p_size % 3) / 3.0::DOUBLE + 0.1 * (p_size % 2) + 0.15 * (p_size % 5) / 5.0::DOUBLE - 0.15 * cost - 0.5 * risk AS utility FROM raw JOIN top USING (decision))"""


def _utilities(t):
    size, key = F.col("p_size"), F.col("p_partkey")
    part = lambda m, d=None: (size % m) / float(d or m)
    rows = t.part.select(
        key.alias("id"), F.col("p_brand").alias("lineage"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), (key % 5 + 1).cast("int")).alias("experiment_type"),
        F.col("p_type").alias("decision"), F.array_distinct(F.split("p_name", " ")).alias("hypotheses"), F.array((size % 4).cast("string")).alias("metrics"),
        ((F.col("p_retailprice") - 1000) / 100).alias("mean_gain"), part(7, 10).alias("fold_std"), part(5, 10).alias("seed_std"), part(3, 10).alias("worst_group_gap"), part(11, 10).alias("uncertainty"),
        size.cast("double").alias("cpu_hours"), (size % 4).cast("double").alias("gpu_hours"), (size % 9).cast("double").alias("wall_hours"), (key * 10).alias("llm_tokens"), (size % 13).cast("double").alias("monetary_cost"),
        part(6, 10).alias("failure_probability"), ((key % 3) / 2.0).alias("contamination"), part(8).alias("epistemic"), part(10).alias("robustness"), part(12).alias("diversity"),
        part(3).alias("structural_leverage"), (size % 2).cast("double").alias("discrimination"), part(5).alias("validation_debt_reduction"),
    )
    return K.utility_scores(rows, ["decision"], WEIGHTS)


@query("top1_utility_score", f"WITH {UTILITY} SELECT id, {r6('cost')} AS cost, {r6('risk')} AS risk, {r6('utility')} AS utility FROM util")
def _(t):
    return _utilities(t).select("id", rounded("cost").alias("cost"), rounded("risk").alias("risk"), rounded("utility").alias("utility"))


SIM = """((CAST(p.lineage = c.lineage AS INT) + CAST(p.experiment_type = c.experiment_type AS INT) + len(list_intersect(p.hypotheses, c.hypotheses)) / CAST(len(list_distinct(p.hypotheses || c.hypotheses)) AS DOUBLE)
    + len(list_intersect(p.metrics, c.metrics)) / CAST(len(list_distinct(p.metrics || c.metrics)) AS DOUBLE)) / 4)"""


def greedy(size: int, allocation: dict[str, float] | None = None) -> str:
    """CTE chain of the greedy rounds; a round's bucket depends on the allocation alone."""
    bucket = "CASE WHEN experiment_type IN ('exploit', 'optimization') THEN 'exploit' WHEN experiment_type IN ('solution_explore', 'ensemble', 'ablation') THEN 'qd_explore' ELSE 'epistemic' END"
    ctes, counts = [f"s0 AS (SELECT *, {bucket} AS bucket, 0.0::DOUBLE AS sim FROM util)"], dict.fromkeys(allocation or (), 0)
    for i in range(size):
        keep = "true"
        if allocation:
            want = max(allocation, key=lambda b: (allocation[b] * (i + 1) - counts[b], b))
            counts[want] += 1
            keep = f"bucket = '{want}'"
        ctes.append(f"c{i} AS (SELECT *, utility - 0.25 * sim AS marginal FROM s{i} WHERE {keep} ORDER BY marginal DESC, id DESC LIMIT 1)")
        ctes.append(f"s{i + 1} AS (SELECT p.* EXCLUDE (sim), greatest(p.sim, {SIM}) AS sim FROM s{i} p, c{i} c WHERE p.id <> c.id)")
    picks = " UNION ALL ".join(f"SELECT id, {i + 1}::BIGINT AS position, marginal FROM c{i}" for i in range(size))
    return f"WITH {UTILITY}, {', '.join(ctes)} SELECT id, position, {r6('marginal')} AS marginal FROM ({picks})"


@query("top2_diversified_top_k", greedy(6))
def _(t):
    return K.diversified_top_k(_utilities(t), 6).withColumn("marginal", rounded("marginal"))


ALLOCATION = {"exploit": 0.5, "qd_explore": 0.2, "epistemic": 0.3}


@query("top2_allocated_portfolio", greedy(6, ALLOCATION))
def _(t):
    return K.diversified_top_k(_utilities(t), 6, allocation=ALLOCATION).withColumn("marginal", rounded("marginal"))


CANDIDATES = """cand AS (SELECT p_partkey AS id, p_type, p_brand, p_retailprice / 1000 AS score, p_size % 7 / 50.0::DOUBLE AS variance, p_size / 50.0::DOUBLE AS cost, p_partkey % 4 / 20.0::DOUBLE AS leakage,
    p_partkey * 37 % 101 / 101.0::DOUBLE AS robustness, p_partkey * 17 % 103 / 103.0::DOUBLE AS error_diversity FROM part)"""


def _candidates(t):
    size, key = F.col("p_size"), F.col("p_partkey")
    return t.part.select(
        key.alias("id"), "p_type", "p_brand", (F.col("p_retailprice") / 1000).alias("score"), (size % 7 / 50.0).alias("variance"), (size / 50.0).alias("cost"),
        (key % 4 / 20.0).alias("leakage"), (key * 37 % 101 / 101.0).alias("robustness"), (key * 17 % 103 / 103.0).alias("error_diversity"),
    )


@query(
    "top3_cell_elites",
    f"""WITH {CANDIDATES}, q AS (SELECT *, score - variance - 0.1 * cost - leakage AS quality FROM cand), n AS (SELECT *, quality >= max(quality) OVER w - abs(max(quality) OVER w) * (1 - 0.97::DOUBLE) AS near FROM q WINDOW w AS (PARTITION BY p_type, p_brand)),
      k AS (SELECT p_type, p_brand, id, near, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY quality DESC, id DESC) AS a, row_number() OVER (PARTITION BY p_type, p_brand, near ORDER BY cost, quality DESC, id DESC) AS b,
        row_number() OVER (PARTITION BY p_type, p_brand, near ORDER BY robustness DESC, quality DESC, id DESC) AS c, row_number() OVER (PARTITION BY p_type, p_brand, near ORDER BY error_diversity DESC, quality DESC, id DESC) AS d FROM n)
    SELECT p_type, p_brand, count(*) AS candidates, max(id) FILTER (a = 1) AS best_quality, max(id) FILTER (near AND b = 1) AS lowest_cost, max(id) FILTER (near AND c = 1) AS highest_robustness,
      max(id) FILTER (near AND d = 1) AS highest_error_diversity FROM k GROUP BY p_type, p_brand""",
)
def _(t):
    return K.cell_elites(_candidates(t), ["p_type", "p_brand"])


@query(
    "top4_final_candidate",
    f"""WITH {CANDIDATES}, u AS (SELECT id, score + 0.15 * robustness + 0.15 * error_diversity - variance - 0.1 * cost - leakage AS utility FROM cand)
    SELECT id, {r6("utility")} AS utility FROM u ORDER BY u.utility DESC, id DESC LIMIT 1""",
)
def _(t):
    return K.final_candidate(_candidates(t)).select("id", rounded("utility").alias("utility"))


FINAL_WEIGHTS = {"forward": 1.0, "robustness": 0.2, "new_entity": 0.3, "ensemble_gain": 0.5, "uncertainty": 0.25, "leakage": 1.0}


@query(
    "top5_shortlist_with_gates",
    f"""WITH {CANDIDATES} SELECT id, {r6('''1.0 * coalesce(CASE WHEN id % 3 = 0 THEN score + 0.01 END, score) + 0.2 * robustness + 0.3 * CASE WHEN id % 4 = 0 THEN 0.5 ELSE 0 END + 0.5 * error_diversity
      - 0.25 * variance - leakage''')} AS utility FROM cand WHERE id % 5 <> 0 AND id % 7 <> 0 AND id % 11 <> 0""",
)
def _(t):
    key = F.col("id")
    rows = _candidates(t).withColumns(
        {
            "forward_score": F.when(key % 3 == 0, F.col("score") + 0.01), "primary_score": F.col("score"), "new_entity_auc": F.when(key % 4 == 0, 0.5),
            "ensemble_gain": F.col("error_diversity"), "uncertainty": F.col("variance"), "leakage_passed": key % 5 != 0, "reproduced": key % 7 != 0, "has_oof": key % 11 != 0,
        }
    )
    return K.shortlist(rows, FINAL_WEIGHTS).select("id", rounded("utility").alias("utility"))


ENSEMBLES = f"""{CANDIDATES}, e AS (SELECT id, id % 5 = 0 AS ens, [id + 1, id + 2, id + 3] AS members, score + robustness / 10 AS auc, robustness AS worst, variance AS sd, id % 3 <> 0 AS single_ok, id % 2 = 0 AS ens_ok, id % 7 <> 0 AS past FROM cand),
    m AS (SELECT x.id, max(s.auc) AS best, bool_and(s.id IS NOT NULL) AS known FROM (SELECT id, unnest(members) AS member FROM e WHERE ens) x LEFT JOIN e s ON s.id = x.member AND NOT s.ens GROUP BY x.id),
    ok AS (SELECT e.* FROM e LEFT JOIN m USING (id) WHERE CASE WHEN ens THEN ens_ok AND past AND coalesce(known, false) AND auc > best ELSE single_ok END)"""


def _ensembles(t):
    key = F.col("id")
    rows = _candidates(t).select(
        "id", (key % 5 == 0).alias("is_ensemble"), F.array(key + 1, key + 2, key + 3).alias("members"), (F.col("score") + F.col("robustness") / 10).alias("auc"),
        F.col("robustness").alias("worst_horizon"), F.col("variance").alias("seed_std"), (key % 3 != 0).alias("standalone_eligible"), (key % 2 == 0).alias("ensemble_eligible"), (key % 7 != 0).alias("past_only"),
    )
    return K.ensemble_beats_members(rows)


@query("top6_ensemble_beats_members", f"WITH {ENSEMBLES} SELECT id, ens AS is_ensemble FROM ok")
def _(t):
    return _ensembles(t).select("id", "is_ensemble")


@query(
    "top6_final_selection",
    f"WITH {ENSEMBLES} SELECT id, {r6('auc')} AS auc, {r6('worst')} AS worst_horizon FROM ok ORDER BY ok.auc DESC, worst DESC, sd, id DESC LIMIT 1",
)
def _(t):
    return K.final_selection(_ensembles(t)).select("id", rounded("auc").alias("auc"), rounded("worst_horizon").alias("worst_horizon"))


@query(
    "top7_agent_elites",
    """WITH o AS (SELECT user_id AS agent, event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AS valid, value AS metric, event_id * 31 % 97 AS red, event_type = 'purchase' AS claim, value * (event_id % 9) AS lev FROM events)
    SELECT agent, arg_max(event_id, (metric, -event_id)) AS performance, arg_max(event_id, (red, -event_id)) AS information, arg_max(event_id, (lev, -event_id)) FILTER (claim) AS structural FROM o WHERE valid GROUP BY agent""",
)
def _(t):
    key, value = F.col("event_id"), F.col("value")
    rows = t.events.select(
        F.col("user_id").alias("agent"), key.alias("sequence"), key.alias("candidate"), ((key % 5 != 0) & (key % 7 != 0)).alias("valid"), value.alias("metric"),
        (key * 31 % 97).alias("reduction"), (F.col("event_type") == "purchase").alias("claim"), (value * (key % 9)).alias("leverage"),
    )
    return K.agent_elites(rows, "agent")


@query(
    "top8_local_novelty",
    f"""WITH d AS (SELECT p_brand AS agent, p_partkey AS seq, split_part(p_name, ' ', 1) AS d1, split_part(p_name, ' ', 2) AS d2, p_type AS d3, p_size % 5 AS d4, p_size % 2 AS d5 FROM part)
    SELECT a.seq, {r6("coalesce(min((CAST(a.d1 <> b.d1 AS INT) + CAST(a.d2 <> b.d2 AS INT) + CAST(a.d3 <> b.d3 AS INT) + CAST(a.d4 <> b.d4 AS INT) + CAST(a.d5 <> b.d5 AS INT)) / 5.0::DOUBLE), 1)")} AS novelty
    FROM d a LEFT JOIN d b ON a.agent = b.agent AND b.seq < a.seq GROUP BY a.seq""",
)
def _(t):
    words = F.split("p_name", " ")
    rows = t.part.select(
        F.col("p_brand").alias("agent"), F.col("p_partkey").alias("seq"), F.get(words, 0).alias("d1"), F.get(words, 1).alias("d2"), F.col("p_type").alias("d3"), (F.col("p_size") % 5).alias("d4"), (F.col("p_size") % 2).alias("d5")
    )
    return K.local_novelty(rows, "agent", "seq", ["d1", "d2", "d3", "d4", "d5"]).select("seq", rounded("novelty").alias("novelty"))


@query(
    "top9_nearest_distance",
    f"""SELECT a.o_orderkey, {r6("min(abs(a.o_totalprice - b.o_totalprice))")} AS distance FROM orders a, orders b WHERE a.o_orderkey % 50 <> 0 AND b.o_orderkey % 50 = 0 GROUP BY a.o_orderkey""",
)
def _(t):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    made = K.nearest_distance(orders.filter("o_orderkey % 50 <> 0"), orders.filter("o_orderkey % 50 = 0"), "o_totalprice")
    return made.select("o_orderkey", rounded("distance").alias("distance"))


@query(
    "top9_spend_decision",
    """WITH k AS (SELECT o_totalprice AS v FROM orders WHERE o_orderkey % 50 = 0), c AS (SELECT CAST(o_orderkey AS VARCHAR) AS name, o_totalprice, (SELECT min(abs(orders.o_totalprice - v)) FROM k) AS d FROM orders WHERE o_orderkey % 50 <> 0)
    SELECT true AS spend, 'constrains_relationship' AS reason, name FROM c ORDER BY d DESC, o_totalprice DESC, name DESC LIMIT 1""",
)
def _(t):
    orders, key, price = t.orders, F.col("o_orderkey"), F.col("o_totalprice")
    candidates = orders.filter(key % 50 != 0).select(key.cast("string").alias("name"), key.cast("string").alias("fingerprint"), price.alias("estimate"), F.lit(0.5).alias("noise"))
    submitted = orders.filter(key % 50 == 0).select(key.cast("string").alias("fingerprint"), price.alias("estimate"), (-price).alias("public_score"))
    return K.spend_decision(candidates, submitted, 2, "maximize").drop("tau")


@query(
    "top10_falsification_priority",
    f"""WITH h AS (SELECT o_custkey AS run, o_orderkey AS id, o_totalprice / 600000 AS c, ['low', 'medium', 'high', 'critical'][o_orderkey % 4 + 1] AS k, o_orderkey % 4 AS nr, o_orderkey % 3 AS np FROM orders),
      p AS (SELECT run, id, c * CASE k WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.75 ELSE 1 END * greatest(0.1, 2 * abs(c - 0.5)) * least(1, 0.25 * nr + 0.25 * np) AS pr FROM h WHERE nr > 0 AND np > 0 AND c >= 0.5)
    SELECT run, id, {r6("pr")} AS priority FROM p QUALIFY row_number() OVER (PARTITION BY run ORDER BY pr DESC, id DESC) = 1""",
)
def _(t):
    key = F.col("o_orderkey")
    levels = F.array(*[F.lit(v) for v in K.DECISION_IMPACT])
    rows = t.orders.select(
        F.col("o_custkey").alias("run"), key.alias("id"), (F.col("o_totalprice") / 600_000).alias("confidence"), F.element_at(levels, (key % 4 + 1).cast("int")).alias("consequence"),
        F.array_repeat(F.lit("r"), (key % 4).cast("int")).alias("requirements"), F.array_repeat(F.lit("p"), (key % 3).cast("int")).alias("predictions_if_false"),
    )
    return K.falsification_targets(rows, "run").select("run", "id", rounded("priority").alias("priority"))


@query(
    "joi21_dependency_order",
    """WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 2 AS dep FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0),
      w(node, level) AS (SELECT p_partkey, 0::BIGINT FROM part UNION SELECT e.node, w.level + 1 FROM w JOIN e ON e.dep = w.node)
    SELECT node, max(level) AS level FROM w GROUP BY node""",
)
def _(t):
    key = F.col("p_partkey")
    part = t.part.filter(key > 0)
    edges = part.select(key.alias("node"), F.floor(key / 2).alias("depends_on")).unionByName(part.select(key.alias("node"), F.floor(key / 3).alias("depends_on")))
    return K.dependency_levels(edges, t.part.select(key.alias("node")))
