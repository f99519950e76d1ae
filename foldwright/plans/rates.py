"""Queries for rates, weighted scores, posteriors and small-model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.operators import metrics as M
from foldwright.operators import rates as R
from foldwright.plans.fixtures import TASKS, rounded
from foldwright.plans.registry import query, r6
from foldwright.session import scratch_path
from foldwright.sources import scores as task_source


@query(
    "src4_task_score_violations",
    """SELECT l_linenumber AS candidate, l_suppkey AS task, CASE WHEN l_suppkey % 17 = 0 THEN 'empty'
      WHEN l_suppkey % 13 = 0 THEN 'composite_name' ELSE 'not_finite' END AS problem, count(*) AS n FROM lineitem
    WHERE l_suppkey % 17 = 0 OR l_suppkey % 13 = 0 OR l_suppkey % 11 = 0 GROUP BY ALL""",
)
def _(t):
    key = F.col("l_suppkey")
    metrics = (
        F.when(key % 17 == 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
        .when(key % 13 == 0, F.create_map(F.lit("Combined"), F.col("l_tax")))
        .when(key % 11 == 0, F.create_map(F.lit("tax"), F.lit(float("nan"))))
        .otherwise(F.create_map(F.lit("tax"), F.col("l_tax")))
    )
    rows = t.lineitem.select(F.col("l_linenumber").alias("candidate"), key.alias("task"), metrics.alias("metrics"))
    return R.score_violations(rows).groupBy("candidate", "task", "problem").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src4_append_task_scores",
    f"""WITH {TASKS} SELECT candidate_id, task_id, kind, {r6("quantity")} AS quantity, {r6("tax")} AS tax FROM tasks""",
)
def _(t):
    path = scratch_path(t.spark, "scores")
    scores = t.task_scores()
    task_source.append_task_scores(scores.filter("kind = 'even'"), path)
    task_source.append_task_scores(scores.filter("kind = 'odd'"), path)
    rows = task_source.load_task_scores(t.spark, path)
    return rows.select(
        "candidate_id", "task_id", "kind", rounded(F.col("metrics")["quantity"]).alias("quantity"),
        rounded(F.col("metrics")["tax"]).alias("tax"),
    )


@query(
    "src5_latest_task_scores",
    f"""SELECT user_id AS candidate, event_id % 20 AS task, {r6("arg_max(value, event_id)")} AS value FROM events
    WHERE event_type <> 'error' GROUP BY ALL""",  # several rows of one key in one append: the later one counts
)
def _(t):
    rows = t.events.select(
        F.col("user_id").cast("string").alias("candidate_id"),
        (F.col("event_id") % 20).cast("string").alias("task_id"),
        F.when(F.col("event_type") == "error", "probe").otherwise("candidate").alias("kind"),
        F.create_map(F.lit("v"), F.col("value")).alias("metrics"),
        F.floor(F.col("event_id") / 500).alias("append_seq"), F.col("event_id").alias("batch_order"),
    )
    latest = task_source.latest_task_scores(rows, "candidate")
    return latest.select(
        F.col("candidate_id").cast("long").alias("candidate"), F.col("task_id").cast("long").alias("task"),
        rounded(F.col("metrics")["v"]).alias("value"),
    )


COMPOSITE = "CASE WHEN discount >= 0.05 THEN 2.0 * quantity + 30.0 * tax ELSE 2.0 * quantity END"


@query(
    "agg19_composite_score",
    f"""WITH {TASKS} SELECT candidate_id, count(*) AS tasks, {r6(f"avg({COMPOSITE})")} AS composite
    FROM tasks WHERE kind = 'even' GROUP BY candidate_id""",
)
def _(t):
    scores = t.task_scores()
    made = R.per_task_composite(scores, {"quantity": 2.0, "tax": 30.0}, ("discount", 0.05, ("quantity",)))
    return R.composite_scores(made.checked(), scores.filter("kind = 'even'")).select(
        "candidate_id", "tasks", rounded("composite").alias("composite")
    )


@query(
    "agg19_composite_missing",
    f"""WITH {TASKS} SELECT candidate_id, task_id, 'tax' AS missing FROM tasks WHERE CAST(task_id AS BIGINT) % 9 = 0""",
)
def _(t):
    scores = t.task_scores().withColumn(
        "metrics", F.map_filter("metrics", lambda k, _: (k != "tax") | (F.col("task_id").cast("long") % 9 != 0))
    )
    made = R.per_task_composite(scores, {"quantity": 1.0, "tax": 1.0})
    return made.violations.select("candidate_id", "task_id", F.array_join("missing", ",").alias("missing"))


@query(
    "agg20_metric_vectors",
    f"""WITH {TASKS} SELECT candidate_id, task_id, {r6("tax")} AS value FROM tasks WHERE CAST(task_id AS BIGINT) % 9 <> 0""",
)
def _(t):
    scores = t.task_scores().withColumn(
        "metrics", F.map_filter("metrics", lambda k, _: (k != "tax") | (F.col("task_id").cast("long") % 9 != 0))
    )
    return R.metric_vectors(scores, "tax").select("candidate_id", "task_id", rounded("value").alias("value"))


# Worlds: one run per user, five worlds (one per event type), every event is one piece of evidence.
WORLDS = """ev AS (SELECT user_id AS run_id, event_id AS evidence_id, w AS world_id,
      (event_id * (w + 3) % 97 + 1) / 98.0::DOUBLE AS likelihood, (event_id % 10 + 1) / 10.0::DOUBLE AS reliability
    FROM events, range(5) r(w)),
  lp AS (SELECT run_id, world_id, max(ln((world_id + 1) / 15.0::DOUBLE)) + sum(reliability * ln(likelihood)) AS lp, count(*) AS updates
    FROM ev GROUP BY ALL),
  post AS (SELECT run_id, world_id, updates, exp(lp - max(lp) OVER (PARTITION BY run_id)) AS w FROM lp),
  posterior AS (SELECT run_id, world_id, updates, w / sum(w) OVER (PARTITION BY run_id) AS p FROM post)"""


def _worlds(t):
    worlds = F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<long>"))
    evidence = t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("evidence_id"), worlds.alias("world_id"))
    evidence = evidence.select(
        "run_id", "evidence_id", "world_id",
        ((F.col("evidence_id") * (F.col("world_id") + 3) % 97 + 1) / 98.0).alias("likelihood"),
        ((F.col("evidence_id") % 10 + 1) / 10.0).alias("reliability"),
    )
    runs = t.events.select(F.col("user_id").alias("run_id")).distinct().select("run_id", worlds.alias("world_id"))
    return runs.withColumn("prior", (F.col("world_id") + 1) / 15.0).withColumn("active", F.lit(True)), evidence


@query(
    "agg21_world_posterior",
    f"WITH {WORLDS} SELECT run_id, world_id, updates, {r6('p')} AS posterior FROM posterior",
)
def _(t):
    worlds, evidence = _worlds(t)
    return R.world_posterior(worlds, evidence).result.select(
        "run_id", "world_id", "updates", rounded("posterior").alias("posterior")
    )


@query(
    "agg21_world_evidence_violations",
    """SELECT user_id AS run_id, event_id AS evidence_id, w AS world_id, CASE WHEN w = 4 THEN 'missing' ELSE 'extra' END AS problem
    FROM events, (SELECT unnest([4, 0]) AS w) WHERE event_id % 50 = 0 AND (w = 4 OR user_id % 2 = 0)""",
)
def _(t):
    worlds, evidence = _worlds(t)
    worlds = worlds.withColumn("active", (F.col("world_id") != 0) | (F.col("run_id") % 2 != 0))
    planted = F.col("evidence_id") % 50 == 0
    rows = evidence.filter(F.when(planted, F.col("world_id") != 4).otherwise((F.col("world_id") != 0) | (F.col("run_id") % 2 != 0)))
    return R.world_posterior(worlds, rows).violations


@query(
    "agg22_posterior_entropy",
    f"""WITH {WORLDS} SELECT run_id, count(*) AS worlds, {r6("-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END)")} AS bits,
      {r6("-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) / log2(5)")} AS normalised FROM posterior GROUP BY run_id""",
)
def _(t):
    posterior = R.world_posterior(*_worlds(t)).result
    made = R.posterior_entropy(posterior, "posterior", ["run_id"])
    return made.select("run_id", "worlds", rounded("bits").alias("bits"), rounded("normalised").alias("normalised"))


@query(
    "agg23_validation_fidelity",
    f"""WITH d AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_size / 50.0::DOUBLE END AS r,
        CASE WHEN p_size % 3 = 0 THEN p_size / 60.0::DOUBLE END AS f, CASE WHEN p_size % 5 = 0 THEN p_size / 10.0::DOUBLE END AS v,
        CASE WHEN p_size % 7 = 0 THEN p_size / 70.0::DOUBLE END AS l FROM part),
      w AS (SELECT id, CASE WHEN r IS NULL THEN 0 ELSE 0.35 END + CASE WHEN f IS NULL THEN 0 ELSE 0.35 END
          + CASE WHEN v IS NULL THEN 0 ELSE 0.15 END + CASE WHEN l IS NULL THEN 0 ELSE 0.15 END AS w,
        coalesce(0.35 * (r + 1) / 2, 0) + coalesce(0.35 * f, 0) + coalesce(0.15 / (1 + v), 0) + coalesce(0.15 * (1 - l), 0) AS s FROM d)
    SELECT id, {r6("CASE WHEN w > 0 THEN CAST(s AS DOUBLE) / CAST(w AS DOUBLE) END")} AS fidelity FROM w""",
)
def _(t):
    size = F.col("p_size")
    some = lambda m, d: F.when(size % m == 0, size / d)
    return t.part.select(
        F.col("p_partkey").alias("id"),
        rounded(R.validation_fidelity(some(2, 50.0), some(3, 60.0), some(5, 10.0), some(7, 70.0))).alias("fidelity"),
    )


@query(
    "agg23_expected_score",
    f"WITH {WORLDS} SELECT run_id, {r6('sum(p * (world_id + 1)) / sum(p)')} AS expected_score FROM posterior GROUP BY run_id",
)
def _(t):
    posterior = R.world_posterior(*_worlds(t)).result.withColumn("score", F.col("world_id") + 1)
    return R.expected_score(posterior, "posterior", "score", ["run_id"]).select(
        "run_id", rounded("expected_score").alias("expected_score")
    )


STATUS_SQL = "CASE event_type WHEN 'error' THEN 'failed_resource' WHEN 'signup' THEN 'invalid_artifact' ELSE 'completed' END"


@query(
    "agg24_reliability_rates",
    f"""WITH r AS (SELECT user_id, {STATUS_SQL} AS s, value > 20 AS cand, value > 25 AS oof,
        CASE WHEN event_id % 3 = 0 THEN event_id % 2 END AS rep FROM events),
      a AS (SELECT user_id, count(*) AS n, avg(CAST(s = 'completed' AS INT)) AS c, avg(CAST(s = 'invalid_artifact' AS INT)) AS i,
        avg(CAST(s = 'failed_resource' AS INT)) AS f, coalesce(avg(CAST(oof AS INT)) FILTER (cand), 0) AS o,
        coalesce(count(*) FILTER (s = 'completed' AND rep >= 1) / nullif(CAST(count(rep) AS DOUBLE), 0), 0) AS p FROM r GROUP BY user_id)
    SELECT user_id, n, {r6("c")} AS completion, {r6("i")} AS invalid_artifact, {r6("f")} AS resource_failure,
      {r6("o")} AS oof_generation, {r6("p")} AS reproduction,
      c >= 0.9 AND i <= 0.05 AND f <= 0.05 AND o >= 0.9 AND p >= 0.9 AS target_met FROM a""",
)
def _(t):
    kind = F.col("event_type")
    rows = t.events.select(
        "user_id",
        F.when(kind == "error", "failed_resource").when(kind == "signup", "invalid_artifact").otherwise("completed").alias("terminal_status"),
        (F.col("value") > 20).alias("is_candidate"),
        (F.col("value") > 25).alias("has_oof"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 2).alias("reproduction_passed"),
    )
    made = R.reliability_rates(rows, ["user_id"])
    names = ("completion", "invalid_artifact", "resource_failure", "oof_generation", "reproduction")
    return made.select("user_id", "n", "target_met", *[rounded(c).alias(c) for c in names])


@query(
    "agg33_runtime_ratio",
    f"""WITH w AS (SELECT user_id, event_type = 'error' AS retry, CASE WHEN event_id % 4 = 0 THEN event_id % 100 * 36 / 3600.0::DOUBLE ELSE value / 49.371 END AS wall,
        CASE WHEN event_id % 5 = 0 THEN 0 ELSE value / 24.337 END AS cpu, CASE WHEN event_type = 'purchase' THEN value / 41.13 END AS est FROM events)
    SELECT user_id, count(*) FILTER (NOT retry) AS observed, count(*) FILTER (retry) AS retries, {r6("round(sum(wall), 4)")} AS wall_hours,
      {r6("round(sum(cpu), 4)")} AS cpu_hours, {r6("round(coalesce(sum(est), 0), 4)")} AS estimated_wall_hours,
      {r6("CASE WHEN coalesce(sum(est), 0) <> 0 THEN round(sum(wall) / sum(est), 2) ELSE 0 END")} AS estimate_ratio FROM w GROUP BY user_id""",
)
def _(t):
    key, value = F.col("event_id"), F.col("value")
    observed = t.events.select(
        "user_id",
        (F.col("event_type") == "error").alias("is_retry"),
        F.when(key % 4 != 0, value / 49.371).alias("wall_hours"),
        F.when(key % 4 == 0, (key % 100 * 36).cast("double")).alias("wall_seconds"),
        F.when(key % 5 != 0, value / 24.337).alias("cpu_hours"),
    )
    declared = t.events.filter("event_type = 'purchase'").select("user_id", (value / 41.13).alias("estimated_wall_hours"))
    made = R.runtime_ratio(observed, declared, "user_id")
    return made.select("user_id", "observed", "retries", *[rounded(c).alias(c) for c in made.columns[3:]])


@query(
    "agg34_validation_reuse",
    """WITH p AS (SELECT sha256(lower(p_type) || ' split|' || lower(list_aggregate(list_sort(string_split(lower(p_name), ' ')), 'string_agg', '|'))) AS fingerprint,
        p_size % 3 <> 0 AS settled, p_brand <> 'Brand#7' AS selecting FROM part)
    SELECT fingerprint, count(*) FILTER (settled AND selecting) AS used, count(*) FILTER (settled AND selecting) >= 10 AS exhausted
    FROM p GROUP BY fingerprint""",
)
def _(t):
    rows = t.part.select(
        R.validation_fingerprint(F.concat(F.lit("  "), F.col("p_type"), F.lit("   Split ")), F.split("p_name", " ")).alias("fingerprint"),
        (F.col("p_size") % 3 != 0).alias("settled"),
        (F.col("p_brand") != "Brand#7").alias("selecting"),
    )
    return R.validation_reuse(rows, 10)


@query(
    "agg35_token_efficiency",
    f"""SELECT user_id, CAST(sum(event_id % 1000) AS BIGINT) AS tokens,
      {r6("sum(event_id % 1000) / nullif(CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE), 0)")} AS per_completed,
      {r6("sum(event_id % 1000) / nullif(CAST(count(*) FILTER (value > 150) AS DOUBLE), 0)")} AS per_valid_candidate,
      {r6("sum(event_id % 1000) / CAST(count(DISTINCT event_type) AS DOUBLE)")} AS per_family,
      {r6("sum(event_id % 1000) / nullif(sum(greatest(value - 100, 0)), 0)")} AS per_gain
    FROM events GROUP BY user_id""",
)
def _(t):
    rows = t.events.select(
        "user_id",
        (F.col("event_id") % 1000).alias("tokens"),
        (F.col("event_type") == "purchase").alias("completed"),
        (F.col("value") > 150).alias("valid_candidate"),
        F.col("event_type").alias("family"),
        (F.col("value") - 100).alias("gain"),
    )
    made = R.token_efficiency(rows, ["user_id"])
    return made.select("user_id", "tokens", *[rounded(c).alias(c) for c in made.columns[2:]])


@query(
    "agg36_stable_groups",
    """WITH c AS (SELECT user_id, event_id % 30 AS lineage, count(*) FILTER (event_type IN ('purchase', 'view')) AS n FROM events GROUP BY ALL)
    SELECT user_id, count(*) FILTER (n >= 2) AS stable_groups FROM c GROUP BY user_id""",
)
def _(t):
    rows = t.events.withColumn("lineage", F.col("event_id") % 30)
    return R.stable_groups(rows, "user_id", "lineage", F.col("event_type").isin("purchase", "view"))


@query(
    "agg37_instability_scan",
    f"""SELECT o_orderkey, {r6("abs(o_orderkey % 97 - o_custkey % 89) / 100.0::DOUBLE")} AS spread,
      abs(o_orderkey % 97 - o_custkey % 89) / 100.0::DOUBLE > 0.255 AS unstable FROM orders""",
)
def _(t):
    a, b = (F.col("o_orderkey") % 97) / 100.0, (F.col("o_custkey") % 89) / 100.0
    metrics = F.create_map(F.lit("fold"), F.array(a, b), F.lit("one"), F.array(a))
    spread = R.widest_spread("m")
    return t.orders.withColumn("m", metrics).select("o_orderkey", rounded(spread).alias("spread"), (spread > 0.255).alias("unstable"))


CELLS = """cells AS (SELECT event_type AS domain, CAST(event_id % 7 AS BIGINT) AS state, user_id % 2 AS c0, hour(ts) % 2 AS c1,
    CASE WHEN value > 60 THEN 1 WHEN value < 15 THEN -1 ELSE 0 END AS label FROM events)"""


def _cells(t):
    return t.events.select(
        F.col("event_type").alias("domain"),
        (F.col("event_id") % 7).alias("state"),
        (F.col("user_id") % 2).alias("c0"),
        (F.hour("ts") % 2).cast("long").alias("c1"),
        F.when(F.col("value") > 60, 1).when(F.col("value") < 15, -1).otherwise(0).alias("label"),
    )


def _shrunk_sql(counts: str) -> str:
    return ", ".join(
        f"(n{i} + 5 * (g{i} + 1) / CAST(g0 + g1 + g2 + 3 AS DOUBLE)) / (n0 + n1 + n2 + 5) AS p{i}, "
        f"(g{i} + 1) / CAST(g0 + g1 + g2 + 3 AS DOUBLE) AS q{i}"
        for i in range(3)
    )


COUNTS3 = ", ".join(f"count(*) FILTER (label = {v}) AS n{i}" for i, v in enumerate((-1, 0, 1)))
PICK = "CASE WHEN {0}0 >= {0}1 AND {0}0 >= {0}2 THEN -1 WHEN {0}1 >= {0}2 THEN 0 ELSE 1 END"


@query(
    "agg41_context_shrinkage_model",
    f"""WITH {CELLS}, c AS (SELECT state, c0, c1, {COUNTS3} FROM cells GROUP BY ALL),
      g AS (SELECT state, sum(n0) AS g0, sum(n1) AS g1, sum(n2) AS g2 FROM c GROUP BY state),
      m AS (SELECT c.state, c0, c1, {_shrunk_sql("")} FROM c JOIN g USING (state))
    SELECT state, c0, c1, {r6("p0")} AS p_minus, {r6("p1")} AS p_zero, {r6("p2")} AS p_plus, {PICK.format("p")} AS predicted,
      {PICK.format("q")} AS checklist FROM m""",
)
def _(t):
    made = R.context_shrinkage_model(_cells(t), "state", ["c0", "c1"], "label")
    return made.select("state", "c0", "c1", "predicted", "checklist", *[rounded(c).alias(c) for c in ("p_minus", "p_zero", "p_plus")])


LODO = f"""{CELLS}, d AS (SELECT DISTINCT domain FROM cells),
      h AS (SELECT domain, state, c0, c1, {COUNTS3.replace("AS n", "AS o")} FROM cells GROUP BY ALL),
      tr AS (SELECT d.domain, cells.state, c0, c1, {COUNTS3} FROM d JOIN cells ON cells.domain <> d.domain GROUP BY ALL),
      g AS (SELECT domain, state, sum(n0) AS g0, sum(n1) AS g1, sum(n2) AS g2 FROM tr GROUP BY ALL),
      j AS (SELECT h.*, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, g0, g1, g2
        FROM h JOIN g USING (domain, state) LEFT JOIN tr USING (domain, state, c0, c1)),
      m AS (SELECT *, {_shrunk_sql("")} FROM j), k AS (SELECT *, {PICK.format("p")} AS pick, {PICK.format("q")} AS list FROM m)"""


@query(
    "agg42_leave_one_domain_out",
    f"""WITH {LODO} SELECT domain, CAST(sum(o0 + o1 + o2) AS BIGINT) AS n,
      {r6("sum(CASE pick WHEN -1 THEN o0 WHEN 0 THEN o1 ELSE o2 END) / sum(o0 + o1 + o2)")} AS context_accuracy,
      {r6("sum(CASE list WHEN -1 THEN o0 WHEN 0 THEN o1 ELSE o2 END) / sum(o0 + o1 + o2)")} AS checklist_accuracy,
      {r6("-sum(o0 * ln(p0) + o1 * ln(p1) + o2 * ln(p2)) / sum(o0 + o1 + o2)")} AS context_log_loss,
      {r6("-sum(o0 * ln(q0) + o1 * ln(q1) + o2 * ln(q2)) / sum(o0 + o1 + o2)")} AS checklist_log_loss
    FROM k GROUP BY domain""",
)
def _(t):
    made = R.leave_one_domain_out(_cells(t), "domain", "state", ["c0", "c1"], "label")
    return made.select("domain", "n", *[rounded(c).alias(c) for c in made.columns[2:]])


TWO_PART = f"""{CELLS}, c AS (SELECT state, c0, c1, {COUNTS3} FROM cells GROUP BY ALL),
      g AS (SELECT state, sum(n0) AS g0, sum(n1) AS g1, sum(n2) AS g2 FROM c GROUP BY state),
      m AS (SELECT c.*, (n0 + n2 + 5 * (g0 + g2 + 1) / CAST(g0 + g1 + g2 + 2 AS DOUBLE)) / (n0 + n1 + n2 + 5) AS pm,
        (n0 + 5 * (g0 + 1) / CAST(g0 + g2 + 2 AS DOUBLE)) / (n0 + n2 + 5) AS pn FROM c JOIN g USING (state))"""


@query(
    "agg43_two_part_model",
    f"WITH {TWO_PART} SELECT state, c0, c1, {r6('pm')} AS p_mentioned, {r6('pn')} AS p_minus FROM m",
)
def _(t):
    made = R.two_part_model(_cells(t), "state", ["c0", "c1"], "label")
    return made.select("state", "c0", "c1", rounded("p_mentioned").alias("p_mentioned"), rounded("p_minus").alias("p_minus"))


@query(
    "agg43_alarm_threshold",
    f"""WITH {TWO_PART}, s AS (SELECT round(pm * pn, 2) AS s, n0 + n1 + n2 AS n, CASE WHEN state = 3 THEN n0 ELSE 0 END AS k FROM m),
      b AS (SELECT s, sum(n) AS n FROM s GROUP BY s), x AS (SELECT s, sum(n) OVER (ORDER BY s DESC) AS upto FROM b),
      q AS (SELECT sum(k) AS minus, sum(n) AS rows FROM s)
    SELECT CAST(minus AS BIGINT) AS true_minus, {r6("CASE WHEN minus = 0 THEN 'inf'::DOUBLE WHEN 2 * minus >= rows THEN 0 ELSE coalesce((SELECT min(s) FROM x WHERE upto <= 2 * minus), 'inf'::DOUBLE) END")} AS threshold FROM q""",
)
def _(t):
    model = R.two_part_model(_cells(t), "state", ["c0", "c1"], "label")
    model = model.withColumn("alarm_score", F.round("alarm_score", 2)).withColumn(
        "true_minus", F.when(F.col("state") == 3, F.col("true_minus")).otherwise(0)
    )
    return R.alarm_threshold(model).select("true_minus", rounded("threshold").alias("threshold"))


@query(
    "agg44_class_promotion",
    """WITH o AS (SELECT p_partkey % 150 AS id, CASE WHEN p_size > 30 THEN 'direct' ELSE 'arguable' END AS s, p_type AS pc, p_brand AS comp,
        CASE WHEN p_size % 2 = 0 OR p_partkey % 150 < 75 THEN p_size % 2 END AS model, CASE WHEN p_partkey % 150 % 4 = 0 THEN 'promoted' ELSE 'candidate' END AS prev FROM part),
      a AS (SELECT id, count(*) FILTER (s = 'direct') AS direct, count(*) FILTER (s <> 'direct') AS arguable,
        count(DISTINCT pc) FILTER (s = 'direct') AS pcs, count(DISTINCT comp) FILTER (s = 'direct') AS comps,
        count(DISTINCT model) FILTER (s = 'direct') AS models, count(model) FILTER (s = 'direct') AS named, max(prev) AS prev FROM o GROUP BY id),
      r AS (SELECT *, concat_ws(',', CASE WHEN pcs < 2 THEN 'problem_classes' END, CASE WHEN comps < 2 THEN 'competitions' END,
        CASE WHEN direct > 0 AND named = direct AND models < 2 THEN 'models' END) AS reasons FROM a)
    SELECT id, direct, arguable, pcs AS problem_classes, comps AS competitions, models, reasons,
      CASE WHEN reasons = '' THEN 'promoted' ELSE 'candidate' END AS status, prev = 'promoted' AND reasons <> '' AS demoted FROM r""",
)
def _(t):
    key = F.col("p_partkey") % 150
    rows = t.part.select(
        key.alias("id"),
        F.when(F.col("p_size") > 30, "direct").otherwise("arguable").alias("strength"),
        F.col("p_type").alias("problem_class"),
        F.col("p_brand").alias("competition"),
        F.when((F.col("p_size") % 2 == 0) | (key < 75), F.col("p_size") % 2).alias("agent_model"),
        F.when(key % 4 == 0, "promoted").otherwise("candidate").alias("previous_status"),
    )
    return R.class_promotion(rows, "id").withColumn("reasons", F.concat_ws(",", "reasons"))


@query(
    "agg45_overlap_classification",
    """WITH r AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE 100000 + p_partkey % 400 END AS cluster, p_partkey % 2 AS agent,
        CASE WHEN p_partkey % 400 < 300 THEN 'x' ELSE p_type END AS claim, p_brand AS model, p_size % 3 AS obs, 1 AS slice, 2 AS path,
        p_size < 48 AS pre, p_size = 1 AS seen FROM part)
    SELECT cluster, count(*) AS experiments, count(DISTINCT agent) AS agents,
      CASE WHEN count(*) = 1 THEN '' ELSE concat_ws(',', CASE WHEN count(DISTINCT model) > 1 THEN 'model' END, CASE WHEN count(DISTINCT obs) > 1 THEN 'observable' END) END AS varying,
      CASE WHEN count(*) = 1 THEN 'unique' WHEN count(DISTINCT claim) = 1 AND count(DISTINCT agent) >= 2 AND bool_and(pre AND NOT seen)
        AND (count(DISTINCT model) > 1 OR count(DISTINCT obs) > 1) THEN 'independent_replication' ELSE 'redundant_duplication' END AS classification
    FROM r GROUP BY cluster""",
)
def _(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = t.part.select(
        F.when(key % 3 == 0, key).otherwise(100_000 + key % 400).alias("cluster"),
        (key % 2).alias("agent"),
        F.when(key % 400 < 300, "x").otherwise(F.col("p_type")).alias("claim"),
        F.lit("o").alias("operation"),
        F.lit("d").alias("downstream_decision"),
        F.col("p_brand").alias("model"),
        (size % 3).alias("observable"),
        F.lit(1).alias("data_slice"),
        F.lit(2).alias("falsification_path"),
        (size < 48).alias("preregistered"),
        (size == 1).alias("source_seen"),
    )
    return R.overlap_classification(rows, "cluster").withColumn("varying", F.concat_ws(",", "varying"))


@query(
    "agg46_cell_census",
    f"""WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part WHERE p_size > 45 GROUP BY ALL)
    SELECT p_partkey, {r6("CASE WHEN p_size % 9 = 0 THEN NULL ELSE 1 - least(coalesce(n, 0), 4) / 4.0 END")} AS contribution
    FROM part LEFT JOIN c ON part.p_type = c.p_type AND part.p_brand = c.p_brand""",
)
def _(t):
    part = t.part
    census = R.cell_census(part.filter("p_size > 45"), ["p_type", "p_brand"])
    proposals = part.withColumn("p_type", F.when(F.col("p_size") % 9 != 0, F.col("p_type")))
    return R.cell_contribution(proposals, census, ["p_type", "p_brand"]).select(
        "p_partkey", rounded("contribution").alias("contribution")
    )


@query(
    "agg60_posterior_weighted_metric",
    f"""SELECT user_id AS run_id, event_id AS observation_id, {r6('''CASE WHEN event_id % 3 = 0 THEN value
        WHEN user_id % 2 = 0 THEN (0.25 * value + 0.75 * (value + 4)) ELSE value END''')} AS value FROM events""",
)
def _(t):
    v, key = F.col("value"), F.col("event_id")
    metrics = F.when(key % 3 == 0, F.create_map(F.lit("auc"), v, F.lit("auc@w0"), v - 9)).otherwise(
        F.create_map(F.lit("auc"), v, F.lit("auc@w0"), v, F.lit("auc:w0"), v - 50, F.lit("auc:w1"), v + 4, F.lit("loss@w1"), v - 1)
    )
    events = t.events
    observations = events.select(F.col("user_id").alias("run_id"), key.alias("observation_id"), metrics.alias("metrics"))
    pairs = F.inline(F.array(F.struct(F.lit("w0").alias("world_id"), F.lit(0.25).alias("posterior")), F.struct(F.lit("w1").alias("world_id"), F.lit(0.75).alias("posterior"))))
    worlds = events.filter("user_id % 2 = 0").select(F.col("user_id").alias("run_id")).distinct().select("run_id", pairs)
    return R.posterior_weighted_metric(observations, worlds, "auc").select("run_id", "observation_id", rounded("value").alias("value"))


@query(
    "agg61_forecast_records",
    f"""WITH f AS (SELECT event_id, user_id / 150.0::DOUBLE AS q, (event_id % 7 + 1) / 10.0::DOUBLE AS a, (event_id % 5 + 1) / 10.0::DOUBLE AS b, value,
        CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS obs FROM events WHERE event_type <> 'error' AND event_id % 6 <> 0),
      p AS (SELECT *, q * a + (1 - q) * b AS ph FROM f)
    SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS agent, count(*) AS n,
      {r6("avg((pow(ph - CAST(obs = 'high' AS INT), 2) + pow(1 - ph - CAST(obs = 'low' AS INT), 2)) / 2)")} AS brier,
      {r6("avg(CAST(value BETWEEN 10 AND 60 AS INT))")} AS coverage_80 FROM p GROUP BY 1""",
)
def _(t):
    key = F.col("event_id")
    p_true, p_false = (key % 7 + 1) / 10.0, (key % 5 + 1) / 10.0
    outcome = lambda label, a, b: F.struct(F.lit(label).alias("label"), a.alias("p_true"), b.alias("p_false"))
    forecasts = t.events.select(
        key.alias("experiment_id"),
        F.when(key % 2 == 0, "even").otherwise("odd").alias("agent"),
        F.lit("effect").alias("category"),
        (F.col("user_id") / 150.0).alias("prior"),
        F.array(outcome("high", p_true, p_false), outcome("low", 1 - p_true, 1 - p_false)).alias("outcomes"),
        F.array(
            F.struct(F.lit("m").alias("metric"), F.lit("0.8").alias("level"), F.lit(10.0).alias("low"), F.lit(60.0).alias("high")),
            F.struct(F.lit("absent").alias("metric"), F.lit("0.95").alias("level"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high")),
        ).alias("intervals"),
    )
    results = t.events.select(
        key.alias("experiment_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        (key % 6 == 0).alias("failed"),
        F.when(F.col("value") > 50, "high").otherwise("low").alias("observed_label"),
        F.create_map(F.lit("m"), F.col("value")).alias("metrics"),
    )
    records = R.forecast_records(forecasts, results)
    made = M.forecast_calibration(records, "probabilities", "observed_label", "coverage", ["agent"])
    return made.select("agent", "n", rounded("brier").alias("brier"), rounded("coverage_80").alias("coverage_80"))
