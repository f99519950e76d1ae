"""Queries for run states and entity tables folded from raw events."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.operators import runstate as R
from foldwright.operators.runlog import budget_running_totals
from foldwright.plans.fixtures import RUNLOG, rounded
from foldwright.plans.registry import query, r6
from foldwright.plans.runlog import GATE, _queries
from foldwright.session import scratch_path
from foldwright.streaming import folds, gates

_TYPES = (
    "HYPOTHESIS_PROPOSED", "HYPOTHESIS_PROPOSED", "HYPOTHESIS_REVISED", "BELIEF_UPDATED", "BELIEF_UPDATED", "EXPERIMENT_PROPOSED", "EXPERIMENT_PROPOSED",
    "EXPERIMENT_SELECTED", "EXPERIMENT_SELECTED", "EXPERIMENT_STARTED", "EXPERIMENT_COMPLETED", "EXPERIMENT_FAILED", "RESOURCE_RECONCILED",
    "AGENT_RESOURCE_RECORDED", "EXPERIMENT_RETRY_SCHEDULED", "VALIDATION_WORLD_REGISTERED", "VALIDATION_POSTERIOR_UPDATED", "PHASE_CHANGED", "STATE_CHANGED",
    "VIOLATION_DETECTED",
)
_OTHERS = {
    1: "OBSERVATION_RECORDED", 21: "QD_CANDIDATE_EVALUATED", 41: "OOF_ARTIFACT_RECORDED", 61: "OOF_ENSEMBLE_CREATED", 81: "FORECAST_CALIBRATION_RECORDED",
    37: "RESEARCH_BRIEF_CREATED", 77: "RESEARCH_BRIEF_CREATED", 39: "RUN_FINALIZED",
}


def _raw_log(t):
    """The log as raw events with JSON payloads; every thirteenth run has no creation event."""
    k, s = F.col("k"), F.col("sequence")
    log = t.run_log().withColumn("run_id", F.col("run_id").cast("long"))
    by_k = F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (k % 20 + 1).cast("int"))
    for value, name in _OTHERS.items():
        by_k = F.when(k == value, name).otherwise(by_k)
    log = log.withColumn("et", F.when((s == 1) & (F.col("run_id") % 13 != 5), "RUN_CREATED").otherwise(by_k))
    named = lambda letter, n, m: F.concat(F.lit(letter), (n % m).cast("string"))
    et = F.col("et")
    cost = lambda a, b: F.struct(
        (k / a).alias("cpu_hours"), (k / b).alias("gpu_hours"), F.lit(0.25).alias("wall_hours"), (k * 2).alias("llm_tokens"), (k / 20).alias("monetary_cost")
    )
    payload = F.struct(
        F.when(et.startswith("HYP"), named("h", s, 7)).when(et == "EXPERIMENT_PROPOSED", named("x", s, 9)).when(et == "VALIDATION_WORLD_REGISTERED", named("w", s, 3))
        .when(et == "RUN_CREATED", F.col("run_id").cast("string")).otherwise(named("o", s, 4)).alias("id"),
        named("c", k, 3).alias("competition_id"), F.when(k % 3 > 0, "exploitation").otherwise("discovery").alias("phase"), named("st", k, 4).alias("status"),
        named("S", k, 5).alias("state"), F.when(k % 4 == 1, "").when(k % 4 > 1, "running").alias("run_status"), named("t", k, 3).alias("type"),
        named("e", k, 3).alias("experiment_type"), named("p", k, 3).alias("split_type"), (k / 100).alias("current_confidence"), F.when(k % 2 == 0, 3).alias("version"),
        named("h", s, 7).alias("hypothesis_id"), ((k + s % 5) / 200).alias("posterior_confidence"), named("x", s, 9).alias("experiment_id"),
        F.when(k % 3 > 0, k % 3).alias("attempt"), named("q", k, 5).alias("candidate_id"), named("a", k, 4).alias("proposer_agent"), named("a", k, 4).alias("agent"),
        F.when(et == "EXPERIMENT_SELECTED", F.array(named("x", s, 9), named("x", s + 4, 9))).alias("selected_experiment_ids"),
        F.create_map(named("x", s + 2, 9), F.lit("why")).alias("rejected_reasons"), F.create_map(F.lit("w0"), k / 100, F.lit("w1"), 1 - k / 100).alias("posterior"),
        (k / 200).alias("posterior_probability"), F.concat(F.lit("ev"), s.cast("string")).alias("evidence_id"), F.array(F.concat(F.lit("b"), k.cast("string"))).alias("evidence_ids"),
        k.alias("total_tokens"), (k / 10).alias("monetary_cost"), cost(50, 100).alias("estimated_cost"), cost(80, 90).alias("charged_cost"),
        cost(5, 10).alias("estimated"), cost(40, 30).alias("charged"),
        F.struct(*[F.lit(1.0).alias(f) for f in R.USAGE]).alias("budget_usage"),
    )
    return log.select("run_id", F.col("sequence"), "event_id", et.alias("event_type"), F.col("t").alias("occurred_at"), F.to_json(payload).alias("payload"))


def _case_k() -> str:
    others = " ".join(f"WHEN k = {value} THEN '{name}'" for value, name in _OTHERS.items())
    types = ", ".join(f"'{x}'" for x in _TYPES)
    return f"CASE WHEN sequence = 1 AND run_id % 13 <> 5 THEN 'RUN_CREATED' {others} ELSE [{types}][k % 20 + 1] END"


RAW = f"""{RUNLOG}, e AS (SELECT CAST(run_id AS VARCHAR) AS run_id, sequence AS s, k, k::DOUBLE AS d, CAST(event_id AS VARCHAR) AS event_id, CAST(t AS VARCHAR) AS occurred, {_case_k()} AS et,
      'h' || s % 7 AS h, 'x' || s % 9 AS x, 'o' || s % 4 AS o, 'w' || s % 3 AS w, CASE WHEN k % 3 > 0 THEN 'exploitation' ELSE 'discovery' END AS phase,
      CASE WHEN k % 2 = 0 THEN 3.0 ELSE 1.0 END AS version FROM runlog),
    born AS (SELECT run_id FROM e WHERE et = 'RUN_CREATED')"""

# Selections with the latest proposal before each, and what every event does to the usage.
CHARGES = """chosen AS (SELECT run_id, s, 0 AS place, x FROM e WHERE et = 'EXPERIMENT_SELECTED' UNION ALL SELECT run_id, s, 1, 'x' || (s + 4) % 9 FROM e WHERE et = 'EXPERIMENT_SELECTED'),
    bound AS (SELECT c.run_id, c.s, c.place, c.x, max(p.s) AS made_at FROM chosen c JOIN e p ON p.run_id = c.run_id AND p.x = c.x AND p.et = 'EXPERIMENT_PROPOSED' AND p.s < c.s GROUP BY ALL),
    delta AS (
      SELECT b.run_id, b.s, 1.0 AS experiments, p.d / 50 AS cpu_hours, p.d / 100 AS gpu_hours, 0.25 AS wall_hours, p.d * 2 AS llm_tokens, p.d / 20 AS cost FROM bound b JOIN e p ON p.run_id = b.run_id AND p.s = b.made_at
      UNION ALL SELECT run_id, s, 1, 1, 1, 1, 1, 1 FROM e WHERE et = 'RUN_CREATED'
      UNION ALL SELECT run_id, s, 0, 0, 0, 0, d, d / 10 FROM e WHERE et = 'AGENT_RESOURCE_RECORDED'
      UNION ALL SELECT run_id, s, 0, d / 80, d / 90, 0.25, d * 2, d / 20 FROM e WHERE et = 'EXPERIMENT_RETRY_SCHEDULED'
      UNION ALL SELECT run_id, s, 0, d / 40 - d / 5, d / 30 - d / 10, 0, 0, 0 FROM e WHERE et = 'RESOURCE_RECONCILED'),
    summed AS (SELECT run_id, s, sum(experiments) AS experiments, sum(cpu_hours) AS cpu_hours, sum(gpu_hours) AS gpu_hours, sum(wall_hours) AS wall_hours, sum(llm_tokens) AS llm_tokens, sum(cost) AS cost,
      row_number() OVER (PARTITION BY run_id ORDER BY s) AS n FROM delta WHERE run_id IN (FROM born) GROUP BY run_id, s),
    walk(run_id, s, n, experiments, cpu_hours, gpu_hours, wall_hours, llm_tokens, cost) AS (SELECT run_id, s, n, experiments::DOUBLE, cpu_hours::DOUBLE, gpu_hours::DOUBLE, wall_hours::DOUBLE, llm_tokens::DOUBLE, cost::DOUBLE FROM summed WHERE n = 1
      UNION ALL SELECT d.run_id, d.s, d.n, u.experiments + d.experiments, greatest(0, u.cpu_hours + d.cpu_hours), greatest(0, u.gpu_hours + d.gpu_hours), u.wall_hours + d.wall_hours, u.llm_tokens + d.llm_tokens, u.cost + d.cost
      FROM walk u JOIN summed d ON d.run_id = u.run_id AND d.n = u.n + 1)"""


@query(
    "str4_usage_from_events",
    f"WITH RECURSIVE {RAW}, {CHARGES} SELECT run_id, s AS sequence, " + ", ".join(f"{r6(f)} AS {f}" for f in R.USAGE) + " FROM walk",
)
def _(t):
    totals = budget_running_totals(R.usage_deltas(R.parsed(_raw_log(t))), "run_id", "sequence", R.USAGE)
    return totals.select("run_id", "sequence", *[rounded(f).alias(f) for f in R.USAGE])


_FIELDS = """state AS (
      SELECT run_id, 'run' AS entity, run_id AS id, 'status' AS field, 0 AS place, arg_max(CASE et WHEN 'RUN_CREATED' THEN 'st' || k % 4 WHEN 'VIOLATION_DETECTED' THEN 'blocked' WHEN 'RUN_FINALIZED' THEN 'completed' ELSE 'running' END, s) AS text, NULL::DOUBLE AS number
        FROM e WHERE et IN ('RUN_CREATED', 'VIOLATION_DETECTED', 'RUN_FINALIZED') OR et = 'STATE_CHANGED' AND k % 4 > 1 GROUP BY run_id
      UNION ALL SELECT run_id, 'run', run_id, 'finalized_at', 0, arg_max(occurred, s) FILTER (et = 'RUN_FINALIZED'), NULL FROM e GROUP BY run_id
      UNION ALL SELECT run_id, 'run', run_id, 'phase', 0, arg_max(CASE et WHEN 'RUN_FINALIZED' THEN 'finalized' ELSE phase END, s), NULL FROM e WHERE et IN ('RUN_CREATED', 'PHASE_CHANGED', 'RUN_FINALIZED') GROUP BY run_id
      UNION ALL SELECT run_id, 'run', run_id, 'loop_state', 0, arg_max('S' || k % 5, s), NULL FROM e WHERE et = 'STATE_CHANGED' GROUP BY run_id
      UNION ALL SELECT run_id, 'run', run_id, 'brief', 0, arg_max(CASE et WHEN 'RESEARCH_BRIEF_CREATED' THEN o ELSE '' END, s), arg_max(CASE et WHEN 'RESEARCH_BRIEF_CREATED' THEN s ELSE -1 END, s)
        FROM e WHERE et = 'RESEARCH_BRIEF_CREATED' OR et = 'PHASE_CHANGED' AND phase = 'discovery' GROUP BY run_id
      UNION ALL SELECT run_id, 'run', run_id, 'violations', 0, NULL, count(*) FROM e WHERE et = 'VIOLATION_DETECTED' GROUP BY run_id
      UNION ALL SELECT run_id, 'hypothesis', h, 'confidence', 0, NULL, arg_max(CASE et WHEN 'BELIEF_UPDATED' THEN (k + s % 5) / 200.0::DOUBLE ELSE d / 100 END, s)
        FROM e WHERE et IN ('HYPOTHESIS_PROPOSED', 'HYPOTHESIS_REVISED', 'BELIEF_UPDATED') GROUP BY run_id, h HAVING bool_or(et <> 'BELIEF_UPDATED')
      UNION ALL SELECT b.run_id, 'hypothesis', b.h, 'version', 0, NULL, any_value(b.version) + count(u.s) FROM hyp b LEFT JOIN e u ON u.run_id = b.run_id AND u.h = b.h AND u.et = 'BELIEF_UPDATED' AND u.s > b.s GROUP BY b.run_id, b.h
      UNION ALL SELECT run_id, 'experiment', x, 'status', 0, coalesce(arg_max(st, s * 10 + place) FILTER (place >= 0), arg_min(st, s) FILTER (place < 0)), NULL FROM stat GROUP BY run_id, x
      UNION ALL SELECT run_id, 'experiment', x, 'attempt', 0, NULL, arg_max(CASE WHEN k % 3 > 0 THEN k % 3 ELSE 1 END, s) FROM e WHERE et = 'EXPERIMENT_STARTED' GROUP BY run_id, x
      UNION ALL SELECT run_id, 'world', w, 'posterior', 0, NULL, p FROM world
      UNION ALL SELECT run_id, 'world', w, 'version', 0, NULL, v FROM world
      UNION ALL SELECT run_id, 'world', w, 'evidence', row_number() OVER (PARTITION BY run_id, w ORDER BY s), ev, NULL FROM seen
      UNION ALL SELECT run_id, 'run', run_id, 'selection_order', row_number() OVER (PARTITION BY run_id ORDER BY s, place), x, NULL FROM chosen
      UNION ALL SELECT run_id, 'run', run_id, f, 0, NULL, n FROM (UNPIVOT (SELECT run_id, """ + ", ".join(f'arg_max({f}, s) AS "usage.{f}"' for f in R.USAGE) + """ FROM walk GROUP BY run_id) ON COLUMNS(* EXCLUDE run_id) INTO NAME f VALUE n))"""

STATE = f"""{RAW}, {CHARGES},
    hyp AS (SELECT run_id, h, max(s) AS s, arg_max(version, s) AS version FROM e WHERE et IN ('HYPOTHESIS_PROPOSED', 'HYPOTHESIS_REVISED') GROUP BY run_id, h),
    stat AS (SELECT run_id, x, s, 1 AS place, 'selected' AS st FROM chosen UNION ALL SELECT run_id, 'x' || (s + 2) % 9, s, 0, 'rejected' FROM e WHERE et = 'EXPERIMENT_SELECTED'
      UNION ALL SELECT run_id, x, s, 0, CASE et WHEN 'EXPERIMENT_STARTED' THEN 'running' WHEN 'EXPERIMENT_COMPLETED' THEN 'completed' ELSE 'failed' END FROM e WHERE et IN ('EXPERIMENT_STARTED', 'EXPERIMENT_COMPLETED', 'EXPERIMENT_FAILED')
      UNION ALL SELECT run_id, x, s, -1, 'st' || k % 4 FROM e WHERE et = 'EXPERIMENT_PROPOSED'),
    reg AS (SELECT run_id, w, max(s) AS s, arg_max(d / 200, s) AS p, arg_max(version, s) AS v, arg_max('b' || k, s) AS ev FROM e WHERE et = 'VALIDATION_WORLD_REGISTERED' GROUP BY run_id, w),
    upd AS (SELECT run_id, s, unnest(['w0', 'w1']) AS w, unnest([d / 100, 1 - d / 100]) AS p FROM e WHERE et = 'VALIDATION_POSTERIOR_UPDATED'),
    world AS (SELECT r.run_id, r.w, coalesce(arg_max(u.p, u.s), any_value(r.p)) AS p, any_value(r.v) + count(u.s) AS v FROM reg r LEFT JOIN upd u ON u.run_id = r.run_id AND u.w = r.w AND u.s > r.s GROUP BY r.run_id, r.w),
    seen AS (SELECT run_id, w, s, ev FROM reg UNION ALL SELECT u.run_id, u.w, u.s, 'ev' || u.s FROM upd u JOIN reg r ON u.run_id = r.run_id AND u.w = r.w AND u.s > r.s),
    {_FIELDS}
    SELECT run_id, entity, id, field, place::BIGINT AS place, CASE WHEN field = 'brief' THEN nullif(text, '') ELSE text END AS text, {r6("CASE WHEN field = 'brief' THEN nullif(number, -1) ELSE number END")} AS number FROM state WHERE run_id IN (FROM born)
    UNION ALL SELECT DISTINCT run_id, 'run', run_id, 'error', 0::BIGINT, '{R.NO_RUN}', NULL::DOUBLE FROM e WHERE run_id NOT IN (FROM born)"""


@query("str3_run_state_from_events", f"WITH RECURSIVE {STATE}")
def _(t):
    return R.run_state(_raw_log(t)).withColumn("number", rounded("number"))


_ROWS = """(SELECT run_id, 'hypotheses' AS entity, h AS id, s, k, d, version, 't' || k % 3 AS label, d / 100 AS number FROM e WHERE et IN ('HYPOTHESIS_PROPOSED', 'HYPOTHESIS_REVISED')
      UNION ALL SELECT run_id, 'experiments', x, s, k, d, version, 'e' || k % 3, NULL FROM e WHERE et = 'EXPERIMENT_PROPOSED'
      UNION ALL SELECT run_id, 'validation_worlds', w, s, k, d, version, 'p' || k % 3, d / 200 FROM e WHERE et = 'VALIDATION_WORLD_REGISTERED'
      UNION ALL SELECT run_id, 'runs', run_id, s, k, d, version, 'c' || k % 3, NULL FROM e WHERE et = 'RUN_CREATED'
      UNION ALL SELECT run_id, 'violations', event_id, s, k, d, version, NULL, NULL FROM e WHERE et = 'VIOLATION_DETECTED'
      UNION ALL SELECT run_id, CASE et WHEN 'OBSERVATION_RECORDED' THEN 'observations' WHEN 'QD_CANDIDATE_EVALUATED' THEN 'qd_candidates' WHEN 'OOF_ARTIFACT_RECORDED' THEN 'oof_artifacts' WHEN 'OOF_ENSEMBLE_CREATED' THEN 'oof_ensembles'
          WHEN 'FORECAST_CALIBRATION_RECORDED' THEN 'forecast_calibrations' WHEN 'AGENT_RESOURCE_RECORDED' THEN 'agent_resource_records' ELSE 'experiment_retries' END, o, s, k, d, version,
        CASE WHEN et IN ('OBSERVATION_RECORDED', 'QD_CANDIDATE_EVALUATED', 'EXPERIMENT_RETRY_SCHEDULED') THEN x WHEN et = 'OOF_ARTIFACT_RECORDED' THEN 'q' || k % 5 WHEN et IN ('FORECAST_CALIBRATION_RECORDED', 'AGENT_RESOURCE_RECORDED') THEN 'a' || k % 4 END, NULL
        FROM e WHERE et IN ('OBSERVATION_RECORDED', 'QD_CANDIDATE_EVALUATED', 'OOF_ARTIFACT_RECORDED', 'OOF_ENSEMBLE_CREATED', 'FORECAST_CALIBRATION_RECORDED', 'AGENT_RESOURCE_RECORDED', 'EXPERIMENT_RETRY_SCHEDULED'))"""


@query(
    "str2_entity_tables",
    f"""WITH {RAW}, made AS (SELECT run_id, entity, id, max(s) AS s, arg_max(k, s) AS k, arg_max(version, s) AS version, max_by(struct_pack(l := label, n := number), s) AS v FROM {_ROWS} GROUP BY run_id, entity, id),
    change AS (SELECT run_id, 'hypotheses' AS entity, h AS id, s, 'number' AS field, NULL AS text, (k + s % 5) / 200.0::DOUBLE AS number FROM e WHERE et = 'BELIEF_UPDATED'
      UNION ALL SELECT run_id, 'experiments', unnest([x, 'x' || (s + 4) % 9]), s, 'status', 'selected', NULL FROM e WHERE et = 'EXPERIMENT_SELECTED'
      UNION ALL SELECT run_id, 'experiments', x, s, 'status', CASE et WHEN 'EXPERIMENT_STARTED' THEN 'running' WHEN 'EXPERIMENT_COMPLETED' THEN 'completed' ELSE 'failed' END, NULL FROM e WHERE et IN ('EXPERIMENT_STARTED', 'EXPERIMENT_COMPLETED', 'EXPERIMENT_FAILED')
      UNION ALL SELECT run_id, 'validation_worlds', unnest(['w0', 'w1']), s, 'number', NULL, unnest([d / 100, 1 - d / 100]) FROM e WHERE et = 'VALIDATION_POSTERIOR_UPDATED'
      UNION ALL SELECT run_id, 'runs', run_id, s, 'phase', CASE et WHEN 'RUN_FINALIZED' THEN 'finalized' ELSE phase END, NULL FROM e WHERE et IN ('PHASE_CHANGED', 'RUN_FINALIZED')
      UNION ALL SELECT run_id, 'runs', run_id, s, 'status', CASE et WHEN 'RUN_FINALIZED' THEN 'completed' WHEN 'VIOLATION_DETECTED' THEN 'blocked' ELSE 'running' END, NULL FROM e WHERE et IN ('RUN_FINALIZED', 'VIOLATION_DETECTED') OR et = 'STATE_CHANGED' AND k % 4 > 1)
    SELECT m.entity, m.id, m.run_id, any_value(m.v.l) AS label, coalesce(arg_max(c.text, c.s) FILTER (c.field = 'status'), 'st' || any_value(m.k) % 4) AS status,
      coalesce(arg_max(c.text, c.s) FILTER (c.field = 'phase'), CASE WHEN any_value(m.k) % 3 > 0 THEN 'exploitation' ELSE 'discovery' END) AS phase, {r6("coalesce(arg_max(c.number, c.s) FILTER (c.field = 'number'), any_value(m.v.n))")} AS number,
      (any_value(m.version) + count(*) FILTER (m.entity = 'validation_worlds' AND c.field = 'number'))::DOUBLE AS version, (1 + count(*) FILTER (m.entity = 'validation_worlds' AND c.field = 'number'))::DOUBLE AS evidence
    FROM made m LEFT JOIN change c ON c.run_id = m.run_id AND c.entity = m.entity AND c.id = m.id AND c.s > m.s GROUP BY m.entity, m.id, m.run_id""",
)
def _(t):
    # Every event arrives twice; the second copy of an id is ignored.
    log = _raw_log(t)
    made = R.entity_tables(log.unionByName(log.withColumn("sequence", F.col("sequence") + 1_000_000)))
    return made.select("entity", "id", "run_id", "label", "status", "phase", rounded("number").alias("number"), "version", "evidence")


@query(
    "str6_query_gate_stream",
    f"WITH {GATE} SELECT run_id, sequence, refusal, refusal IS NULL AS accepted, CASE WHEN refusal IS NULL THEN score >= threshold END AS passed FROM g",
)
def _(t):
    path = scratch_path(t.spark, "gate-queries")
    # The files hold places of every part of a run, so that most queries arrive before their turn.
    rows = _queries(t).withColumn("part", F.col("sequence") * 7 % 4)
    rows.repartition("part").write.partitionBy("part").parquet(path)
    queries = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return gates.run_with_keyed_state(gates.stream_query_gate(queries, "run_id", "sequence", "gated_binary", 10), "query-verdicts").drop("revealed_score")


@query(
    "str1_admission_stream",
    "SELECT user_id % 50 AS run_id, event_id // 3 AS sequence, count(DISTINCT event_type) AS ids, count(DISTINCT event_type) - 1 AS violations FROM events GROUP BY ALL",
)
def _(t):
    events = folds.stream_table(t.spark, t.folder, "events").select(
        (F.col("user_id") % 50).alias("run_id"), F.floor(F.col("event_id") / 3).alias("sequence"), F.col("event_type").alias("event_id")
    )
    made = gates.run_with_keyed_state(gates.stream_admission(events, "run_id", "sequence", "event_id"), "admitted")
    return made.groupBy("run_id", "sequence").agg(F.count(F.lit(1)).alias("ids"), F.count("violation").alias("violations"))
