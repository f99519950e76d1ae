"""Queries for the experiment log, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.functions import scalars as C
from foldwright.operators import runlog as L
from foldwright.plans.fixtures import RUNLOG, rounded
from foldwright.plans.registry import query, r6
from foldwright.session import scratch_path
from foldwright.sources import events as source
from foldwright.streaming import folds as stream


def _envelopes(t):
    """The log with its chain: a row's digest covers its own fields, its link names the row before."""
    from foldwright.operators.ordering import with_neighbours

    log = t.run_log().withColumn("payload", F.to_json(F.struct("k", "value")))
    fields = {f: F.col(f) for f in ("event_id", "event_type", "payload", "run_id", "sequence")}
    hashed = log.withColumn("event_hash", C.canonical_fingerprint(fields))
    return with_neighbours(hashed, ["run_id"], ["sequence"], lambda w: {"previous_hash": F.lag("event_hash").over(w)})


@query(
    "src3_scan_event_logs",
    f"WITH {RUNLOG} SELECT CAST(run_id AS VARCHAR) AS run_id, count(*) AS events, max(sequence) AS last_sequence, CAST(sum(k) AS BIGINT) AS k FROM runlog GROUP BY run_id",
)
def _(t):
    root = scratch_path(t.spark, "runs")
    rows = t.run_log().select(
        F.col("event_id").cast("string").alias("event_id"), "sequence", F.col("run_id").cast("string").alias("run_id"), "event_type",
        F.timestamp_micros("t").alias("occurred_at"), F.to_json(F.struct("k", "value")).alias("payload"), F.lit(1).alias("schema_version"),
        F.lit(None).cast("string").alias("previous_hash"), F.lit("").alias("event_hash"),
    )
    # Spark writes part files into the folder named like the log file; the scan reads them alike.
    for part in ("even", "odd"):
        keep = F.col("run_id").cast("long") % 2 == (0 if part == "even" else 1)
        rows.filter(keep).write.json(f"{root}/{part}/events.jsonl")
    logs = source.scan_event_logs(t.spark, root)
    return logs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("events"), F.max("sequence").alias("last_sequence"),
        F.sum(F.get_json_object("payload", "$.k").cast("long")).alias("k"),
    )


@query(
    "src7_query_ledger",
    """SELECT CAST(user_id % 20 AS VARCHAR) AS run_id, event_type AS query_kind, count(*) AS queries FROM events GROUP BY ALL""",
)
def _(t):
    path = scratch_path(t.spark, "ledger")
    events = t.events
    rows = events.select(
        (F.col("user_id") % 20).cast("string").alias("run_id"), F.lit("a").alias("actor"), F.col("event_type").alias("query_kind"),
        F.col("props").alias("request"), F.lit("binary").alias("response_kind"), F.col("ts").alias("created_at"), "event_id",
    )
    source.append_query_ledger(rows.filter("event_id % 2 = 0"), path)
    source.append_query_ledger(rows.filter("event_id % 2 = 1"), path)
    return source.list_queries(t.spark, path).groupBy("run_id", "query_kind").agg(F.count(F.lit(1)).alias("queries"))


@query(
    "win8_hash_chain_verify",
    f"""WITH {RUNLOG}, b AS (SELECT run_id, sequence, CASE WHEN run_id % 9 = 1 AND sequence = 4 THEN 'digest'
        WHEN run_id % 9 = 2 AND sequence = 6 THEN 'sequence' WHEN run_id % 9 = 3 AND sequence = 7 THEN 'chain' END AS problem FROM runlog)
    SELECT run_id, sequence, problem FROM b WHERE problem IS NOT NULL""",
)
def _(t):
    run, seq = F.col("run_id"), F.col("sequence")
    rows = _envelopes(t).filter(~((run % 9 == 2) & (seq == 5)))
    rows = rows.withColumn("payload", F.when((run % 9 == 1) & (seq == 4), "{}").otherwise(F.col("payload")))
    rows = rows.withColumn("previous_hash", F.when((run % 9 == 3) & (seq == 7), "x").otherwise(F.col("previous_hash")))
    fields = ("event_id", "event_type", "payload", "run_id", "sequence")
    bad = L.hash_chain_violations(rows, "run_id", "sequence", fields, "previous_hash", "event_hash")
    return L.first_violation(bad, "run_id", "sequence")


@query(
    "win9_stagnation_runs",
    f"""WITH {RUNLOG}, s AS (SELECT run_id, sequence, k % 3 AS o, CASE WHEN k % 5 = 0 THEN NULL ELSE value END AS m, k % 2 AS st, k % 4 AS d FROM runlog),
      l AS (SELECT *, lag(o) OVER w AS po, lag(m) OVER w AS pm, lag(st) OVER w AS ps, lag(d) OVER w AS pd, lag(sequence) OVER w AS f FROM s WINDOW w AS (PARTITION BY run_id ORDER BY sequence)),
      c AS (SELECT run_id, sequence, f IS NOT NULL AND o <= po AND st <= ps AND d >= pd AND NOT (CASE WHEN m IS NULL THEN false WHEN pm IS NULL THEN true ELSE m > pm + 1 END) AS stalled FROM l),
      g AS (SELECT *, sum(CAST(NOT stalled AS INT)) OVER (PARTITION BY run_id ORDER BY sequence) AS grp FROM c),
      n AS (SELECT run_id, sequence, stalled, CASE WHEN stalled THEN row_number() OVER (PARTITION BY run_id, grp ORDER BY sequence) - CASE WHEN grp > 0 THEN 1 ELSE 0 END ELSE 0 END AS len FROM g)
    SELECT run_id, sequence, stalled, len AS stagnant_cycles, len >= 2 AS stagnated FROM n""",
)
def _(t):
    k = F.col("k")
    rows = t.run_log().select(
        "run_id", "sequence", (k % 3).alias("occupancy"), F.when(k % 5 != 0, F.col("value")).alias("metric"), (k % 2).alias("structures"), (k % 4).alias("debts")
    )
    return L.stagnation_runs(rows, "run_id", "sequence", 1.0)


@query(
    "win10_collapse_detection",
    f"""WITH {RUNLOG}, s AS (SELECT run_id, sequence, k / 100.0::DOUBLE AS dom, k % 4 AS fam, k % 6 AS occ, value / 80 AS bud, (k * 7 % 100) / 100.0::DOUBLE AS sim FROM runlog),
      l AS (SELECT *, lag(occ) OVER (PARTITION BY run_id ORDER BY sequence) AS po FROM s),
      c AS (SELECT run_id, sequence, list_sort(list_filter_null) AS cond FROM (SELECT run_id, sequence, [x FOR x IN [CASE WHEN dom >= 0.7 THEN 'dominant_cluster_fraction' END, CASE WHEN fam < 2 THEN 'effective_family_count' END,
        CASE WHEN occ <= po THEN 'qd_occupancy_stalled' END, CASE WHEN bud >= 0.5 THEN 'hypothesis_budget_concentration' END, CASE WHEN sim > 0.8 THEN 'mean_agent_similarity' END] IF x IS NOT NULL] AS list_filter_null FROM l)),
      p AS (SELECT *, lag(cond) OVER (PARTITION BY run_id ORDER BY sequence) AS pc FROM c)
    SELECT run_id, sequence, array_to_string(cond, ',') AS conditions, coalesce(len(list_intersect(cond, pc)), 0) >= 2 AS collapsed FROM p""",
)
def _(t):
    k = F.col("k")
    rows = t.run_log().select(
        "run_id", "sequence", (k / 100.0).alias("dominant"), (k % 4).alias("families"), (k % 6).alias("occupancy"),
        (F.col("value") / 80).alias("budget"), ((k * 7 % 100) / 100.0).alias("similarity"),
    )
    return L.collapse_detection(rows, ["run_id"], "sequence").withColumn("conditions", F.array_join("conditions", ","))


@query(
    "win11_lineage_continuity",
    f"""WITH {RUNLOG}, l AS (SELECT *, k % 3 AS lineage, lead(k % 3) OVER (PARTITION BY run_id ORDER BY sequence) AS nxt FROM runlog)
    SELECT run_id, sequence, lineage FROM l WHERE nxt IS NOT NULL AND nxt <> lineage AND NOT (k % 2 = 0 OR event_type = 'error' OR value > 60)""",
)
def _(t):
    rows = t.run_log().select(
        "run_id", "sequence", (F.col("k") % 3).alias("lineage"), (F.col("k") % 2 == 0).alias("closed"),
        (F.col("event_type") == "error").alias("falsified"), (F.col("value") > 60).alias("converted"),
    )
    return L.lineage_violations(rows, "run_id", "sequence")


@query(
    "win12_recent_run_rule",
    f"""WITH {RUNLOG}, l AS (SELECT *, value > 20 AS x, count(*) OVER w AS seen, bool_and(value > 20) OVER w AS same FROM runlog
        WINDOW w AS (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
    SELECT run_id, sequence FROM l WHERE x AND seen = 3 AND same""",
)
def _(t):
    return L.recent_run_violations(t.run_log(), "run_id", "sequence", F.col("value") > 20, 3).select("run_id", "sequence")


@query(
    "win13_last_n_digest",
    f"""WITH {RUNLOG} SELECT run_id, sequence, row_number() OVER (PARTITION BY run_id ORDER BY sequence DESC) AS recency, event_type, k FROM runlog
    QUALIFY recency <= 12""",
)
def _(t):
    return L.last_n(t.run_log(), "run_id", "sequence", 12).select("run_id", "sequence", "recency", "event_type", "k")


@query(
    "str1_event_dedup",
    """SELECT event_id // 3 AS event_id, arg_min(user_id, event_id) AS user_id, arg_min(value, event_id) AS value, min(event_id) AS arrival FROM events GROUP BY 1""",
)
def _(t):
    rows = t.events.select(F.floor(F.col("event_id") / 3).alias("event_id"), F.col("event_id").alias("arrival"), "user_id", "value")
    return L.event_dedup(rows, "event_id", "arrival")


@query("str1_event_dedup_stream", "SELECT count(DISTINCT event_id // 3) AS events, CAST(sum(DISTINCT event_id // 3) AS BIGINT) AS total FROM events")
def _(t):
    events = stream.stream_table(t.spark, t.folder, "events").select(
        F.floor(F.col("event_id") / 3).alias("event_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    done = stream.run_to_completion(stream.stream_event_dedup(events, "event_id", "ts", "60 days"), "dedup")
    return done.agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("total"))


# Entities: hypothesis = k per run; proposals, revisions, belief updates and status changes by type.
PATCH = f"""{RUNLOG}, e AS (SELECT run_id, k AS hypothesis, sequence, value, CASE event_type WHEN 'view' THEN 'PROPOSED' WHEN 'click' THEN 'REVISED' WHEN 'purchase' THEN 'BELIEF' ELSE 'STATUS' END AS et FROM runlog)"""


def _patches(t):
    kind = F.col("event_type")
    return t.run_log().select(
        "run_id", F.col("k").alias("hypothesis"), "sequence", "value",
        F.when(kind == "view", "PROPOSED").when(kind == "click", "REVISED").when(kind == "purchase", "BELIEF").otherwise("STATUS").alias("et"),
    )


@query(
    "str2_entity_projections",
    f"""WITH {PATCH} SELECT run_id, hypothesis, {r6("arg_max(value, sequence) FILTER (et IN ('PROPOSED', 'REVISED', 'BELIEF'))")} AS confidence,
      {r6("arg_max(value, sequence) FILTER (et IN ('PROPOSED', 'REVISED'))")} AS proposed_value, arg_max(et, sequence) FILTER (et IN ('PROPOSED', 'REVISED', 'STATUS')) AS status
    FROM e GROUP BY run_id, hypothesis HAVING bool_or(et IN ('PROPOSED', 'REVISED'))""",
)
def _(t):
    et, value = F.col("et"), F.col("value")
    proposed = et.isin("PROPOSED", "REVISED")
    made = L.latest_fields(
        _patches(t), ["run_id", "hypothesis"], "sequence",
        {"confidence": (proposed | (et == "BELIEF"), value), "proposed_value": (proposed, value), "status": (proposed | (et == "STATUS"), et)},
        proposed,
    )
    return made.select("run_id", "hypothesis", rounded("confidence").alias("confidence"), rounded("proposed_value").alias("proposed_value"), "status")


@query(
    "str2_latest_stream",
    "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id",
)
def _(t):
    events = stream.stream_table(t.spark, t.folder, "events").select("user_id", "event_id", "value")
    return stream.run_to_completion(stream.stream_latest(events, ["user_id"], "event_id", "value"), "latest", ["user_id"])


STATE = f"""{RUNLOG}, s AS (SELECT run_id, sequence, CASE WHEN sequence = 1 THEN 'RUN_CREATED' WHEN k % 25 = 0 THEN 'VIOLATION_DETECTED' WHEN k % 40 = 7 THEN 'RUN_FINALIZED' WHEN event_type = 'view' THEN 'PHASE_CHANGED'
      WHEN event_type = 'click' THEN 'STATE_CHANGED' WHEN k % 6 = 1 THEN 'RESEARCH_BRIEF_CREATED' ELSE 'OTHER' END AS et,
      CASE WHEN k % 3 > 0 THEN 'exploitation' ELSE 'discovery' END AS phase, CASE WHEN sequence = 1 THEN 'created' WHEN k % 4 = 0 THEN 'running' END AS run_status, 'S' || CAST(k % 5 AS VARCHAR) AS loop_state FROM runlog),
    x AS (SELECT *, CASE WHEN et = 'VIOLATION_DETECTED' THEN 'blocked' WHEN et = 'RUN_FINALIZED' THEN 'completed' WHEN et IN ('RUN_CREATED', 'STATE_CHANGED') THEN run_status END AS st,
      CASE WHEN et = 'RUN_FINALIZED' THEN 'finalized' WHEN et IN ('RUN_CREATED', 'PHASE_CHANGED') THEN phase END AS ph FROM s),
    f AS (SELECT run_id, arg_max(st, sequence) FILTER (st IS NOT NULL) AS status, arg_max(ph, sequence) FILTER (ph IS NOT NULL) AS phase, coalesce(arg_max(loop_state, sequence) FILTER (et = 'STATE_CHANGED'), 'created') AS loop_state,
      max(sequence) FILTER (et = 'RESEARCH_BRIEF_CREATED') AS b, max(sequence) FILTER (et = 'PHASE_CHANGED' AND phase <> 'exploitation') AS l, count(*) FILTER (et = 'VIOLATION_DETECTED') AS violations,
      max(sequence) FILTER (et = 'RUN_FINALIZED') AS finalized_at FROM x GROUP BY run_id)
    SELECT run_id, status, phase, loop_state, violations, finalized_at, CASE WHEN l IS NULL OR b > l THEN b END AS brief_sequence FROM f"""


def _typed(log):
    k, kind, seq = F.col("k"), F.col("event_type"), F.col("sequence")
    return log.select(
        "run_id", "sequence",
        F.when(seq == 1, "RUN_CREATED").when(k % 25 == 0, "VIOLATION_DETECTED").when(k % 40 == 7, "RUN_FINALIZED").when(kind == "view", "PHASE_CHANGED")
        .when(kind == "click", "STATE_CHANGED").when(k % 6 == 1, "RESEARCH_BRIEF_CREATED").otherwise("OTHER").alias("event_type"),
        F.when(k % 3 > 0, "exploitation").otherwise("discovery").alias("phase"),
        F.when(seq == 1, "created").when(k % 4 == 0, "running").alias("run_status"),
        F.concat(F.lit("S"), (k % 5).cast("string")).alias("loop_state"),
    )


@query("str3_run_state_fold", f"WITH {STATE}")
def _(t):
    return L.run_state_fold(_typed(t.run_log()), "run_id", "sequence")


@query("str3_run_state_stream", f"WITH {STATE}")
def _(t):
    path = scratch_path(t.spark, "typed-log")
    _typed(t.run_log()).repartition(4).write.parquet(path)
    events = t.spark.readStream.schema(t.spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path)
    return stream.run_to_completion(stream.stream_run_state(events, "run_id", "sequence"), "run-state", ["run_id"])


@query(
    "str3_experiment_statuses",
    f"""WITH {RUNLOG}, s AS (SELECT run_id, k AS experiment, sequence, CASE event_type WHEN 'view' THEN 'EXPERIMENT_PROPOSED' WHEN 'click' THEN 'EXPERIMENT_SELECTED' WHEN 'purchase' THEN 'EXPERIMENT_COMPLETED'
        WHEN 'error' THEN 'EXPERIMENT_FAILED' ELSE 'OTHER' END AS et, CASE WHEN value > 40 THEN 'proposed' ELSE 'draft' END AS status FROM runlog)
    SELECT run_id, experiment, coalesce(arg_max(CASE et WHEN 'EXPERIMENT_SELECTED' THEN 'selected' WHEN 'EXPERIMENT_COMPLETED' THEN 'completed' WHEN 'EXPERIMENT_FAILED' THEN 'failed' END, sequence)
      FILTER (et IN ('EXPERIMENT_SELECTED', 'EXPERIMENT_COMPLETED', 'EXPERIMENT_FAILED')), arg_min(status, sequence) FILTER (et = 'EXPERIMENT_PROPOSED')) AS status FROM s GROUP BY run_id, experiment""",
)
def _(t):
    kind = F.col("event_type")
    rows = t.run_log().select(
        "run_id", F.col("k").alias("experiment"), "sequence",
        F.when(kind == "view", "EXPERIMENT_PROPOSED").when(kind == "click", "EXPERIMENT_SELECTED").when(kind == "purchase", "EXPERIMENT_COMPLETED")
        .when(kind == "error", "EXPERIMENT_FAILED").otherwise("OTHER").alias("event_type"),
        F.when(F.col("value") > 40, "proposed").otherwise("draft").alias("status"),
    )
    return L.experiment_statuses(rows, "run_id", "experiment", "sequence")


# The fold held at zero, step by step, for comparison with the closed form.
USAGE = f"""{RUNLOG}, d AS (SELECT run_id, sequence, CASE WHEN event_type = 'error' THEN -3 * value ELSE value END AS d FROM runlog),
    walk(run_id, sequence, u) AS (SELECT run_id, sequence, greatest(0, d) FROM d WHERE sequence = 1
      UNION ALL SELECT d.run_id, d.sequence, greatest(0, w.u + d.d) FROM walk w JOIN d ON d.run_id = w.run_id AND d.sequence = w.sequence + 1)"""


def _usage(t):
    v = F.col("value")
    return t.run_log().select("run_id", "sequence", F.when(F.col("event_type") == "error", -3 * v).otherwise(v).alias("cpu_hours"))


@query("str4_budget_running_totals", f"WITH RECURSIVE {USAGE} SELECT run_id, sequence, {r6('u')} AS cpu_hours FROM walk")
def _(t):
    return L.budget_running_totals(_usage(t), "run_id", "sequence", ["cpu_hours"]).select("run_id", "sequence", rounded("cpu_hours").alias("cpu_hours"))


@query("str4_budget_stream", f"WITH RECURSIVE {USAGE} SELECT run_id, sequence, {r6('u')} AS cpu_hours FROM walk")
def _(t):
    path = scratch_path(t.spark, "usage")
    # One file per stretch of the log: the stream receives every run in order, batch by batch.
    _usage(t).withColumn("part", F.floor(F.col("sequence") / 40)).repartition("part").write.partitionBy("part").parquet(path)
    usage = t.spark.readStream.schema("run_id long, sequence long, cpu_hours double, part long").parquet(path).drop("part")
    done = stream.run_to_completion(stream.stream_budget_totals(usage, "run_id", "cpu_hours"), "usage-totals")
    return done.select("run_id", "sequence", rounded("cpu_hours").alias("cpu_hours"))


@query(
    "str5_belief_trajectory",
    f"""WITH RECURSIVE {RUNLOG}, d AS (SELECT run_id, sequence, [2.0, 1.0, 0.5, 0.0, -0.5, -1.0, -2.0][k % 7 + 1]::DOUBLE AS w FROM runlog),
      walk(run_id, sequence, l) AS (SELECT run_id, 0::BIGINT, ln(p / (1 - p)) FROM (SELECT DISTINCT run_id, greatest(0.05, least(0.95, run_id / 150.0::DOUBLE)) AS p FROM d)
        UNION ALL SELECT d.run_id, d.sequence, greatest(ln(0.05::DOUBLE / 0.95), least(ln(0.95::DOUBLE / 0.05), w.l + d.w)) FROM walk w JOIN d ON d.run_id = w.run_id AND d.sequence = w.sequence + 1)
    SELECT run_id, sequence, {r6("1 / (1 + exp(-l))")} AS confidence FROM walk WHERE sequence > 0""",
)
def _(t):
    log = t.run_log()
    weights = F.array(*[F.lit(w) for w in (2.0, 1.0, 0.5, 0.0, -0.5, -1.0, -2.0)])
    updates = log.select("run_id", "sequence", F.element_at(weights, (F.col("k") % 7 + 1).cast("int")).alias("w"))
    priors = log.select("run_id", (F.col("run_id") / 150.0).alias("prior")).distinct()
    return L.belief_trajectory(updates, priors, "run_id", "sequence", "w", "prior").select("run_id", "sequence", rounded("confidence").alias("confidence"))


GATE = f"""{RUNLOG}, q AS (SELECT run_id, sequence, value AS score, CASE WHEN k % 10 > 0 THEN 50.0 END AS threshold, k % 4 = 0 AS reveal FROM runlog),
    v AS (SELECT *, CASE WHEN threshold IS NULL THEN 'THRESHOLD_REQUIRED' WHEN reveal THEN 'NUMERIC_SCORE_REQUEST' END AS bad FROM q),
    c AS (SELECT *, coalesce(count(*) FILTER (bad IS NULL) OVER (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM v),
    g AS (SELECT *, CASE WHEN used >= 10 THEN 'QUERY_BUDGET_EXCEEDED' ELSE bad END AS refusal FROM c)"""


def _queries(t):
    k = F.col("k")
    return t.run_log().select(
        "run_id", "sequence", F.col("value").alias("score"), F.when(k % 10 > 0, 50.0).alias("threshold"), (k % 4 == 0).alias("reveal_score")
    )


@query(
    "str6_query_budget_gate",
    f"WITH {GATE} SELECT run_id, sequence, refusal, refusal IS NULL AS accepted, CASE WHEN refusal IS NULL THEN score >= threshold END AS passed FROM g",
)
def _(t):
    return L.query_budget_gate(_queries(t), "run_id", "sequence", "gated_binary", 10).drop("revealed_score")


@query("str6_query_budget_stream", f"WITH {GATE} SELECT run_id, sequence, refusal IS NULL AS accepted FROM g")
def _(t):
    path = scratch_path(t.spark, "queries")
    valid = F.col("threshold").isNotNull() & ~F.col("reveal_score")
    rows = _queries(t).select("run_id", "sequence", valid.alias("valid")).withColumn("part", F.floor(F.col("sequence") / 40))
    rows.repartition("part").write.partitionBy("part").parquet(path)
    queries = t.spark.readStream.schema("run_id long, sequence long, valid boolean, part long").parquet(path).drop("part")
    return stream.run_to_completion(stream.stream_query_budget(queries, "run_id", 10), "query-gate")


@query(
    "str7_token_budget_gate",
    f"""WITH RECURSIVE {RUNLOG}, q AS (SELECT run_id, sequence, event_type AS cluster, k * 10 AS tokens, k % 3 = 0 AS cand FROM runlog),
      walk(run_id, sequence, spent, candspent, clusters, refusal) AS (
        SELECT DISTINCT run_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, map(['click', 'error', 'purchase', 'signup', 'view'], [0, 0, 0, 0, 0]::BIGINT[]), NULL::VARCHAR FROM q
        UNION ALL SELECT run_id, sequence, spent + CASE WHEN r IS NULL THEN tokens ELSE 0 END, candspent + CASE WHEN r IS NULL AND cand THEN tokens ELSE 0 END,
          CASE WHEN r IS NULL THEN map(map_keys(clusters), [CASE WHEN e.key = cluster THEN e.value + tokens ELSE e.value END FOR e IN map_entries(clusters)]) ELSE clusters END, r
        FROM (SELECT q.*, w.spent, w.candspent, w.clusters, CASE WHEN tokens <= 0 OR tokens > 900 THEN 'proposal_limit' WHEN w.clusters[cluster] + tokens > 4000 THEN 'cluster_limit'
          WHEN w.spent + tokens > 12000 THEN 'total_budget' WHEN NOT cand AND 12000 - (w.spent + tokens) < greatest(0, 4200 - w.candspent) THEN 'candidate_reserve' END AS r
          FROM walk w JOIN q ON q.run_id = w.run_id AND q.sequence = w.sequence + 1))
    SELECT nullif(run_id, 3) AS run_id, sequence, refusal FROM walk WHERE sequence > 0""",
)
def _(t):
    run = F.when(F.col("run_id") != 3, F.col("run_id")).alias("run_id")  # requests without a run are a run of their own
    rows = t.run_log().select(run, "sequence", F.col("event_type").alias("cluster"), (F.col("k") * 10).alias("tokens"), (F.col("k") % 3 == 0).alias("candidate"))
    return L.token_budget_gate(rows, "run_id", "sequence", 12_000, 900, 4_000)


NICHES = {"click": 300.0, "error": 200.0, "purchase": 100.0, "signup": 400.0, "view": 250.0}


@query(
    "str8_niche_budget",
    f"""WITH {RUNLOG}, s AS (SELECT run_id, event_type, sequence, sum(value) OVER (PARTITION BY run_id, event_type ORDER BY sequence) AS spent FROM runlog)
    SELECT run_id, event_type, sequence, {r6("spent")} AS spent, spent < CASE event_type {" ".join(f"WHEN '{n}' THEN {v}" for n, v in NICHES.items())} END AS protected FROM s""",
)
def _(t):
    made = L.niche_budget(t.run_log(), NICHES, ["run_id"], "event_type", "sequence", "value")
    return made.withColumn("spent", rounded("spent"))


@query(
    "str9_evidence_routing",
    """WITH e AS (SELECT conv_id, turn, 'A' || CAST(conv_id % 3 AS VARCHAR) AS producer, ['global_safety', 'shared_challenge', 'shareable_fact', 'private'][(conv_id + turn) % 4 + 1] AS vis,
        'A' || CAST(turn % 3 AS VARCHAR) AS target, conv_id % 6 AS created FROM conversations),
      r AS (SELECT e.*, 'A' || CAST(i AS VARCHAR) AS recipient FROM e, range(3) x(i))
    SELECT conv_id, turn, recipient, CASE WHEN recipient <> producer AND vis = 'shared_challenge' THEN 'withheld' ELSE producer END AS shown_producer FROM r
    WHERE recipient = producer OR vis = 'global_safety' OR (vis = 'shared_challenge' AND recipient = target) OR (vis = 'shareable_fact' AND (turn % 5 = 4 OR turn >= created + 3))""",
)
def _(t):
    levels = F.array(*[F.lit(v) for v in ("global_safety", "shared_challenge", "shareable_fact", "private")])
    agent = lambda c: F.concat(F.lit("A"), (c % 3).cast("string"))
    rows = t.conversations.select(
        "conv_id", "turn", agent(F.col("conv_id")).alias("producer"), F.element_at(levels, ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int")).alias("visibility"),
        agent(F.col("turn")).alias("challenge_target"), (F.col("conv_id") % 6).alias("created_cycle"),
    )
    made = L.evidence_routing(rows, ("A0", "A1", "A2"), F.col("turn"), "selective_delayed_asymmetric", 3, F.col("turn") % 5 == 4)
    return made.select("conv_id", "turn", "recipient", "shown_producer")


@query(
    "str10_calibration_prior_shrink",
    f"""WITH r AS (SELECT user_id % 40 AS agent, event_type AS category, pow(0.2 + event_id % 7 / 10.0::DOUBLE - CAST(value > 40 AS INT), 2) AS b FROM events),
      h AS (SELECT p_partkey, p_partkey % 60 AS agent, ['click', 'error', 'none'][p_size % 3 + 1] AS category, p_size / 50.0::DOUBLE AS prior FROM part),
      s AS (SELECT p_partkey, count(b) AS n, avg(b) AS brier FROM h LEFT JOIN r ON r.agent = h.agent OR r.category = h.category GROUP BY p_partkey)
    SELECT p_partkey, n AS records, {r6("CASE WHEN n >= 200 AND brier > 0.29 THEN 0.5 + (prior - 0.5) * 0.6 ELSE prior END")} AS used_prior,
      {r6("CASE WHEN n >= 200 AND brier > 0.29 THEN prior END")} AS original_prior FROM h JOIN s USING (p_partkey)""",
)
def _(t):
    high = 0.2 + (F.col("event_id") % 7) / 10.0
    records = t.events.select(
        (F.col("user_id") % 40).alias("agent"), F.col("event_type").alias("category"),
        F.create_map(F.lit("high"), high, F.lit("low"), 1 - high).alias("probabilities"),
        F.when(F.col("value") > 40, "high").otherwise("low").alias("observed_label"), F.create_map(F.lit("0.5"), F.lit(True)).alias("coverage"),
    )
    kinds = F.array(F.lit("click"), F.lit("error"), F.lit("none"))
    hypotheses = t.part.select(
        "p_partkey", (F.col("p_partkey") % 60).alias("agent"), F.element_at(kinds, F.col("p_size") % 3 + 1).alias("category"), (F.col("p_size") / 50.0).alias("prior")
    )
    made = L.calibration_prior_shrink(hypotheses, records, 200, 0.29, 0.4)
    return made.select("p_partkey", "records", rounded("used_prior").alias("used_prior"), rounded("original_prior").alias("original_prior"))
