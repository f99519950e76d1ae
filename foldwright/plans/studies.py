"""Queries for study scorecards. One run is 200 consecutive events; each event is one evaluated item."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.functions.scalars import canonical_fingerprint
from foldwright.operators import studies as Z
from foldwright.plans.fixtures import rounded
from foldwright.plans.metrics import RANK_AUC
from foldwright.plans.registry import query, r6
from foldwright.plans.resampling import RESAMPLES, boot

FAMILIES = ("click", "error", "purchase", "signup", "view")

PACKS = """packs AS (SELECT event_id // 200 AS run_id, event_id // 200 % 4 AS suite_id, event_id // 200 % 5 AS agent,
    event_id // 200 % 3 AS seed, event_id % 200 AS item, event_id % 200 // 2 AS pair_id, event_id % 2 = 1 AS positive,
    event_id % 4 IN (1, 2) AS utility, CASE WHEN event_id % 10 IN (1, 3) THEN event_id % 200 // 50 END AS ladder,
    event_id % 2 = 1 AND value > 25 AS discovered, event_id % 2 = 0 AND value < 60 AS rejected,
    event_id % 2 = 0 AND value > 80 AS promoted, CASE WHEN value < 5 THEN 'inconclusive' ELSE 'settled' END AS resolution,
    value - 40 AS transfer_gain, value / 300 AS regret, event_type AS family,
    CASE WHEN user_id % 4 = 0 THEN 'exploit' WHEN user_id % 4 = 1 THEN 'epistemic' ELSE 'explore' END AS mode,
    user_id % 6 = 0 AS converted, user_id % 5 = 0 AS followup, user_id % 7 = 0 AS closed,
    (event_id % 9 + 0.5) / 9.0::DOUBLE AS ps, (event_id % 11 + 0.5) / 11.0::DOUBLE AS pe,
    CASE WHEN value > 15 THEN 'evidence' ELSE 'promotion' END AS stage FROM events)"""


def _packs(t):
    key, value, user = F.col("event_id"), F.col("value"), F.col("user_id")
    run, item = F.floor(key / 200), key % 200
    return t.events.select(
        run.alias("run_id"),
        (run % 4).alias("suite_id"),
        (run % 5).alias("agent"),
        (run % 3).alias("seed"),
        item.alias("item"),
        F.floor(item / 2).alias("pair_id"),
        (key % 2 == 1).alias("structure_present"),
        (key % 4).isin(1, 2).alias("predictive_utility"),
        F.when((key % 10).isin(1, 3), F.floor(item / 50)).alias("ladder_level"),
        ((key % 2 == 1) & (value > 25)).alias("discovered"),
        ((key % 2 == 0) & (value < 60)).alias("rejected"),
        ((key % 2 == 0) & (value > 80)).alias("false_promotion"),
        F.when(value < 5, "inconclusive").otherwise("settled").alias("resolution"),
        (value - 40).alias("transfer_gain"),
        (value / 300).alias("regret"),
        F.col("event_type").alias("family"),
        F.when(user % 4 == 0, "exploit").when(user % 4 == 1, "epistemic").otherwise("explore").alias("mode"),
        (user % 6 == 0).alias("converted"),
        (user % 5 == 0).alias("lineage_followup"),
        (user % 7 == 0).alias("lineage_closed"),
        ((key % 9 + 0.5) / 9.0).alias("p_structure"),
        ((key % 11 + 0.5) / 11.0).alias("p_evidence"),
        ((key % 9 + 0.5) / 9.0).alias("p_actionable"),
        ((key % 11 + 0.5) / 11.0).alias("p_transfer"),
        F.when(value > 15, "evidence").otherwise("promotion").alias("failure_stage"),
    )


@query(
    "joi11_alias_resolution",
    """SELECT o_custkey AS run_id, o_orderkey % 50 AS pack_id, o_orderkey AS context_id, o_totalprice AS truth FROM orders
    WHERE o_orderkey % 13 <> 0""",
)
def _(t):
    orders = t.orders
    rows = orders.select(
        F.col("o_custkey").alias("run_id"), F.sha2((F.col("o_orderkey") % 50).cast("string"), 256).alias("opaque_pack"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("opaque_context"),
    )
    aliases = orders.select(
        F.col("o_custkey").alias("run_id"),
        F.sha2((F.col("o_orderkey") % 50).cast("string"), 256).alias("opaque_pack"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("opaque_context"),
        (F.col("o_orderkey") % 50).alias("pack_id"),
        F.col("o_orderkey").alias("context_id"),
    )
    aliases = aliases.filter(F.col("context_id") % 13 != 0)
    truth = orders.select((F.col("o_orderkey") % 50).alias("pack_id"), F.col("o_orderkey").alias("context_id"), F.col("o_totalprice").alias("truth"))
    return Z.alias_resolution(rows, aliases, truth).result.select("run_id", "pack_id", "context_id", "truth")


@query(
    "joi11_alias_violations",
    """WITH o AS (SELECT o_custkey AS run_id, o_orderkey % 10 AS opaque_pack, o_orderkey % 13 <> 0 AS known,
        CASE WHEN o_custkey % 20 = 0 THEN o_orderkey % 20 ELSE o_orderkey % 10 END AS pack FROM orders)
    SELECT DISTINCT run_id, opaque_pack, 'unknown_alias' AS problem FROM o WHERE NOT known
    UNION ALL SELECT run_id, opaque_pack, 'several_packs' FROM o WHERE known GROUP BY run_id, opaque_pack HAVING count(DISTINCT pack) > 1""",
)
def _(t):
    rows = t.orders.select(
        F.col("o_custkey").alias("run_id"), (F.col("o_orderkey") % 10).alias("opaque_pack"), F.col("o_orderkey").alias("opaque_context")
    )
    pack = F.when(F.col("run_id") % 20 == 0, F.col("opaque_context") % 20).otherwise(F.col("opaque_context") % 10)
    aliases = rows.filter(F.col("opaque_context") % 13 != 0).select("*", pack.alias("pack_id"), F.col("opaque_context").alias("context_id"))
    truth = aliases.select("pack_id", "context_id").distinct()
    return Z.alias_resolution(rows, aliases, truth).violations


@query(
    "joi12_matched_negative_gate",
    f"""WITH {PACKS}, n AS (SELECT suite_id, run_id, pair_id, rejected AND NOT promoted AS ok FROM packs WHERE NOT positive),
      g AS (SELECT p.*, positive AND ladder IS NOT NULL AND discovered AND NOT coalesce(ok, false) AS blocked
        FROM packs p LEFT JOIN n USING (suite_id, run_id, pair_id))
    SELECT run_id, item, discovered AND NOT blocked AS discovered, CASE WHEN blocked THEN 'matched_negative' ELSE stage END AS failure_stage FROM g""",
)
def _(t):
    return Z.matched_negative_gate(_packs(t)).select("run_id", "item", "discovered", "failure_stage")


@query(
    "joi13_mechanism_calibration",
    f"""WITH c AS (SELECT p_brand AS g, p_partkey AS component, p_size - 25 AS effect, ['positive', 'negative', 'neutral'][p_partkey % 3 + 1] AS s,
        p_partkey % 20 - 10 AS lo, p_partkey % 20 + 5 AS hi, p_partkey % 4 AS pr, p_size % 4 AS orank,
        string_split(p_name, ' ')[1] = 'red' AS slice, p_partkey % 2 = p_size % 2 AS tr FROM part),
      h AS (SELECT g, count(*) AS components, avg(CAST(s = CASE WHEN effect > 0 THEN 'positive' WHEN effect < 0 THEN 'negative' ELSE 'neutral' END AS INT)) AS a,
        avg(CAST(lo <= effect AND effect <= hi AS INT)) AS b, avg(CAST(pr = orank AS INT)) AS c, avg(CAST(slice AS INT)) AS d, avg(CAST(tr AS INT)) AS e FROM c GROUP BY g)
    SELECT g, components, {r6("a")} AS sign_accuracy, {r6("b")} AS range_accuracy, {r6("c")} AS rank_accuracy, {r6("d")} AS slice_accuracy,
      {r6("e")} AS transfer_accuracy, CASE WHEN a = 1 AND b = 1 AND c = 1 AND d = 1 AND e = 1 THEN 'pass' ELSE 'partial' END AS status FROM h""",
)
def _(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    signs = F.array(F.lit("positive"), F.lit("negative"), F.lit("neutral"))
    predictions = t.part.select(
        F.col("p_brand").alias("g"), key.alias("component"), F.element_at(signs, (key % 3 + 1).cast("int")).alias("expected_sign"),
        (key % 20 - 10).alias("minimum_effect"), (key % 20 + 5).alias("maximum_effect"), (key % 4).alias("predicted_rank"),
        F.array(F.lit("red"), F.lit("other")).alias("predicted_slices"), (key % 2 == 0).alias("predicted_transfer"),
    )
    observations = t.part.select(
        F.col("p_brand").alias("g"), key.alias("component"), (size - 25).alias("effect"), (size % 4).alias("observed_rank"),
        F.slice(F.split("p_name", " "), 1, 1).alias("observed_slices"), (size % 2 == 0).alias("observed_transfer"),
    )
    made = Z.mechanism_calibration(predictions, observations, ["g"]).checked()
    names = ("sign_accuracy", "range_accuracy", "rank_accuracy", "slice_accuracy", "transfer_accuracy")
    return made.select("g", "components", "status", *[rounded(c).alias(c) for c in names])


@query(
    "joi14_decision_audit",
    f"""WITH d AS (SELECT o_orderpriority AS g, o_orderkey % 2 = 0 AS chal, (o_orderkey % 101) / 101.0::DOUBLE AS p, (o_custkey % 103) / 103.0::DOUBLE AS c FROM orders),
      x AS (SELECT g, NOT chal AND c > p AS rej, chal AND c < p AS ado, greatest(p, c) - CASE WHEN chal THEN c ELSE p END AS regret FROM d)
    SELECT g, count(*) AS decisions, {r6("avg(CAST(NOT rej AND NOT ado AS INT))")} AS sign_accuracy, {r6("avg(CAST(rej AS INT))")} AS false_rejection,
      {r6("avg(CAST(ado AS INT))")} AS false_adoption, {r6("avg(regret)")} AS mean_regret, {r6("sum(regret)")} AS total_regret FROM x GROUP BY g""",
)
def _(t):
    key = F.col("o_orderkey")
    locks = t.orders.select(key.alias("decision_id"), F.col("o_orderpriority").alias("g"), F.when(key % 2 == 0, "challenger").otherwise("parent").alias("selected"))
    outcomes = t.orders.select(key.alias("decision_id"), ((key % 101) / 101.0).alias("parent_auc"), ((F.col("o_custkey") % 103) / 103.0).alias("challenger_auc"))
    made = Z.decision_audit(locks, outcomes, ["g"])
    return made.select("g", "decisions", *[rounded(c).alias(c) for c in made.columns[2:]])


@query("joi14_lock_violations", "SELECT o_orderkey FROM orders WHERE o_orderkey % 77 = 5")
def _(t):
    fields = {"key": F.col("key"), "status": F.col("status")}
    locks = t.orders.select("o_orderkey", F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"))
    locks = locks.withColumn("digest", canonical_fingerprint(fields)).withColumn(
        "status", F.when(F.col("o_orderkey") % 77 == 5, "edited").otherwise(F.col("status"))
    )
    return Z.lock_violations(locks, ["key", "status"], "digest").select("o_orderkey")


@query(
    "joi15_ledger_reveal_join",
    """WITH r AS (SELECT event_id AS sequence, CASE WHEN user_id % 2 = 0 THEN 'main' ELSE 'other' END AS competition,
        CASE event_type WHEN 'purchase' THEN 'execute' WHEN 'view' THEN 'score_revealed' ELSE 'dry' END AS mode, event_id % 700 AS score_id,
        value AS local, CASE WHEN event_type = 'view' OR event_id % 9 = 0 THEN value * 2 END AS public FROM events),
      v AS (SELECT score_id, arg_max(public, sequence) AS revealed FROM r WHERE mode = 'score_revealed' GROUP BY score_id)
    SELECT sequence, local AS local_estimate, coalesce(public, revealed) AS public_score FROM r LEFT JOIN v USING (score_id)
    WHERE competition = 'main' AND mode = 'execute'""",
)
def _(t):
    kind, key, value = F.col("event_type"), F.col("event_id"), F.col("value")
    records = t.events.select(
        key.alias("sequence"), F.when(F.col("user_id") % 2 == 0, "main").otherwise("other").alias("competition"),
        F.when(kind == "purchase", "execute").when(kind == "view", "score_revealed").otherwise("dry").alias("mode"),
        (key % 700).alias("score_id"), F.col("props").alias("fingerprint"), value.alias("local_estimate"),
        F.when((kind == "view") | (key % 9 == 0), value * 2).alias("public_score"),
    )
    return Z.ledger_reveal_join(records, "main").drop("fingerprint")


@query(
    "joi20_operator_overlap",
    f"""WITH s AS (SELECT DISTINCT user_id AS a, lower(event_type) || CAST(event_id % 3 AS VARCHAR) AS op FROM events),
      n AS (SELECT a, count(*) AS n FROM s GROUP BY a),
      p AS (SELECT x.a, y.a AS b, x.n AS na, y.n AS nb FROM n x JOIN n y ON x.a < y.a),
      i AS (SELECT x.a, y.a AS b, count(*) AS i FROM s x JOIN s y ON x.op = y.op AND x.a < y.a GROUP BY ALL)
    SELECT (SELECT count(*) FROM n) AS agents, (SELECT max(n) FROM n) AS largest_set,
      {r6("avg(coalesce(i, 0) / CAST(na + nb - coalesce(i, 0) AS DOUBLE))")} AS mean_jaccard FROM p LEFT JOIN i USING (a, b)""",
)
def _(t):
    rows = t.events.select("user_id", F.concat(F.upper("event_type"), (F.col("event_id") % 3).cast("string"), F.lit(" ")).alias("op"))
    return Z.operator_overlap(rows, "user_id", "op").select("agents", "largest_set", rounded("mean_jaccard").alias("mean_jaccard"))


CARD = """card AS (SELECT {keys}, count(*) FILTER (positive) AS positives, count(*) FILTER (NOT positive) AS negatives,
    avg(CAST(discovered AS INT)) FILTER (positive) AS tsdr, avg(CAST(rejected AS INT)) FILTER (NOT positive) AS tsrr,
    avg(CAST(promoted AS INT)) FILTER (NOT positive) AS fspr, avg(CAST(resolution <> 'inconclusive' AS INT)) AS resolution_rate,
    avg(CAST(transfer_gain > 0 AS INT)) FILTER (positive AND discovered AND utility) AS ustr, count(DISTINCT family) AS families,
    count(DISTINCT mode) AS action_types, coalesce(avg(CAST(converted AS INT)) FILTER (mode <> 'exploit'), 0) AS eecr,
    coalesce(avg(CAST(followup OR closed AS INT)) FILTER (mode <> 'exploit'), 0) AS deep_completion, avg(regret) AS mean_regret
    FROM packs GROUP BY {keys})"""


@query(
    "agg25_run_scorecard",
    f"""WITH {PACKS}, {CARD.format(keys="run_id")},
      c AS (SELECT run_id, family, CAST(count(*) AS DOUBLE) AS n FROM packs GROUP BY ALL),
      e AS (SELECT run_id, exp(ln(sum(n)) - sum(n * ln(n)) / sum(n)) AS eff FROM c GROUP BY run_id)
    SELECT run_id, positives, negatives, families, action_types, {", ".join(f"{r6(c)} AS {c}" for c in
      ("tsdr", "tsrr", "fspr", "resolution_rate", "ustr", "eecr", "deep_completion", "mean_regret"))}, {r6("eff")} AS effective_families
    FROM card JOIN e USING (run_id)""",
)
def _(t):
    made = Z.run_scorecard(_packs(t), ["run_id"])
    counts = ("run_id", "positives", "negatives", "families", "action_types")
    return made.select(*counts, *[rounded(c).alias(c) for c in made.columns if c not in counts])


@query(
    "agg25_run_calibrations",
    f"""WITH {PACKS}, l AS (SELECT run_id, 'structure' AS claim, ps AS p, CAST(positive AS INT) AS y FROM packs
        UNION ALL SELECT run_id, 'evidence', pe, CAST(discovered AS INT) FROM packs
        UNION ALL SELECT run_id, 'actionable', ps, CAST(positive AND utility AS INT) FROM packs
        UNION ALL SELECT run_id, 'transfer', pe, CAST(transfer_gain > 0 AS INT) FROM packs),
      b AS (SELECT run_id, claim, abs(sum(p) - sum(y)) AS gap FROM l GROUP BY run_id, claim, least(floor(p * 5), 4)),
      g AS (SELECT run_id, claim, sum(gap) AS gap FROM b GROUP BY ALL)
    SELECT run_id, claim, count(*) AS n, {r6("avg(pow(p - y, 2))")} AS brier, {r6("-avg(y * ln(p) + (1 - y) * ln(1 - p))")} AS log_score,
      {r6("max(gap) / count(*)")} AS ece FROM l JOIN g USING (run_id, claim) GROUP BY run_id, claim""",
)
def _(t):
    made = Z.run_calibrations(_packs(t), ["run_id"])
    return made.select("run_id", "claim", "n", *[rounded(c).alias(c) for c in ("brier", "log_score", "ece")])


BLOCK = """ag AS (SELECT suite_id, seed, item, agent, bool_or(positive) AS positive, bool_or(discovered) AS d, bool_or(rejected AND NOT positive) AS r,
      bool_or(promoted) AS f FROM packs GROUP BY ALL),
    it AS (SELECT suite_id, seed, item, bool_or(positive) AS positive, count(*) FILTER (d) AS nd, count(*) FILTER (r) AS nr, bool_or(f) AS f FROM ag GROUP BY ALL),
    u AS (SELECT suite_id, seed, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n, count(*) FILTER (nd > 0) AS ud,
      count(*) FILTER (nr > 0) AS ur, count(*) FILTER (f) AS uf, count(*) FILTER (positive AND nd = 0) AS missed FROM it GROUP BY ALL),
    x AS (SELECT ag.suite_id, ag.seed, agent, count(*) FILTER (d) AS od, count(*) FILTER (r) AS orr,
      (SELECT count(DISTINCT z.item) FROM ag z WHERE z.suite_id = ag.suite_id AND z.seed = ag.seed AND z.agent <> ag.agent AND z.r) AS without_r
      FROM ag GROUP BY ag.suite_id, ag.seed, agent),
    y AS (SELECT suite_id, seed, max(od) AS bd, max(orr) AS br, min(without_r) AS wr FROM x GROUP BY ALL),
    block AS (SELECT u.suite_id, u.seed, p AS positives, n AS negatives, ud / CAST(p AS DOUBLE) AS union_tsdr, ur / CAST(n AS DOUBLE) AS union_tsrr,
      uf / CAST(n AS DOUBLE) AS union_fspr, missed / CAST(p AS DOUBLE) AS blind_spot, (ud - bd) / CAST(p AS DOUBLE) AS discovery_complementarity,
      (ur - br) / CAST(n AS DOUBLE) AS rejection_complementarity, wr / CAST(n AS DOUBLE) AS leave_one_out_tsrr FROM u JOIN y USING (suite_id, seed))"""
BLOCK_RATES = (
    "union_tsdr", "union_tsrr", "union_fspr", "blind_spot", "discovery_complementarity", "rejection_complementarity", "leave_one_out_tsrr",
)


@query(
    "agg26_population_block",
    f"""WITH {PACKS}, {BLOCK} SELECT suite_id, seed, positives, negatives, {", ".join(f"{r6(c)} AS {c}" for c in BLOCK_RATES)} FROM block""",
)
def _(t):
    made = Z.population_block(_packs(t), ["suite_id", "seed"], "agent", "item")
    return made.select("suite_id", "seed", "positives", "negatives", *[rounded(c).alias(c) for c in BLOCK_RATES])


@query(
    "agg26_marginal_contribution",
    f"""WITH {PACKS}, a AS (SELECT DISTINCT suite_id, seed, agent FROM packs), p AS (SELECT suite_id, seed, count(DISTINCT item) AS p FROM packs WHERE positive GROUP BY ALL)
    SELECT suite_id, seed, a.agent, {r6('''((SELECT count(DISTINCT item) FROM packs q WHERE q.discovered AND q.suite_id = a.suite_id AND q.seed = a.seed)
      - (SELECT count(DISTINCT item) FROM packs q WHERE q.discovered AND q.suite_id = a.suite_id AND q.seed = a.seed AND q.agent <> a.agent)) / CAST(p AS DOUBLE)''')} AS marginal_tsdr
    FROM a JOIN p USING (suite_id, seed)""",
)
def _(t):
    made = Z.marginal_contribution(_packs(t), ["suite_id", "seed"], "agent", "item")
    return made.select("suite_id", "seed", "agent", rounded("marginal_tsdr").alias("marginal_tsdr"))


@query(
    "agg27_population_rollup",
    f"""WITH {PACKS}, {CARD.format(keys="agent")}, {BLOCK}
    SELECT count(*) AS agents, {r6("median(tsdr)")} AS median_tsdr, {r6("median(tsrr)")} AS median_tsrr, {r6("max(fspr)")} AS worst_fspr,
      {r6("median(ustr)")} AS median_ustr, {r6("(SELECT min(leave_one_out_tsrr) FROM block)")} AS minimum_leave_one_out_tsrr,
      {r6("(SELECT avg(blind_spot) FROM block)")} AS mean_blind_spot FROM card""",
)
def _(t):
    packs = _packs(t)
    made = Z.population_rollup(Z.run_scorecard(packs, ["agent"]), Z.population_block(packs, ["suite_id", "seed"], "agent", "item"))
    return made.select("agents", *[rounded(c).alias(c) for c in made.columns if c != "agents"])


@query(
    "agg27_failure_stage_counts",
    f"WITH {PACKS} SELECT stage AS failure_stage, count(*) AS missed FROM packs WHERE positive AND NOT discovered GROUP BY stage",
)
def _(t):
    return Z.failure_stage_counts(_packs(t))


@query(
    "agg27_grid_violations",
    """WITH e AS (SELECT DISTINCT event_id // 200 AS run_id FROM events), a AS (SELECT run_id, count(*) AS n FROM (
        SELECT run_id FROM e WHERE run_id % 7 <> 0 UNION ALL SELECT run_id FROM e WHERE run_id % 7 = 3 UNION ALL SELECT run_id + 100000 FROM e WHERE run_id % 7 = 1) GROUP BY run_id)
    SELECT run_id, CASE WHEN n IS NULL THEN 'missing' WHEN e.run_id IS NULL THEN 'extra' ELSE 'repeated' END AS problem
    FROM e FULL JOIN a USING (run_id) WHERE n IS NULL OR e.run_id IS NULL OR n > 1""",
)
def _(t):
    expected = t.events.select(F.floor(F.col("event_id") / 200).alias("run_id")).distinct()
    run = F.col("run_id")
    actual = expected.filter(run % 7 != 0).unionByName(expected.filter(run % 7 == 3)).unionByName(
        expected.filter(run % 7 == 1).select((run + 100_000).alias("run_id"))
    )
    return Z.grid_violations(expected, actual, ["run_id"])


@query(
    "agg28_arm_summary",
    f"""WITH {PACKS}, {CARD.format(keys="run_id")} SELECT run_id % 3 AS arm, count(*) AS runs, {", ".join(
      f"{r6(f'{fn}({m})')} AS {n}_{m}" for m in ("tsdr", "tsrr", "fspr") for n, fn in (("mean", "avg"), ("median", "median"), ("max", "max")))}
    FROM card GROUP BY 1""",
)
def _(t):
    cards = Z.run_scorecard(_packs(t), ["run_id"]).withColumn("arm", F.col("run_id") % 3)
    made = Z.arm_summary(cards, "arm")
    return made.select("arm", "runs", *[rounded(c).alias(c) for c in made.columns[2:]])


# Scores are means of exact sums: a sum of doubles depends on its order, and equal scores would no longer tie.
ARMS = "arms AS (SELECT ['B', 'BP', 'C'][user_id % 3 + 1] AS arm, user_id // 3 AS seed, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) / count(value) AS score, max(value) AS local FROM events GROUP BY ALL)"


def _arms(t):
    arm = F.element_at(F.array(F.lit("B"), F.lit("BP"), F.lit("C")), (F.col("user_id") % 3 + 1).cast("int"))
    return t.events.groupBy(arm.alias("arm"), F.floor(F.col("user_id") / 3).alias("seed")).agg(
        (F.sum(F.col("value").cast("decimal(18,6)")).cast("double") / F.count("value")).alias("score"), F.max("value").alias("local")
    )


@query(
    "agg29_paired_arm_statistics",
    f"""WITH {ARMS}, d AS (SELECT x.arm AS treatment, y.arm AS comparator, seed, x.score - y.score AS d FROM arms x JOIN arms y USING (seed)
        WHERE (x.arm, y.arm) IN (('C', 'B'), ('C', 'BP'), ('BP', 'B'))),
      s AS (SELECT treatment, comparator, count(*) AS n, avg(d) AS mean, median(d) AS med, avg(CAST(d > 0 AS INT)) AS pos, min(d) AS lo, max(d) AS hi,
        count(*) FILTER (d > 0) AS k, count(*) FILTER (d <> 0) AS m FROM d GROUP BY treatment, comparator),
      {boot("d", "treatment, comparator", "seed", "d", "1.0", RESAMPLES, 0)},
      q AS (SELECT treatment, comparator, {r6("quantile_cont(m, 0.025)")} AS low, {r6("quantile_cont(m, 0.975)")} AS high FROM bm GROUP BY treatment, comparator)
    SELECT treatment, comparator, low, high, n AS seeds, {r6("mean")} AS mean, {r6("med")} AS median, {r6("pos")} AS positive_rate, {r6("lo")} AS worst, {r6("hi")} AS best,
      {r6('''least(1, 2 * list_sum([exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2)) FOR i IN range(least(k, m - k) + 1)]))''')} AS sign_p FROM s JOIN q USING (treatment, comparator)""",
)
def _(t):
    made = Z.paired_arm_statistics(_arms(t), "arm", "seed", "score", [("C", "B"), ("C", "BP"), ("BP", "B")])
    return made.select("treatment", "comparator", "seeds", *[rounded(c).alias(c) for c in made.columns[3:]])


@query(
    "agg29_arm_outcomes",
    f"""WITH {ARMS}, r AS (SELECT arm, score, score = max(score) OVER (PARTITION BY seed) AS won,
        rank() OVER (PARTITION BY arm ORDER BY score) + (count(*) OVER (PARTITION BY arm, score) - 1) / 2.0::DOUBLE AS a,
        rank() OVER (PARTITION BY arm ORDER BY local) + (count(*) OVER (PARTITION BY arm, local) - 1) / 2.0::DOUBLE AS b FROM arms)
    SELECT arm, {r6("avg(score)")} AS mean_score, {r6("median(score)")} AS median_score, {r6("avg(CAST(won AS INT))")} AS win_rate, {r6("corr(a, b)")} AS spearman
    FROM r GROUP BY arm""",
)
def _(t):
    made = Z.arm_outcomes(_arms(t), "arm", "seed", "score", "local")
    return made.select("arm", *[rounded(c).alias(c) for c in made.columns[1:]])


FINDINGS = (("split", ("the", "time split"), 2), ("leak", ("leak", "ing"), 1), ("group", ("entity", "zz"), 1))
FIND_SQL = "((CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'time split') THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), 'leak') OR contains(lower(text), 'ing') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'entity') OR contains(lower(text), 'zz') THEN 1 ELSE 0 END) / 4.0::DOUBLE)"
BENCH_RUNS = f"""runs AS (SELECT lang AS scenario, doc_id // 2 AS replicate, doc_id % 2 AS sys, (doc_id * 37 % 101) / 101.0::DOUBLE AS regret,
    (doc_id * 17 % 89) / 89.0::DOUBLE AS priv, (doc_id * 29 % 97) / 97.0::DOUBLE AS cv, n_chars / 1000.0::DOUBLE + 1 AS cpu, {FIND_SQL} AS disc FROM documents)"""


def _bench_runs(t):
    key = F.col("doc_id")
    return t.documents.select(
        F.col("lang").alias("scenario"), F.floor(key / 2).alias("replicate"), F.when(key % 2 == 0, "base").otherwise("research").alias("system"),
        ((key * 37 % 101) / 101.0).alias("regret"), ((key * 17 % 89) / 89.0).alias("private_score"), ((key * 29 % 97) / 97.0).alias("cv_score"),
        (F.col("n_chars") / 1000.0 + 1).alias("cpu_hours"), Z.discovery_share(F.col("text"), FINDINGS).alias("discovery"),
        (F.col("lang") == "de").alias("negative_control"),
    )


@query(
    "agg31_paired_benchmark_report",
    f"""WITH {BENCH_RUNS}, p AS (SELECT a.scenario, a.regret AS ra, b.regret AS rb, a.priv AS pa, b.priv AS pb, a.cv AS ca, b.cv AS cb, a.cpu AS ua, b.cpu AS ub, a.disc AS da, b.disc AS db
        FROM runs a JOIN runs b ON a.scenario = b.scenario AND a.replicate = b.replicate AND a.sys = 0 AND b.sys = 1)
    SELECT scenario, scenario = 'de' AS negative_control, count(*) AS pairs, {r6("avg(CAST(rb < ra AS INT))")} AS win_rate, {r6("avg(ra)")} AS mean_regret_a, {r6("avg(rb)")} AS mean_regret_b,
      {r6("avg(ub / ua - 1)")} AS mean_overhead, {r6("avg(ca - pa)")} AS mean_gap_a, {r6("avg(cb - pb)")} AS mean_gap_b, {r6("avg(da)")} AS discovery_a, {r6("avg(db)")} AS discovery_b,
      {r6("avg(CASE WHEN ub - ua > 1e-9 THEN (ra - rb) / (ub - ua) END)")} AS regret_removed_per_hour FROM p GROUP BY scenario""",
)
def _(t):
    made = Z.paired_benchmark_report(_bench_runs(t), "base", "research", 2).result
    return made.select("scenario", "negative_control", "pairs", *[rounded(c).alias(c) for c in made.columns[3:]])


@query(
    "agg31_unpaired_runs",
    f"WITH {BENCH_RUNS} SELECT scenario, replicate FROM runs GROUP BY ALL HAVING count(DISTINCT sys) <> 2",
)
def _(t):
    return Z.paired_benchmark_report(_bench_runs(t), "base", "research", 2).violations


@query(
    "agg32_arm_activity_summary",
    f"""WITH e AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'violation' WHEN event_type = 'signup' THEN 'failed' ELSE 'completed' END AS s,
        event_type AS k, event_id % 17 AS lineage, value FROM events)
    SELECT user_id, count(*) FILTER (s = 'completed') AS completed,
      {r6("coalesce(round(count(*) FILTER (s = 'completed' AND k = 'view') / nullif(CAST(count(*) FILTER (s = 'completed') AS DOUBLE), 0), 3), 0)")} AS non_scoring_share,
      {r6("min(value)")} AS best_local_score, count(DISTINCT lineage) FILTER (s = 'completed') AS lineages, count(*) FILTER (s = 'violation') AS violations,
      {r6("round(max(value) - min(value), 4)")} AS gap FROM e GROUP BY user_id""",
)
def _(t):
    kind = F.col("event_type")
    rows = t.events.select(
        "user_id", F.when(kind == "error", "violation").when(kind == "signup", "failed").otherwise("completed").alias("status"),
        kind.alias("kind"), (F.col("event_id") % 17).alias("lineage"), F.col("value").alias("metric"),
    )
    made = Z.arm_activity_summary(rows, "user_id", ["view"], "minimize")
    top = rows.groupBy("user_id").agg(F.max("metric").alias("public"))
    gap = Z.signed_gap(F.col("best_local_score"), F.col("public"), "minimize")
    return made.join(top, "user_id").select(
        "user_id", "completed", "lineages", "violations", rounded("non_scoring_share").alias("non_scoring_share"),
        rounded("best_local_score").alias("best_local_score"), rounded(gap).alias("gap"),
    )


PRE = """pre AS (SELECT l_suppkey % 8 AS pack, l_suppkey % 24 // 8 AS context, CASE WHEN l_orderkey % 10 < 6 THEN 'research' WHEN l_orderkey % 10 < 8 THEN 'confirmation' ELSE 'transfer' END AS segment,
    CAST(l_returnflag = 'R' AS INT) AS y, l_extendedprice AS oracle, CAST(l_partkey % 50 AS DOUBLE) AS control, l_suppkey % 8 < 4 AS s, l_suppkey % 8 IN (0, 1, 4, 5) AS u, (l_suppkey % 24) / 100.0::DOUBLE AS i FROM lineitem)"""


@query(
    "agg38_identifiability_preflight",
    f"""WITH {PRE}, l AS (SELECT *, oracle AS score, 1 AS sg FROM pre UNION ALL SELECT *, control, -1 FROM pre),
      ranked AS (SELECT pack, context, segment, sg, y, rank() OVER (PARTITION BY pack, context, segment, sg ORDER BY score)
        + (count(*) OVER (PARTITION BY pack, context, segment, sg, score) - 1) / 2.0::DOUBLE AS rk FROM l),
      a AS (SELECT pack, context, segment, sg, coalesce({RANK_AUC}, 0.5) AS auc FROM ranked GROUP BY pack, context, segment, sg),
      g AS (SELECT pack, context, segment, sum(sg * auc) AS gain FROM a GROUP BY ALL),
      m AS (SELECT pack, median(gain) FILTER (segment = 'research') AS research, median(gain) FILTER (segment = 'confirmation') AS confirmation, median(gain) FILTER (segment = 'transfer') AS transfer FROM g GROUP BY pack),
      d AS (SELECT pack, bool_or(s) AS s, bool_or(u) AS u, median(i) AS i FROM (SELECT pack, context, bool_or(s) AS s, bool_or(u) AS u, max(i) AS i FROM pre GROUP BY ALL) GROUP BY pack)
    SELECT pack, {r6("research")} AS research, {r6("confirmation")} AS confirmation, {r6("transfer")} AS transfer, {r6("i")} AS independent,
      CASE WHEN s AND u THEN research > 0.02 AND confirmation > 0 AND transfer > 0 AND i > 0.05 WHEN s THEN i > 0.1 AND abs(transfer) < 0.02
        WHEN u THEN abs(i) < 0.05 ELSE abs(research) < 1e-12 AND abs(transfer) < 1e-12 END AS identifiable FROM m JOIN d USING (pack)""",
)
def _(t):
    supp, order = F.col("l_suppkey"), F.col("l_orderkey")
    rows = t.lineitem.select(
        (supp % 8).alias("pack"), F.floor(supp % 24 / 8).alias("context"),
        F.when(order % 10 < 6, "research").when(order % 10 < 8, "confirmation").otherwise("transfer").alias("segment"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_extendedprice").alias("oracle"),
        (F.col("l_partkey") % 50).cast("double").alias("control"), (supp % 8 < 4).alias("structure_present"),
        (supp % 8).isin(0, 1, 4, 5).alias("predictive_utility"), ((supp % 24) / 100.0).alias("independent"),
    )
    made = Z.preflight(rows, "pack", "context", "segment", "y", "oracle", "control")
    return made.select("pack", "identifiable", *[rounded(c).alias(c) for c in ("research", "confirmation", "transfer", "independent")])


@query(
    "agg39_leave_one_context_out",
    f"""WITH c AS (SELECT user_id AS pack, event_id AS context, value - 20 AS v FROM events),
      n AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY v, context) AS r, count(*) OVER (PARTITION BY pack) AS k FROM c),
      o AS (SELECT a.pack, a.context, max(a.k) AS k, median(b.v) AS m FROM n a LEFT JOIN n b ON a.pack = b.pack AND a.r <> b.r GROUP BY a.pack, a.context)
    SELECT pack, max(k) AS contexts, {r6("CASE WHEN max(k) > 1 THEN min(m) END")} AS lowest_median, CASE WHEN max(k) > 1 THEN min(m) > 0 END AS stable FROM o GROUP BY pack""",
)
def _(t):
    rows = t.events.select(F.col("user_id").alias("pack"), F.col("event_id").alias("context"), (F.col("value") - 20).alias("v"))
    made = Z.leave_one_context_out(rows, "pack", "v", ["context"])
    return made.select("pack", "contexts", rounded("lowest_median").alias("lowest_median"), "stable")


@query(
    "agg40_leave_one_seed_out",
    """WITH s AS (SELECT user_id AS family, event_id AS seed, value > CASE WHEN user_id % 2 = 0 THEN 5 ELSE 22 END AS ok, user_id % 2 = 0 AS present FROM events),
      f AS (SELECT family, count(*) AS n, count(*) FILTER (ok) AS k, bool_or(present) AS present FROM s GROUP BY family),
      l AS (SELECT s.family, bool_and((k - CAST(ok AS INT)) / CAST(n - 1 AS DOUBLE) >= 2 / 3.0::DOUBLE) AS every FROM s JOIN f USING (family) WHERE n > 1 GROUP BY s.family)
    SELECT family, n AS seeds, k AS supporting, present AS structure_present, k / CAST(n AS DOUBLE) >= 2 / 3.0::DOUBLE AS full_pass,
      k / CAST(n AS DOUBLE) >= 2 / 3.0::DOUBLE AND coalesce(every, false) AS promoted FROM f LEFT JOIN l USING (family)""",
)
def _(t):
    user = F.col("user_id")
    rows = t.events.select(
        user.alias("family"), F.col("event_id").alias("seed"), (F.col("value") > F.when(user % 2 == 0, 5).otherwise(22)).alias("ok"),
        (user % 2 == 0).alias("structure_present"),
    )
    return Z.leave_one_seed_out(rows, "family", "seed", "ok").result


@query(
    "agg49_failure_funnel",
    f"""WITH {PACKS} SELECT suite_id, CASE WHEN mode = 'exploit' THEN 'hypothesis_generation' WHEN NOT utility THEN 'experiment_design' WHEN regret < 0.02 THEN 'implementation' ELSE stage END AS stage, count(*) AS n
    FROM packs WHERE positive AND NOT discovered GROUP BY ALL""",
)
def _(t):
    stage = Z.adjudicated_stage(F.col("mode") != "exploit", F.col("predictive_utility"), F.col("regret") >= 0.02, F.col("failure_stage"))
    missed = _packs(t).filter(F.col("structure_present") & ~F.col("discovered"))
    return missed.groupBy("suite_id", stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg50_null_provenance_audit",
    """WITH d AS (SELECT user_id AS pack, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS replicate, value AS gain, event_id FROM events),
      r AS (SELECT pack, replicate + CASE WHEN pack % 10 = 3 THEN 1 ELSE 0 END AS replicate, gain + CASE WHEN pack % 10 = 4 AND replicate = 2 THEN 0.1 ELSE 0 END AS gain,
        CASE WHEN pack % 10 = 5 AND replicate = 2 THEN -pack ELSE CASE WHEN pack % 10 = 5 AND replicate = 1 THEN -pack ELSE event_id END END AS h FROM d WHERE NOT (pack % 10 = 6 AND replicate = 1)),
      a AS (SELECT r.pack, count(*) AS n, min(r.replicate) AS lo, max(r.replicate) AS hi, count(DISTINCT r.replicate) AS k,
        count(*) FILTER (coalesce(abs(r.gain - d.gain) > 1e-9, true)) AS off, count(DISTINCT h) AS hs FROM r LEFT JOIN d ON r.pack = d.pack AND r.replicate = d.replicate GROUP BY r.pack),
      z AS (SELECT pack, count(*) AS declared FROM d GROUP BY pack),
      f AS (SELECT z.pack, coalesce(n, 0) AS replicates, concat_ws(',', CASE WHEN coalesce(n, 0) <> declared THEN 'count' END, CASE WHEN lo <> 1 OR hi <> n OR k <> n THEN 'indices' END,
        CASE WHEN off > 0 THEN 'gain' END, CASE WHEN hs <> n THEN 'permutation_hash' END) AS failed FROM z LEFT JOIN a USING (pack))
    SELECT * FROM f WHERE failed <> ''""",
)
def _(t):
    from foldwright.operators.ordering import number_by_key

    declared = number_by_key(t.events.select(F.col("user_id").alias("pack"), "event_id", F.col("value").alias("gain")), ["pack"], ["event_id"], "replicate")
    pack, rep = F.col("pack"), F.col("replicate")
    replicates = declared.filter(~((pack % 10 == 6) & (rep == 1))).select(
        "pack", (rep + F.when(pack % 10 == 3, 1).otherwise(0)).alias("replicate"),
        (F.col("gain") + F.when((pack % 10 == 4) & (rep == 2), 0.1).otherwise(0.0)).alias("gain"),
        F.when((pack % 10 == 5) & (rep <= 2), -pack).otherwise(F.col("event_id")).alias("permutation_hash"),
    )
    made = Z.null_provenance_audit(replicates, declared, "pack", ["permutation_hash"])
    return made.select("pack", "replicates", F.concat_ws(",", "failed").alias("failed"))


@query(
    "agg51_research_state",
    f"""WITH w AS (SELECT user_id AS run_id, value / 100 AS post, CASE WHEN event_id % 2 = 0 THEN 0.5 END AS r, CASE WHEN event_id % 3 = 0 THEN 0.25 END AS f FROM events WHERE event_type = 'view'),
      x AS (SELECT run_id, post, CASE WHEN r IS NULL AND f IS NULL THEN NULL ELSE (coalesce(0.35 * (r + 1) / 2, 0) + coalesce(0.35 * f, 0)) / (CASE WHEN r IS NULL THEN 0 ELSE 0.35 END + CASE WHEN f IS NULL THEN 0 ELSE 0.35 END) END AS v FROM w),
      wf AS (SELECT run_id, sum(post * v) / sum(post) FILTER (v IS NOT NULL) AS fid FROM x GROUP BY run_id),
      h AS (SELECT user_id AS run_id, event_id AS id, ['supported', 'contested', 'retired', 'proposed'][event_id % 4 + 1] AS s, (event_id % 10) / 10.0::DOUBLE AS q, event_id % 6 AS kind, value > 30 AS attacked FROM events WHERE event_type <> 'view'),
      a AS (SELECT run_id, count(*) FILTER (s <> 'retired') AS active, avg(CAST(s IN ('supported', 'contested', 'falsified') AS INT)) AS res,
        sum(CASE WHEN s <> 'retired' AND q > 0 THEN -(q * log2(q) + (1 - q) * log2(1 - q)) ELSE 0 END) AS bits, count(DISTINCT kind) FILTER (s <> 'retired') / 12.0::DOUBLE AS cov,
        coalesce(avg(CAST(attacked AS INT)) FILTER (s <> 'retired'), 0) AS fc FROM h GROUP BY run_id)
    SELECT run_id, active, {r6("res")} AS hypothesis_resolution, {r6("bits")} AS entropy_bits, {r6("cov")} AS hypothesis_coverage, {r6("fc")} AS falsification_coverage,
      {r6("fid")} AS validation_fidelity, {r6("(greatest(0, 0.7 - coalesce(fid, 0)) + greatest(0, 0.8 - res)) / 2")} AS total_gap FROM a LEFT JOIN wf USING (run_id)""",
)
def _(t):
    key, run = F.col("event_id"), F.col("user_id").alias("run_id")
    null = F.lit(None).cast("double")
    worlds = t.events.filter("event_type = 'view'").select(
        run, (F.col("value") / 100).alias("posterior"), F.when(key % 2 == 0, 0.5).alias("rank_stability"),
        F.when(key % 3 == 0, 0.25).alias("pseudo_future"), null.alias("score_variance"), null.alias("leakage_risk"),
    )
    statuses = F.array(*[F.lit(s) for s in ("supported", "contested", "retired", "proposed")])
    hypotheses = t.events.filter("event_type <> 'view'").select(
        run, key.alias("hypothesis_id"), F.element_at(statuses, (key % 4 + 1).cast("int")).alias("status"),
        ((key % 10) / 10.0).alias("confidence"), (key % 6).alias("kind"),
    )
    attacks = t.events.filter("event_type <> 'view' AND value > 30").select(run, key.alias("hypothesis_id"))
    made = Z.research_state(worlds, hypotheses, attacks, {"validation_fidelity": 0.7, "hypothesis_resolution": 0.8}, 12)
    return made.select("run_id", "active", *[rounded(c).alias(c) for c in made.columns[2:]])


OUTCOMES = """out AS (SELECT user_id % 25 AS agent, event_id AS sequence, event_type AS family, event_id AS candidate, value AS local, event_id % 3 = 0 AS improved,
    CASE WHEN event_id % 4 <> 0 THEN value END AS sealed, CASE WHEN event_id % 5 <> 0 THEN value - 3 + event_id % 7 END AS parent, value - 1 AS selected,
    event_id % 6 = 0 AS shadow, event_id % 2 = 0 AS epi, event_id % 9 - 4 AS red, ['a', 'b', 'c', 'd'][event_id % 4 + 1] AS action FROM events)"""


def _outcomes(t):
    key, value = F.col("event_id"), F.col("value")
    return t.events.select(
        (F.col("user_id") % 25).alias("agent"), key.alias("sequence"), F.col("event_type").alias("family"), key.alias("candidate"), value.alias("local"),
        (key % 3 == 0).alias("improved"), F.when(key % 4 != 0, value).alias("sealed"), F.when(key % 5 != 0, value - 3 + key % 7).alias("sealed_parent"),
        (value - 1).alias("selected"), (key % 6 == 0).alias("is_shadow"), (key % 2 == 0).alias("is_epistemic"), (key % 9 - 4).alias("uncertainty_reduction"),
        F.element_at(F.array(*[F.lit(x) for x in "abcd"]), (key % 4 + 1).cast("int")).alias("action"),
    )


@query(
    "agg53_portfolio_scorecard",
    f"""WITH {OUTCOMES}, c AS (SELECT agent, family, CAST(count(*) AS DOUBLE) AS n FROM out GROUP BY ALL), e AS (SELECT agent, exp(ln(sum(n)) - sum(n * ln(n)) / sum(n)) AS eff FROM c GROUP BY agent),
      b AS (SELECT agent, candidate FROM out QUALIFY row_number() OVER (PARTITION BY agent ORDER BY local DESC, sequence) = 1),
      l AS (SELECT agent, selected FROM out WHERE sealed IS NOT NULL AND parent IS NOT NULL QUALIFY row_number() OVER (PARTITION BY agent ORDER BY sequence DESC) = 1),
      a AS (SELECT agent, count(*) AS outcomes, count(DISTINCT family) AS families, count(*) FILTER (improved) AS improvements, max(greatest(sealed, parent)) FILTER (sealed IS NOT NULL AND parent IS NOT NULL) AS oracle,
        avg(CAST(sealed > parent AS INT)) FILTER (sealed IS NOT NULL AND parent IS NOT NULL AND shadow) AS rec, count(*) FILTER (red > 0 AND epi) AS tests FROM out GROUP BY agent)
    SELECT agent, outcomes, families, improvements, b.candidate AS best_local, tests AS falsification_tests, {r6("eff")} AS effective_count, {r6("1 - families / CAST(outcomes AS DOUBLE)")} AS repeat_rate,
      {r6("oracle - selected")} AS regret, {r6("rec")} AS shadow_recovery, families >= 2 OR tests >= 2 AS qualifies FROM a JOIN e USING (agent) JOIN b USING (agent) LEFT JOIN l USING (agent)""",
)
def _(t):
    made = Z.portfolio_scorecard(_outcomes(t), "agent")
    plain = ("agent", "outcomes", "families", "improvements", "best_local", "falsification_tests", "qualifies")
    return made.select(*plain, *[rounded(c).alias(c) for c in ("effective_count", "repeat_rate", "regret", "shadow_recovery")])


@query(
    "agg53_population_portfolio",
    f"""WITH {OUTCOMES}, c AS (SELECT family, CAST(count(*) AS DOUBLE) AS n FROM out GROUP BY ALL), e AS (SELECT exp(ln(sum(n)) - sum(n * ln(n)) / sum(n)) AS eff, max(n) / sum(n) AS dom FROM c),
      x AS (SELECT count(*) AS k, max(n) / sum(n) AS dom FROM (SELECT action, CAST(count(*) AS DOUBLE) AS n FROM out GROUP BY action)),
      a AS (SELECT agent, count(DISTINCT family) >= 2 OR count(*) FILTER (red > 0 AND epi) >= 2 AS q FROM out GROUP BY agent),
      s AS (SELECT count(*) FILTER (q) AS q, avg(CAST(q AS INT)) AS d FROM a)
    SELECT s.q AS qualifying, {r6("s.d")} AS independent_diversity, {r6("eff")} AS effective_count, {r6("e.dom")} AS dominant_share, x.k AS action_types, {r6("x.dom")} AS dominant_action,
      s.q >= 2 AND eff >= 2.5 AND e.dom <= 0.6 AS diversity_gate, x.k >= 3 AND x.dom <= 0.7 AS action_gate FROM s, e, x""",
)
def _(t):
    outcomes = _outcomes(t)
    made = Z.population_portfolio(outcomes, Z.portfolio_scorecard(outcomes, "agent"))
    doubles = ("independent_diversity", "effective_count", "dominant_share", "dominant_action")
    return made.select("qualifying", "action_types", "diversity_gate", "action_gate", *[rounded(c).alias(c) for c in doubles])


@query(
    "agg55_run_event_report",
    """SELECT user_id AS run_id, count(*) AS events, """
    + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in FAMILIES)
    + """, max(s) AS last_sequence, arg_max(event_type, s) AS last_event_type
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events) GROUP BY user_id""",
)
def _(t):
    return Z.run_event_report(t.run_log(), "run_id", FAMILIES)


@query(
    "agg56_submission_diagnostics",
    f"""WITH ranked AS (SELECT user_id % 10 AS run, CAST(event_type IN ('error', 'view') AS BIGINT) AS y, rank() OVER (PARTITION BY user_id % 10 ORDER BY value)
        + (count(*) OVER (PARTITION BY user_id % 10, value) - 1) / 2.0::DOUBLE AS rk FROM events),
      a AS (SELECT run, count(*) AS n, {RANK_AUC} AS auc FROM ranked GROUP BY run),
      c AS (SELECT user_id % 10 AS run, count(*) AS calls, median(value / 500) AS m, arg_max(value, event_id) > arg_min(value, event_id) AS up FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT run, n, {r6("coalesce(auc, 0.5)")} AS auc, coalesce(auc, 0.5) > 0.5 AS beats_baseline, coalesce(calls, 0) AS calls, {r6("m")} AS median_call_auc, CASE WHEN calls >= 2 THEN up END AS trajectory_improved
    FROM a LEFT JOIN c USING (run)""",
)
def _(t):
    run = (F.col("user_id") % 10).alias("run")
    predictions = t.events.select(run, F.col("event_id").alias("row"), F.col("value").alias("prediction"))
    labels = t.events.select(F.col("event_id").alias("row"), F.col("event_type").isin("error", "view").cast("int").alias("target"))
    calls = t.events.filter("event_type = 'view'").select(run, F.col("event_id").alias("call_index"), (F.col("value") / 500).alias("call_auc"))
    made = Z.submission_diagnostics(predictions, labels, calls, "run", "row", 0.5)
    return made.select("run", "n", "beats_baseline", "calls", "trajectory_improved", rounded("auc").alias("auc"), rounded("median_call_auc").alias("median_call_auc"))
