"""Queries for bootstraps, matched nulls and gates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from foldwright.operators import rates as R
from foldwright.operators import resample as B
from foldwright.plans.fixtures import TASKS, rounded
from foldwright.plans.folds import HASH
from foldwright.plans.metrics import RANK_AUC
from foldwright.plans.registry import query, r6

# Resamples of the intervals, and of the lower bounds and gates.
RESAMPLES = 10_000
REPETITIONS = 2_000


def _vectors(t):
    return R.metric_vectors(t.task_scores(), "quantity")


DIFFERENCES = f"""{TASKS}, d AS (SELECT x.candidate_id AS left_id, y.candidate_id AS right_id, task_id, y.quantity - x.quantity AS d
    FROM tasks x JOIN tasks y USING (task_id) WHERE x.candidate_id < y.candidate_id)"""


def boot(source: str, keys: str, order: str, s: str, c: str, reps: int, seed: int) -> str:
    """CTEs indexing parts 1..n per key and drawing n of them per replicate by hash."""
    return f"""ix AS (SELECT {keys}, {s} AS s, {c} AS c, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS i,
        count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
      dr AS (SELECT n, rep, {HASH.format(f"'{seed}:' || rep || ':' || i")} % n + 1 AS j FROM (SELECT DISTINCT n, i FROM ix), range(1, {reps + 1}) r(rep)),
      bm AS (SELECT {keys}, rep, sum(s) / sum(c) AS m FROM dr JOIN ix ON dr.n = ix.n AND dr.j = ix.i GROUP BY {keys}, rep)"""


@query("joi3_paired_differences", f"WITH {DIFFERENCES} SELECT left_id, right_id, task_id, {r6('d')} AS difference FROM d")
def _(t):
    made = B.paired_differences(_vectors(t), "candidate_id", "task_id", "value", "minimize")
    return made.select("left_id", "right_id", "task_id", rounded("difference").alias("difference"))


INTERVALS = f"""{DIFFERENCES}, {boot("d", "left_id, right_id", "task_id", "d", "1.0", RESAMPLES, 5)},
    q AS (SELECT left_id, right_id, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY ALL),
    a AS (SELECT left_id, right_id, count(*) AS n, avg(d) AS mean FROM d GROUP BY ALL)"""


@query(
    "res1_paired_bootstrap_interval",
    f"""WITH {INTERVALS} SELECT left_id, right_id, n, {r6("mean")} AS mean, {r6("least(lo, mean - 1.959963984540054 * 3 / sqrt(n))")} AS low,
      {r6("greatest(hi, mean + 1.959963984540054 * 3 / sqrt(n))")} AS high FROM a JOIN q USING (left_id, right_id)""",
)
def _(t):
    rows = B.paired_differences(_vectors(t), "candidate_id", "task_id", "value", "minimize")
    made = B.paired_bootstrap_interval(rows, ["left_id", "right_id"], "task_id", "difference", RESAMPLES, 0.95, 5, 3.0)
    return made.select("left_id", "right_id", "n", *[rounded(c).alias(c) for c in ("mean", "low", "high")])


@query(
    "res2_block_bootstrap_lower_bound",
    f"""WITH {DIFFERENCES}, {boot("d", "left_id, right_id", "task_id", "d", "1.0", REPETITIONS, 42)},
      o AS (SELECT left_id, right_id, m, row_number() OVER (PARTITION BY left_id, right_id ORDER BY m) AS k FROM bm)
    SELECT left_id, right_id, {r6("m")} AS lower FROM o WHERE k = {math.ceil((1 - 0.95) * REPETITIONS)}""",
)
def _(t):
    rows = B.paired_differences(_vectors(t), "candidate_id", "task_id", "value", "minimize")
    made = B.block_bootstrap_lower_bound(rows, ["left_id", "right_id"], "task_id", "difference", 0.95, REPETITIONS)
    return made.select("left_id", "right_id", rounded("lower").alias("lower"))


@query(
    "res3_cluster_bootstrap",
    f"""WITH b AS (SELECT event_type AS g, user_id AS blk, CAST(count(*) FILTER (value > 40) AS DOUBLE) AS s, count(*) AS c FROM events GROUP BY ALL),
      {boot("b", "g", "CAST(blk AS VARCHAR)", "s", "c", RESAMPLES, 38)},
      o AS (SELECT g, m, row_number() OVER (PARTITION BY g ORDER BY m) AS k FROM bm),
      e AS (SELECT g, count(*) AS blocks, sum(s) / sum(c) AS est FROM b GROUP BY g),
      w AS (SELECT g, max(m) FILTER (k = {int(0.025 * RESAMPLES)}) AS lo, max(m) FILTER (k = {int(0.975 * RESAMPLES) + 1}) AS hi FROM o GROUP BY g)
    SELECT g, blocks, {r6("est")} AS estimate, {r6("least(lo, est)")} AS lower, {r6("greatest(hi, est)")} AS upper FROM e JOIN w USING (g)""",
)
def _(t):
    rows = t.events.select(F.col("event_type").alias("g"), F.col("user_id").cast("string").alias("blk"), (F.col("value") > 40).alias("flag"))
    made = B.cluster_bootstrap(rows, ["g"], ["blk"], "flag", RESAMPLES)
    return made.select("g", "blocks", *[rounded(c).alias(c) for c in ("estimate", "lower", "upper")])


def _strata(t):
    return t.events.select("event_id", "user_id", F.dayofmonth("ts").alias("day"), (F.col("event_id") % 3).alias("miss"), (F.col("user_id") % 2).alias("known"))


BAND = """sz AS (SELECT user_id, CASE WHEN count(*) <= 1 THEN count(*) WHEN count(*) <= 5 THEN 2 WHEN count(*) <= 20 THEN 6 ELSE 21 END AS band FROM events GROUP BY user_id),
    st AS (SELECT event_id, e.user_id, band, {bin} AS bin, {rest} AS rest, ts, event_type, value FROM events e JOIN sz USING (user_id))"""


def shuffled(reps: int, seed: int, binning: str, rest: str) -> str:
    return f"""{BAND.format(bin=binning, rest=rest)},
      rp AS (SELECT st.*, rep FROM st, range(1, {reps + 1}) r(rep)),
      sl AS (SELECT *, row_number() OVER (PARTITION BY rep, band, bin, rest ORDER BY event_id) AS slot,
        row_number() OVER (PARTITION BY rep, band, bin, rest ORDER BY {HASH.format(f"'{seed}:' || rep || ':' || event_id")}, event_id) AS draw FROM rp),
      sh AS (SELECT a.rep, a.event_id, a.user_id, a.bin, a.event_type, a.value, b.user_id AS shuffled FROM sl a JOIN sl b
        ON a.rep = b.rep AND a.band = b.band AND a.bin = b.bin AND a.rest = b.rest AND a.slot = b.draw)"""


@query(
    "res4_matched_null_shuffle",
    f"WITH {shuffled(2, 11, 'day(ts)', 'event_id % 3 * 10 + user_id % 2')} SELECT rep, event_id, shuffled FROM sh",
)
def _(t):
    made = B.matched_null_shuffle(_strata(t), "user_id", "event_id", "day", ["miss", "known"], 11, 2)
    return made.select(F.col("rep").cast("long").alias("rep"), "event_id", "shuffled")


@query("res5_linkage_shuffle", f"WITH {shuffled(1, 12, 'day(ts)', '0')} SELECT event_id, shuffled FROM sh")
def _(t):
    return B.matched_null_shuffle(_strata(t), "user_id", "event_id", "day", (), 12).select("event_id", "shuffled")


@query(
    "res6_target_permutation",
    f"""WITH s AS (SELECT o_orderstatus AS seg, o_orderkey, o_custkey % 2 AS y, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS slot,
        row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASH.format("'9:1:' || o_orderkey")}, o_orderkey) AS draw FROM orders)
    SELECT a.o_orderkey, b.y AS permuted FROM s a JOIN s b ON a.seg = b.seg AND a.slot = b.draw""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 2).alias("y"))
    return B.target_permutation(rows, "o_orderstatus", "o_orderkey", "y", 9).select("o_orderkey", "permuted")


@query(
    "res7_context_shuffle",
    f"""WITH s AS (SELECT o_orderkey, o_custkey % 4 AS pat, CASE WHEN o_custkey % 4 NOT IN (1, 3) THEN o_totalprice END AS ma, row_number() OVER (ORDER BY o_orderkey) AS slot,
        row_number() OVER (ORDER BY {HASH.format("'4:1:' || o_orderkey")}, o_orderkey) AS draw FROM orders)
    SELECT a.o_orderkey, b.pat AS pattern, CASE WHEN b.pat IN (1, 3) THEN NULL ELSE coalesce(a.ma, 0) END AS measure FROM s a JOIN s b ON a.slot = b.draw""",
)
def _(t):
    pattern = F.col("o_custkey") % 4
    rows = t.orders.select("o_orderkey", pattern.alias("pattern"), F.when(~pattern.isin(1, 3), F.col("o_totalprice")).alias("measure"))
    return B.context_shuffle(rows, "o_orderkey", "pattern", 4, [("measure", (1, 3))]).select("o_orderkey", "pattern", "measure")


# A planted link: the target follows the entity (user % 5), so shuffling the entity must lose it.
LINK_REPS = 20
LINK = f"""{shuffled(LINK_REPS, 42, 'day(ts)', 'event_id % 3')},
    al AS (SELECT 0 AS rep, event_id, day(ts) AS bin, user_id AS ent, CAST(user_id % 5 = 0 AS INT) AS y, user_id % 7 AS dev FROM events
      UNION ALL SELECT rep, event_id, bin, shuffled, CAST(user_id % 5 = 0 AS INT), user_id % 7 FROM sh),
    rt AS (SELECT rep, bin, y, (coalesce(sum(y) OVER w, 0) + 1) / (count(*) OVER w + 2)::DOUBLE AS p FROM al
      WINDOW w AS (PARTITION BY rep, ent ORDER BY bin, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    ranked AS (SELECT rep, y, rank() OVER (PARTITION BY rep ORDER BY p) + (count(*) OVER (PARTITION BY rep, p) - 1) / 2.0::DOUBLE AS rk FROM rt WHERE bin >= 8),
    au AS (SELECT rep, {RANK_AUC} AS auc FROM ranked GROUP BY rep),
    ce AS (SELECT rep, ent, dev, count(*) AS n, count(*) FILTER (bin < 10) AS e, count(*) FILTER (bin >= 20) AS l FROM al GROUP BY ALL),
    en AS (SELECT rep, ent, max(n) AS top, sum(n) AS n, sum(e) AS e, sum(l) AS l FROM ce GROUP BY ALL),
    sp AS (SELECT rep, sum(top) / sum(n) AS agreement, count(*) FILTER (e > 0 AND l > 0) / CAST(count(*) FILTER (e > 0) AS DOUBLE) AS persistence FROM en GROUP BY rep)"""


def _link(t):
    rows = t.events.select(
        "event_id", "user_id", F.dayofmonth("ts").alias("day"), (F.col("event_id") % 3).alias("miss"),
        (F.col("user_id") % 5 == 0).cast("int").alias("y"), (F.col("user_id") % 7).alias("dev"),
    )
    return B.matched_null_statistics(rows, "user_id", "event_id", "day", "y", "dev", ["miss"], 8, 10, 20, 42, LINK_REPS)


@query(
    "res8_matched_null_statistics",
    f"""WITH {LINK} SELECT rep, {r6("auc")} AS auc, {r6("agreement")} AS agreement, {r6("persistence")} AS persistence FROM au JOIN sp USING (rep)""",
)
def _(t):
    made = _link(t)
    return made.select(F.col("rep").cast("long").alias("rep"), *[rounded(c).alias(c) for c in ("auc", "agreement", "persistence")])


@query(
    "res8_matched_null_test",
    f"""WITH {LINK}, j AS (SELECT * FROM au JOIN sp USING (rep)), r AS (SELECT * FROM j WHERE rep = 0), o AS (SELECT *, row_number() OVER (ORDER BY auc) AS k FROM j WHERE rep > 0)
    SELECT {r6("r.auc")} AS real_auc, {r6(f"(SELECT auc FROM o WHERE k = {-(-95 * LINK_REPS // 100)})")} AS null_bound, (SELECT count(*) FROM o WHERE o.auc >= r.auc) AS exceedances,
      (SELECT count(*) FROM o) AS nulls, {r6("r.agreement - (SELECT avg(agreement) FROM o)")} AS agreement_gain, {r6("r.persistence - (SELECT avg(persistence) FROM o)")} AS persistence_gain,
      r.auc > (SELECT auc FROM o WHERE k = {-(-95 * LINK_REPS // 100)}) AS rejects_null FROM r""",
)
def _(t):
    made = B.matched_null_test(_link(t))
    doubles = ("real_auc", "null_bound", "agreement_gain", "persistence_gain")
    return made.select("exceedances", "nulls", "rejects_null", *[rounded(c).alias(c) for c in doubles])


def _evidence(t):
    """One hypothesis per part: gains come from its columns; arrays hold a few blocks."""
    key, size = F.col("p_partkey"), F.col("p_size")
    g = (size - 15) / 100.0
    few = lambda a, b, c: F.array(g + a, g + b, g + c)
    return t.part.select(
        key.alias("id"), F.lit(0.5).alias("m0"), (0.5 + (key % 7) / 100.0).alias("m1"), (0.5 + (key % 5) / 100.0).alias("m2"),
        (0.5 + g).alias("m3"), (0.5 + (key % 3) / 100.0).alias("m4"),
        few(0.01, 0.02, 0.03).alias("uid_free"), few(0.0, 0.02, 0.04).alias("identity"), few(-0.01, 0.02, 0.05).alias("linkage"),
        few(-0.1, -0.1, -0.1).alias("construct"), few(0.0, 0.0, 0.01).alias("persistence"), few(0.01, 0.0, 0.02).alias("horizons"),
        few(0.01, 0.01, 0.02).alias("seeds"), F.array((key % 11) / 50.0, (key % 13) / 60.0).alias("null_gains"),
        F.array((key % 17) / 90.0, (key % 4) / 40.0).alias("null_interactions"), g.alias("known_gain"), F.lit(0.0).alias("new_gain"),
        (key % 9 != 0).alias("fold_safe"), (key % 8 != 0).alias("adopted"), (key % 2 == 0).alias("executed"), (key % 3 == 0).alias("coded"), (key % 5 != 0).alias("stated"),
    )


LOW = f"""(SELECT m FROM (SELECT rep, sum(v) / 3 AS m FROM (SELECT rep, [{{0}}][CAST({HASH.format("'42:' || rep || ':' || slot")} % 3 + 1 AS INT)] AS v
    FROM range(1, {REPETITIONS + 1}) a(rep), range(1, 4) b(slot)) GROUP BY rep) ORDER BY m LIMIT 1 OFFSET {math.ceil((1 - 0.95) * REPETITIONS) - 1})"""
# The resample positions do not depend on the row, so the bound of (g+a, g+b, g+c) is g plus that of (a, b, c).


@query(
    "res9_structure_gates",
    f"""WITH k AS (SELECT {LOW.format("0.01, 0.02, 0.03")} AS lu, {LOW.format("0.0, 0.02, 0.04")} AS li, {LOW.format("-0.01, 0.02, 0.05")} AS ll, {LOW.format("0.0, 0.0, 0.01")} AS lp),
      e AS (SELECT p_partkey AS id, (p_size - 15) / 100.0::DOUBLE AS g, p_partkey AS p FROM part),
      x AS (SELECT id, p, g, p % 9 <> 0 AS g1, 0.5 + g > 0.5 + (p % 7) / 100.0::DOUBLE AND g + lu > 1e-12 AS g2, 0.5 + g - (0.5 + (p % 5) / 100.0::DOUBLE) > 1e-12 AND g + li > 1e-12 AS g3,
        0.5 + g - (0.5 + (p % 5) / 100.0::DOUBLE) > greatest((p % 11) / 50.0::DOUBLE, (p % 13) / 60.0::DOUBLE) AS g4, 0.5 + g - (0.5 + (p % 3) / 100.0::DOUBLE) > 1e-12 AND g + ll > 1e-12 AS g5,
        g - 0.1 > 1e-12 OR g + lp > 1e-12 AS g6, g >= 0 AS g7, g > 0 AND g > greatest((p % 17) / 90.0::DOUBLE, (p % 4) / 40.0::DOUBLE) AS g8, p % 8 <> 0 AS g9 FROM e, k)
    SELECT id, g1 AND g2 AND g3 AND g4 AND g5 AND g6 AND g7 AND g8 AND g9 AS structural, g2, g4, g6, g7, g8, g > 0 AS predictive,
      CASE WHEN g1 AND g2 AND g3 AND g4 AND g5 AND g6 AND g7 AND g8 AND g9 AND g > 0 THEN 1.0 WHEN g2 OR g4 THEN 0.75 WHEN p % 2 = 0 THEN 0.5 WHEN p % 3 = 0 OR p % 5 <> 0 THEN 0.25 ELSE 0.0 END::DOUBLE AS acceptance_level FROM x""",
)
def _(t):
    made = B.structure_gates(_evidence(t), repetitions=REPETITIONS)
    g = B.GATES
    return made.select(
        "id", "structural", F.col(g[1]).alias("g2"), F.col(g[3]).alias("g4"), F.col(g[5]).alias("g6"), F.col(g[6]).alias("g7"),
        F.col(g[7]).alias("g8"), "predictive", "acceptance_level",
    )


@query(
    "res10_sequential_futility",
    f"""WITH n AS (SELECT user_id, event_id, count(*) OVER w AS n, count(*) FILTER (value >= 100) OVER w AS e FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
      p AS (SELECT *, 1 - list_sum([exp(lgamma(n + 2) - lgamma(i + 1) - lgamma(n + 2 - i) + i * ln(0.05) + (n + 1 - i) * ln(0.95)) FOR i IN range(e + 1)]) AS p FROM n)
    SELECT event_id, n AS repetitions, e AS exceedances, {r6("p")} AS probability, n >= 5 AND p < 0.05 AS stop FROM p""",
)
def _(t):
    rows = t.events.select("event_id", "user_id", F.col("value").alias("gain"), F.lit(100.0).alias("real"))
    made = B.sequential_futility(rows, "user_id", "event_id", "gain", "real")
    return made.select("event_id", "repetitions", "exceedances", rounded("probability").alias("probability"), "stop")


@query(
    "res11_compare_pairs",
    f"""WITH {INTERVALS} SELECT left_id, right_id, n AS tasks, {r6("mean")} AS mean, {r6("lo")} AS low, {r6("hi")} AS high, {r6("(hi - lo) / 2")} AS measured_half_width,
      {r6("32 / sqrt(n)")} AS planned_half_width, NOT (lo <= 0 AND hi >= 0) AS separated, CASE WHEN NOT (lo <= 0 AND hi >= 0) THEN CASE WHEN mean > 0 THEN left_id ELSE right_id END END AS better
    FROM a JOIN q USING (left_id, right_id)""",
)
def _(t):
    made = B.compare_pairs(_vectors(t), "candidate_id", "task_id", "value", "minimize", RESAMPLES, 0.95, 5)
    doubles = ("mean", "low", "high", "measured_half_width", "planned_half_width")
    return made.select("left_id", "right_id", "tasks", "separated", "better", *[rounded(c).alias(c) for c in doubles])


@query(
    "res12_gated_ranking",
    f"""WITH RECURSIVE {INTERVALS}, v AS (SELECT left_id AS x, right_id AS y, NOT (lo <= 0 AND hi >= 0) AS sep FROM q UNION ALL SELECT right_id, left_id, NOT (lo <= 0 AND hi >= 0) FROM q),
      m AS (SELECT candidate_id, avg(-quantity) AS mean, row_number() OVER (ORDER BY avg(-quantity) DESC, candidate_id) AS i FROM tasks GROUP BY candidate_id),
      walk(i, candidate_id, tier, members) AS (SELECT i, candidate_id, 1::BIGINT, [candidate_id] FROM m WHERE i = 1
        UNION ALL SELECT m.i, m.candidate_id, CASE WHEN (SELECT bool_and(sep) FROM v WHERE v.x = m.candidate_id AND list_contains(w.members, v.y)) THEN tier + 1 ELSE tier END,
          CASE WHEN (SELECT bool_and(sep) FROM v WHERE v.x = m.candidate_id AND list_contains(w.members, v.y)) THEN [m.candidate_id] ELSE list_append(w.members, m.candidate_id) END
        FROM walk w JOIN m ON m.i = w.i + 1)
    SELECT candidate_id, tier, count(*) OVER (PARTITION BY tier) AS tier_size, {r6("mean")} AS mean FROM walk JOIN m USING (candidate_id)""",
)
def _(t):
    made = B.gated_ranking(_vectors(t), "candidate_id", "task_id", "value", "minimize", resamples=RESAMPLES, seed=5)
    return made.select("candidate_id", "tier", "tier_size", rounded("mean").alias("mean"))


@query(
    "res14_control_qualification_rates",
    f"""SELECT {r6("avg(CAST(p_size > 15 AS INT)) FILTER (p_partkey % 2 = 0)")} AS positive_acceptance, {r6("avg(CAST(p_size <= 15 AS INT)) FILTER (p_partkey % 2 = 1)")} AS negative_rejection,
      {r6("1 - avg(CAST(p_size <= 15 AS INT)) FILTER (p_partkey % 2 = 1)")} AS false_promotion FROM part""",
)
def _(t):
    rows = t.part.select((F.col("p_partkey") % 2 == 0).alias("positive"), (F.col("p_size") > 15).alias("passed"))
    made = B.control_qualification_rates(rows, "positive", "passed")
    return made.select(*[rounded(c).alias(c) for c in made.columns])
