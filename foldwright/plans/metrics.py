"""Queries for ranking, correlation and calibration metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.operators import metrics as M
from foldwright.operators.ordering import average_rank, exact_quantile
from foldwright.plans.fixtures import ENTITY, OOF, SCORED, rounded
from foldwright.plans.registry import query, r6

RANK_AUC = """(CASE WHEN sum(y) > 0 AND count(*) > sum(y) THEN
  (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))) END)"""


def ranked_cte(source: str, key: str, score: str, target: str) -> str:
    part = f"PARTITION BY {key}" if key else ""
    ties = f"PARTITION BY {key + ', ' if key else ''}{score}"
    keep = f"{key}, " if key else ""
    return f"""ranked AS (SELECT {keep}CAST({target} AS BIGINT) AS y,
      rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({ties}) - 1) / 2.0::DOUBLE AS rk FROM {source})"""


@query(
    "win1_average_rank",
    f"""SELECT l_returnflag, l_quantity, count(*) AS n, {r6("min(rk)")} AS avg_rank FROM (
      SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
        + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rk FROM lineitem)
    GROUP BY l_returnflag, l_quantity""",
)
def _(t):
    ranked = average_rank(t.lineitem.select("l_returnflag", "l_quantity"), "l_quantity", ["l_returnflag"])
    return ranked.groupBy("l_returnflag", "l_quantity").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.min("avg_rank")).alias("avg_rank")
    )


@query(
    "agg1_auc",
    f"""WITH ranked AS (SELECT CAST(l_returnflag = 'R' AS BIGINT) AS y, rank() OVER (ORDER BY l_extendedprice)
      + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS rk FROM lineitem)
    SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, {r6(RANK_AUC)} AS auc FROM ranked""",
)
def _(t):
    rows = t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_extendedprice")
    return M.auc(rows, "y", "l_extendedprice").select("n", "positives", rounded("auc").alias("auc"))


@query(
    "agg2_slice_auc",
    f"""WITH {SCORED}, {ranked_cte("scored", "lang", "a", "target")}
    SELECT lang, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, {r6(RANK_AUC)} AS auc
    FROM ranked GROUP BY lang""",
)
def _(t):
    return M.auc(t.scored(), "target", "a", ["lang"]).select("lang", "n", "positives", rounded("auc").alias("auc"))


@query(
    "agg3_spearman",
    f"""WITH r AS (SELECT l_returnflag,
        rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
          + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS a,
        rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice)
          + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)
    SELECT l_returnflag, count(*) AS n, {r6("corr(a, b)")} AS spearman FROM r GROUP BY l_returnflag""",
)
def _(t):
    rows = t.lineitem.select("l_returnflag", "l_quantity", "l_extendedprice")
    return M.spearman(rows, "l_quantity", "l_extendedprice", ["l_returnflag"]).select(
        "l_returnflag", "n", rounded("spearman").alias("spearman")
    )


# Means are rounded half up from exact sums of hundredths, so no order of adding and no engine's own rounding of doubles decides a tie.
PAIRS_SQL = """s AS (SELECT p_partkey AS id, sum(CAST(round(l_quantity * 100) AS BIGINT)) AS x, sum(CAST(round(l_discount * 100) AS BIGINT)) AS y, count(*) AS n
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey),
      q AS (SELECT CAST((2 * x + n) // (2 * n) AS BIGINT) AS x, CAST((20 * y + n) // (2 * n) AS BIGINT) AS y, id FROM s),
      pairs AS (SELECT sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM q a JOIN q b ON a.id < b.id),
      c AS (SELECT count(*) FILTER (sx * sy > 0) AS con, count(*) FILTER (sx * sy < 0) AS dis,
        count(*) FILTER (sx = 0 AND sy <> 0) AS tl, count(*) FILTER (sy = 0 AND sx <> 0) AS tr FROM pairs)"""


def _part_scores(t):
    lines = t.lineitem.select("l_partkey", "l_quantity", "l_discount")
    joined = lines.join(t.part.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    hundredths = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    sums = joined.groupBy("p_partkey").agg(hundredths("l_quantity").alias("x"), hundredths("l_discount").alias("y"), F.count(F.lit(1)).alias("n"))
    return sums.select("p_partkey", F.expr("(2 * x + n) div (2 * n)").alias("x"), F.expr("(20 * y + n) div (2 * n)").alias("y"))


@query(
    "agg4_rank_reversal_rate",
    f"""WITH {PAIRS_SQL} SELECT con + dis AS comparable,
      {r6("CASE WHEN con + dis > 0 THEN CAST(dis AS DOUBLE) / (con + dis) ELSE 0 END")} AS reversal_rate FROM c""",
)
def _(t):
    return M.rank_reversal_rate(_part_scores(t), "x", "y").select(
        "comparable", rounded("reversal_rate").alias("reversal_rate")
    )


@query(
    "agg5_kendall_tau_b",
    f"""WITH {PAIRS_SQL} SELECT con AS concordant, dis AS discordant, tl AS tied_left, tr AS tied_right,
      {r6("(con - dis) / sqrt(CAST(con + dis + tl AS DOUBLE) * (con + dis + tr))")} AS tau_b FROM c""",
)
def _(t):
    return M.kendall_tau_b(_part_scores(t), "x", "y").select(
        "concordant", "discordant", "tied_left", "tied_right", rounded("tau_b").alias("tau_b")
    )


STABILITY_SQL = """m AS (SELECT l_linenumber AS model, year(l_shipdate) AS horizon, avg(l_quantity) AS s
        FROM lineitem GROUP BY ALL),
      r AS (SELECT model, horizon, rank() OVER (PARTITION BY horizon ORDER BY s)
        + (count(*) OVER (PARTITION BY horizon, s) - 1) / 2.0::DOUBLE AS rk FROM m),
      c AS (SELECT a.horizon AS h1, b.horizon AS h2,
        CASE WHEN min(a.rk) = max(a.rk) OR min(b.rk) = max(b.rk) THEN 1.0 ELSE corr(a.rk, b.rk) END AS rho
        FROM r a JOIN r b ON a.model = b.model AND a.horizon < b.horizon GROUP BY ALL)"""


@query(
    "agg6_rank_stability",
    f"""WITH {STABILITY_SQL} SELECT count(*) AS horizon_pairs, {r6("avg(rho)")} AS rank_stability FROM c""",
)
def _(t):
    scores = t.lineitem.groupBy(F.col("l_linenumber").alias("model"), F.year("l_shipdate").alias("horizon")).agg(
        F.avg("l_quantity").alias("s")
    )
    return M.rank_stability(scores, "model", "horizon", "s").select(
        "horizon_pairs", rounded("rank_stability").alias("rank_stability")
    )


CANDIDATES = ("A", "B", "C", "D")


@query(
    "agg7_residual_correlation",
    f"""WITH {OOF} SELECT x.candidate_id AS left_id, y.candidate_id AS right_id, count(*) AS n,
      {r6("corr(x.residual, y.residual)")} AS correlation
    FROM oof x JOIN oof y ON x.row_id = y.row_id AND x.candidate_id < y.candidate_id GROUP BY ALL""",
)
def _(t):
    wide = M.candidate_matrix(t.oof_long(), "row_id", "candidate_id", "residual", CANDIDATES)
    return M.residual_correlation(wide, CANDIDATES).select(
        "left_id", "right_id", "n", rounded("correlation").alias("correlation")
    )


@query(
    "agg8_prediction_disagreement",
    f"""WITH {OOF} SELECT x.candidate_id AS left_id, y.candidate_id AS right_id,
      {r6("avg(CAST((x.oof_prediction >= 0.5) <> (y.oof_prediction >= 0.5) AS INT))")} AS disagreement
    FROM oof x JOIN oof y ON x.row_id = y.row_id AND x.candidate_id < y.candidate_id GROUP BY ALL""",
)
def _(t):
    wide = M.candidate_matrix(t.oof_long(), "row_id", "candidate_id", "oof_prediction", CANDIDATES)
    return M.prediction_disagreement(wide, CANDIDATES).select(
        "left_id", "right_id", rounded("disagreement").alias("disagreement")
    )


@query("agg9_effective_rank")
def _(t):
    wide = M.candidate_matrix(t.oof_long(), "row_id", "candidate_id", "residual", CANDIDATES)
    return M.effective_rank(wide, CANDIDATES).select("n", rounded("effective_rank").alias("effective_rank"))


@query(
    "agg10_marginal_ensemble_gain",
    f"""WITH {SCORED} SELECT count(*) AS n,
      {r6("avg(pow(target - (a + b) / 2, 2) - pow(target - (a + b + c) / 3, 2))")} AS gain FROM scored""",
)
def _(t):
    return M.marginal_ensemble_gain(t.scored(), "target", ["a", "b"], "c").select("n", rounded("gain").alias("gain"))


@query(
    "agg11_forecast_calibration",
    """WITH f AS (SELECT event_type AS g, 0.2 + (event_id % 7) / 10.0::DOUBLE AS ph, value,
        CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS obs, user_id FROM events),
      e AS (SELECT g, ph, 1 - ph AS pl, obs, CASE WHEN ph > 1 - ph THEN 'high' ELSE 'low' END AS top,
        greatest(ph, 1 - ph) AS conf, CASE WHEN obs = 'high' THEN ph ELSE 1 - ph END AS pobs, user_id, value FROM f)
    SELECT g, count(*) AS n,"""
    + ", ".join(
        f"{r6(e)} AS {n}"
        for n, e in (
            (
                "brier",
                "avg((pow(ph - CAST(obs = 'high' AS INT), 2) + pow(pl - CAST(obs = 'low' AS INT), 2)) / 2)",
            ),
            ("log_loss", "avg(-ln(greatest(pobs, 1e-12)))"),
            ("accuracy", "avg(CAST(top = obs AS INT))"),
            ("mean_confidence", "avg(conf)"),
            ("overconfidence", "avg(CAST(top <> obs AND conf >= 0.5 AS INT))"),
            ("underconfidence", "avg(CAST(top = obs AND conf < 0.5 AS INT))"),
            ("coverage_50", "avg(CASE WHEN user_id % 2 = 0 THEN CAST(value < 30 AS INT) END)"),
            ("coverage_80", "avg(CAST(value < 80 AS INT))"),
        )
    )
    + ", CAST(NULL AS DOUBLE) AS coverage_95 FROM e GROUP BY g",
)
def _(t):
    high = 0.2 + (F.col("event_id") % 7) / 10.0
    rows = t.events.select(
        F.col("event_type").alias("g"),
        F.create_map(F.lit("high"), high, F.lit("low"), 1 - high).alias("probabilities"),
        F.when(F.col("value") > 50, "high").otherwise("low").alias("observed"),
        F.map_filter(
            F.create_map(
                F.lit("0.5"),
                F.when(F.col("user_id") % 2 == 0, F.col("value") < 30),
                F.lit("0.8"),
                F.col("value") < 80,
            ),
            lambda _, v: v.isNotNull(),
        ).alias("coverage"),
    )
    result = M.forecast_calibration(rows, "probabilities", "observed", "coverage", ["g"])
    return result.select("g", "n", *[rounded(c).alias(c) for c in result.columns if c not in ("g", "n")])


@query(
    "agg12_binary_calibration",
    f"""WITH {OOF}, p AS (SELECT candidate_id, target AS y,
        greatest(1e-12, least(1 - 1e-12, oof_prediction)) AS p FROM oof),
      b AS (SELECT candidate_id, least(floor(p * 5), 4) AS bin, abs(sum(p) - sum(y)) AS gap FROM p GROUP BY ALL),
      e AS (SELECT candidate_id, sum(gap) AS gap FROM b GROUP BY ALL),
      s AS (SELECT candidate_id, count(*) AS n, avg(pow(p - y, 2)) AS brier,
        -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS log_score FROM p GROUP BY ALL)
    SELECT s.candidate_id, n, {r6("brier")} AS brier, {r6("log_score")} AS log_score, {r6("gap / n")} AS ece
    FROM s JOIN e USING (candidate_id)""",
)
def _(t):
    result = M.binary_calibration(t.oof_long(), "oof_prediction", "target", ["candidate_id"])
    return result.select("candidate_id", "n", *[rounded(c).alias(c) for c in ("brier", "log_score", "ece")])


@query(
    "agg13_reliability_bins",
    f"""WITH {SCORED} SELECT lang, CAST(least(floor(c * 5), 4) AS BIGINT) AS bin, count(*) AS n,
      {r6("avg(c)")} AS mean_confidence, {r6("avg(target)")} AS empirical_rate FROM scored GROUP BY ALL""",
)
def _(t):
    return M.reliability_bins(t.scored(), "c", "target", ["lang"]).select(
        "lang", "bin", "n", rounded("mean_confidence").alias("mean_confidence"),
        rounded("empirical_rate").alias("empirical_rate"),
    )


@query(
    "agg13_expected_calibration_error",
    f"""WITH {SCORED}, b AS (SELECT lang, least(floor(c * 5), 4) AS bin, count(*) AS n,
        abs(avg(c) - avg(target)) AS gap FROM scored GROUP BY ALL)
    SELECT lang, {r6("sum(n * gap) / sum(n)")} AS ece FROM b GROUP BY lang""",
)
def _(t):
    return M.expected_calibration_error(t.scored(), "c", "target", ["lang"]).select("lang", rounded("ece").alias("ece"))


@query(
    "agg14_wilson_interval",
    f"""WITH c AS (SELECT user_id, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS s,
        CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL),
      w AS (SELECT user_id, s, n, s / n AS p, 1.959963984540054::DOUBLE AS z FROM c),
      h AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS mid,
        z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS half FROM w)
    SELECT user_id, {r6("p")} AS rate, {r6("greatest(0, mid - half)")} AS low, {r6("least(1, mid + half)")} AS high
    FROM h""",
)
def _(t):
    counts = t.events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("s"), F.count(F.lit(1)).alias("n")
    )
    rate, low, high = M.wilson_interval(F.col("s"), F.col("n"))
    return counts.select(
        "user_id", rounded(rate).alias("rate"), rounded(low).alias("low"), rounded(high).alias("high")
    )


@query(
    "agg15_effective_count",
    f"""WITH c AS (SELECT user_id, event_type, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL),
      p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
    SELECT user_id, {r6("exp(-sum(p * ln(p)))")} AS effective_count, {r6("max(p)")} AS dominant_share
    FROM p GROUP BY user_id""",
)
def _(t):
    return M.effective_count(t.events, "event_type", ["user_id"]).select(
        "user_id", rounded("effective_count").alias("effective_count"), rounded("dominant_share").alias("dominant_share")
    )


@query(
    "agg16_modal_agreement",
    f"""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
      g AS (SELECT o_custkey, max(n) AS top, sum(n) AS total FROM c GROUP BY ALL)
    SELECT CAST(sum(total) AS BIGINT) AS n, {r6("sum(top) / sum(total)")} AS agreement FROM g""",
)
def _(t):
    return M.modal_agreement(t.orders, "o_custkey", "o_orderpriority").select("n", rounded("agreement").alias("agreement"))


@query(
    "agg17_temporal_persistence",
    f"""WITH {ENTITY}, e AS (SELECT DISTINCT user_id FROM entity WHERE is_fit),
      l AS (SELECT DISTINCT user_id FROM entity WHERE NOT is_fit)
    SELECT count(*) AS early_entities, {r6("count(l.user_id) / CAST(count(*) AS DOUBLE)")} AS persistence
    FROM e LEFT JOIN l ON e.user_id = l.user_id""",
)
def _(t):
    rows = t.entity_events()
    return M.temporal_persistence(rows.filter("is_fit"), rows.filter("NOT is_fit"), "user_id").select(
        "early_entities", rounded("persistence").alias("persistence")
    )


@query(
    "agg18_between_group_share",
    f"""WITH g AS (SELECT l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL)
    SELECT {r6("least(1, (SELECT var_pop(m) FROM g) / greatest(var_pop(l_quantity), 1e-9))")} AS between_share
    FROM lineitem""",
)
def _(t):
    return M.between_group_share(t.lineitem, "l_suppkey", "l_quantity").select(
        rounded("between_share").alias("between_share")
    )


@query(
    "agg18_correlation_by_missing_pattern",
    f"""WITH w AS (SELECT CASE WHEN l_orderkey % 100 = 0 THEN 2 WHEN l_orderkey % 20 = 0 THEN 1 ELSE 0 END AS pattern,
        l_quantity AS x, l_extendedprice AS y FROM lineitem),
      c AS (SELECT pattern, CASE WHEN count(*) < 3 THEN 0 ELSE corr(x, y) END AS r FROM w GROUP BY ALL)
    SELECT count(*) AS routes, {r6("least(1, max(r) - min(r))")} AS shift FROM c""",
)
def _(t):
    pattern = F.when(F.col("l_orderkey") % 100 == 0, 2).when(F.col("l_orderkey") % 20 == 0, 1).otherwise(0)
    rows = t.lineitem.select(pattern.alias("pattern"), "l_quantity", "l_extendedprice")
    return M.correlation_shift(rows, "pattern", "l_quantity", "l_extendedprice").select(
        "routes", rounded("shift").alias("shift")
    )


@query(
    "agg18_correlation_early_late",
    f"""WITH w AS (SELECT epoch_us(ts) < (SELECT quantile_cont(epoch_us(ts), 0.5) FROM events) AS early,
        value AS x, CAST(user_id AS DOUBLE) AS y FROM events),
      c AS (SELECT early, CASE WHEN count(*) < 3 THEN 0 ELSE corr(x, y) END AS r FROM w GROUP BY ALL)
    SELECT count(*) AS routes, {r6("least(1, max(r) - min(r))")} AS shift FROM c""",
)
def _(t):
    rows = t.events.select(F.unix_micros("ts").alias("t"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"))
    median = exact_quantile(rows, "t", 0.5, rule="linear").first()[0]
    rows = rows.withColumn("early", F.col("t") < F.lit(median))
    return M.correlation_shift(rows, "early", "x", "y").select("routes", rounded("shift").alias("shift"))


@query(
    "agg47_leaderboard_rank_equivalent",
    f"""WITH p AS (SELECT max(o_totalprice) FILTER (o_orderstatus = 'F') AS v FROM orders),
      c AS (SELECT count(*) FILTER (o_totalprice > v) AS b, count(*) FILTER (o_totalprice = v) AS e, count(*) AS n
        FROM orders, p)
    SELECT n, {r6("CASE WHEN e > 0 THEN (2 * b + 1 + e) / 2.0 ELSE b + 1 END")} AS rank_equivalent FROM c""",
)
def _(t):
    probe = t.orders.filter("o_orderstatus = 'F'").agg(F.max("o_totalprice")).first()[0]
    return M.leaderboard_rank_equivalent(t.orders, "o_totalprice", probe).select(
        "n", rounded("rank_equivalent").alias("rank_equivalent")
    )


@query(
    "agg57_fold_mean_slice_auc",
    f"""WITH {SCORED}, ranked AS (SELECT lang, fold_id, CAST(target AS BIGINT) AS y,
        rank() OVER (PARTITION BY lang, fold_id ORDER BY a)
          + (count(*) OVER (PARTITION BY lang, fold_id, a) - 1) / 2.0::DOUBLE AS rk FROM scored),
      f AS (SELECT lang, fold_id, {RANK_AUC} AS auc FROM ranked GROUP BY lang, fold_id)
    SELECT lang, {r6("avg(auc)")} AS mean_auc FROM f GROUP BY lang""",
)
def _(t):
    return M.fold_mean_slice_auc(t.scored(), "target", "a", "fold_id", ["lang"]).select(
        "lang", rounded("mean_auc").alias("mean_auc")
    )


@query(
    "agg59_candidate_fold_profile",
    f"""WITH {OOF}, ranked AS (SELECT candidate_id, fold_id, CAST(target AS BIGINT) AS y,
        rank() OVER (PARTITION BY candidate_id, fold_id ORDER BY oof_prediction)
          + (count(*) OVER (PARTITION BY candidate_id, fold_id, oof_prediction) - 1) / 2.0::DOUBLE AS rk FROM oof),
      f AS (SELECT candidate_id, fold_id, {RANK_AUC} AS auc FROM ranked GROUP BY candidate_id, fold_id)
    SELECT candidate_id, {r6("avg(auc)")} AS mean_auc, {r6("stddev_pop(auc)")} AS fold_std,
      {r6("greatest(0, 1 - stddev_pop(auc))")} AS robustness FROM f GROUP BY candidate_id""",
)
def _(t):
    result = M.candidate_fold_profile(t.oof_long(), "target", "oof_prediction", "candidate_id", "fold_id")
    return result.select("candidate_id", *[rounded(c).alias(c) for c in ("mean_auc", "fold_std", "robustness")])


@query(
    "win2_normalised_rank_blend",
    f"""WITH {SCORED}, r AS (SELECT doc_id,
        (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE - 1)
          / greatest(1, count(*) OVER () - 1) AS ra,
        (rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0::DOUBLE - 1)
          / greatest(1, count(*) OVER () - 1) AS rc FROM scored)
    SELECT doc_id, {r6("ra * 0.75 + rc * 0.25")} AS blended FROM r""",
)
def _(t):
    weights = t.spark.createDataFrame([("A", 3.0), ("C", 1.0)], "candidate_id string, weight double")
    rows = t.oof_long().filter(F.col("candidate_id").isin("A", "C"))
    ranked = M.normalised_ranks(rows, "oof_prediction", ["candidate_id"], "rank")
    total = 4.0
    blended = ranked.join(weights, "candidate_id").groupBy("row_id").agg(
        F.sum(F.col("weight") / total * F.col("rank")).alias("blended")
    )
    return blended.select(F.col("row_id").cast("long").alias("doc_id"), rounded("blended").alias("blended"))
