"""Queries for entity features, causal windows and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.functions import scalars as C
from foldwright.operators import features as E
from foldwright.operators import folds as S
from foldwright.plans.fixtures import ENTITY, rounded
from foldwright.plans.registry import query, r6


def _sides(t):
    rows = t.entity_events()
    return rows.filter("is_fit"), rows.filter("NOT is_fit")


@query(
    "joi4_fold_safe_entity_aggregates",
    f"""WITH {ENTITY}, f AS (SELECT user_id, count(value) AS n, avg(value) AS m,
        CASE WHEN count(value) > 1 THEN stddev_pop(value) ELSE 0 END AS s, max(t) AS last, avg(event_id) AS em,
        CASE WHEN count(event_id) > 1 THEN stddev_pop(event_id) ELSE 0 END AS es
        FROM entity WHERE is_fit GROUP BY user_id)
    SELECT e.event_id, coalesce(CAST(n AS DOUBLE), 0) AS uid_count, {r6("coalesce(m, 0)")} AS uid_amount_mean,
      {r6("coalesce(s, 0)")} AS uid_amount_std,
      {r6("coalesce(n, 0) / CAST((SELECT count(*) FROM entity WHERE is_fit) AS DOUBLE)")} AS uid_frequency,
      coalesce(CAST(t - last AS DOUBLE), 0) AS uid_time_delta,
      {r6("coalesce(em, 0)")} AS uid_event_id_mean, {r6("coalesce(es, 0)")} AS uid_event_id_std
    FROM entity e LEFT JOIN f ON e.user_id = f.user_id WHERE NOT is_fit""",
)
def _(t):
    fit, transform = _sides(t)
    made = E.fold_safe_entity_aggregates(fit, transform, "user_id", "value", "t", ["event_id"])
    return made.select(
        "event_id", "uid_count", "uid_time_delta",
        *[rounded(c).alias(c) for c in ("uid_amount_mean", "uid_amount_std", "uid_frequency", "uid_event_id_mean", "uid_event_id_std")],
    )


@query(
    "joi5_strictly_earlier_history",
    f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 3600000000 AS h, CAST(event_type = 'error' AS INT) AS y,
        event_id % 10 < 7 AS is_fit FROM events),
      a AS (SELECT b.event_id, b.h, count(f.event_id) AS n, sum(f.y) AS p, max(f.h) AS last
        FROM e b LEFT JOIN e f ON f.is_fit AND f.user_id = b.user_id AND f.h < b.h
        WHERE NOT b.is_fit GROUP BY ALL)
    SELECT event_id, CAST(n AS DOUBLE) AS uid_history_count,
      {r6("CASE WHEN n > 0 THEN CAST(p AS DOUBLE) / n ELSE 0 END")} AS uid_history_rate,
      CAST(coalesce(h - last, 0) AS DOUBLE) AS uid_history_recency FROM a""",
)
def _(t):
    hours = t.entity_events().select(
        "event_id", "user_id", F.floor(F.col("t") / F.lit(3_600_000_000)).alias("h"), "y"
    )
    fit = hours.filter(F.col("event_id") % 10 < 7)
    transform = hours.filter(F.col("event_id") % 10 >= 7)
    made = E.strictly_earlier_history(fit, transform, "user_id", "y", "h")
    return made.select(
        "event_id", "uid_history_count", rounded("uid_history_rate").alias("uid_history_rate"), "uid_history_recency"
    )


COUNTS = f"""{ENTITY}, k AS (SELECT *, concat_ws('|', user_id, event_type) AS uid FROM entity),
    c AS (SELECT uid, count(*) AS n FROM k WHERE is_fit GROUP BY uid)"""


@query(
    "joi6_known_new_slices",
    f"""WITH {COUNTS} SELECT event_id, CASE WHEN coalesce(n, 0) >= 2 THEN 'known' WHEN n = 1 THEN 'questionable'
      ELSE 'new' END AS slice FROM k LEFT JOIN c ON k.uid = c.uid WHERE NOT is_fit""",
)
def _(t):
    fit, transform = _sides(t)
    return E.known_new_slices(fit, transform, ["user_id", "event_type"]).select("event_id", "slice")


@query(
    "joi7_frequency_slices",
    f"""WITH {COUNTS} SELECT event_id, CASE WHEN coalesce(n, 0) = 0 THEN 'frequency_0' WHEN n = 1 THEN 'frequency_1'
      WHEN n <= 5 THEN 'frequency_2_5' ELSE 'frequency_6_plus' END AS slice
      FROM k LEFT JOIN c ON k.uid = c.uid WHERE NOT is_fit""",
)
def _(t):
    fit, transform = _sides(t)
    return E.frequency_slices(fit, transform, ["user_id", "event_type"]).select("event_id", "slice")


@query(
    "joi8_known_new_routing",
    f"""WITH {ENTITY}, known AS (SELECT user_id FROM entity WHERE is_fit GROUP BY user_id HAVING count(*) >= 40),
      g AS (SELECT avg(y) AS p FROM entity WHERE is_fit),
      u AS (SELECT user_id, avg(y) AS p FROM entity WHERE is_fit GROUP BY user_id)
    SELECT event_id, {r6("CASE WHEN known.user_id IS NOT NULL THEN u.p ELSE g.p END")} AS routed
    FROM entity e CROSS JOIN g LEFT JOIN u ON e.user_id = u.user_id LEFT JOIN known ON e.user_id = known.user_id
    WHERE NOT is_fit""",
)
def _(t):
    fit, transform = _sides(t)
    overall = fit.agg(F.avg("y")).first()[0]
    rates = fit.groupBy("user_id").agg(F.avg("y").alias("p_entity"), F.count(F.lit(1)).alias("n"))
    scored = transform.join(rates.drop("n"), "user_id", "left").withColumn("p_global", F.lit(overall))
    routed = E.known_new_routing(scored, rates.filter("n >= 40"), "user_id", "p_global", "p_entity", "routed")
    return routed.select("event_id", rounded("routed").alias("routed"))


@query(
    "joi23_gap_known_new_slices",
    """WITH o AS (SELECT *, concat_ws('|', coalesce(CAST(o_custkey AS VARCHAR), '__MISSING__'),
          coalesce(o_orderpriority, '__MISSING__')) AS uid,
        ntile(3) OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS fold FROM orders),
      s AS (SELECT fold, min(o_orderdate) - INTERVAL 7 DAY AS cutoff FROM o GROUP BY fold),
      c AS (SELECT a.o_orderkey, a.fold, count(b.o_orderkey) AS n FROM o a JOIN s ON a.fold = s.fold
        LEFT JOIN o b ON b.uid = a.uid AND b.o_orderdate < s.cutoff GROUP BY ALL)
    SELECT o_orderkey, CAST(fold AS BIGINT) AS fold, CASE WHEN n >= 2 THEN 'known' WHEN n = 1 THEN 'questionable' ELSE 'new' END AS slice
    FROM c""",
)
def _(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.unix_seconds("o_orderdate").alias("t"))
    numbered = S.with_row_number(orders.select("o_orderkey", "t"), ["t", "o_orderkey"], total="n_rows")
    folds = numbered.select("o_orderkey", S.block_number(F.col("row_no"), F.col("n_rows"), 3).alias("fold"))
    return E.gap_known_new_slices(
        orders, folds, "o_orderkey", "fold", "t", ["o_custkey", "o_orderpriority"], 7 * S.SECONDS_PER_DAY
    )


FRAME = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _ordered(t):
    return t.events.select(
        "event_id", "user_id", "value", (F.col("value") * 0.1234567).alias("p"), F.unix_micros("ts").alias("t"), (F.col("event_type") == "error").cast("int").alias("y")
    )


@query(
    "win3_causal_group_rate",
    f"""SELECT event_id, {r6(f"(coalesce(sum(CAST(event_type = 'error' AS INT)) {FRAME}, 0) + 1) / (count(*) {FRAME} + 2)")}
      AS rate FROM events""",
)
def _(t):
    return E.causal_group_rate(_ordered(t), "user_id", "y", ["t", "event_id"]).select("event_id", rounded("rate").alias("rate"))


@query(
    "win4_temporal_smoothing",
    f"""SELECT event_id, {r6(f"0.75 * value * 0.1234567::DOUBLE + 0.25 * coalesce(avg(value * 0.1234567::DOUBLE) {FRAME}, value * 0.1234567::DOUBLE)")} AS smoothed FROM events""",
)
def _(t):
    return E.temporal_smoothing(_ordered(t), "user_id", "p", ["t", "event_id"]).select(
        "event_id", rounded("smoothed").alias("smoothed")
    )


@query(
    "win5_entity_average",
    f"SELECT event_id, {r6('avg(value) OVER (PARTITION BY user_id)')} AS entity_mean FROM events",
)
def _(t):
    return E.entity_average(_ordered(t), "user_id", "value").select("event_id", rounded("entity_mean").alias("entity_mean"))


@query(
    "win6_delayed_history_mean",
    f"""SELECT event_id, {r6("coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)")}
      AS history_mean FROM events""",
)
def _(t):
    return E.delayed_history_mean(_ordered(t), "user_id", "value", ["t", "event_id"], 5).select(
        "event_id", rounded("history_mean").alias("history_mean")
    )


@query(
    "win7_decayed_history",
    f"""WITH n AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
        FROM events)
    SELECT a.event_id, {r6("coalesce(sum(b.value * 0.1234567::DOUBLE * pow(0.3::DOUBLE, a.i - b.i - 1)), 0)")} AS decayed
    FROM n a LEFT JOIN n b ON a.user_id = b.user_id AND b.i < a.i GROUP BY a.event_id""",
)
def _(t):
    return E.decayed_history(_ordered(t), "user_id", "p", ["t", "event_id"], 0.3).select(
        "event_id", rounded("decayed").alias("decayed")
    )


@query(
    "mlj5_smoothed_target_encoding",
    f"""WITH {ENTITY}, g AS (SELECT avg(y) AS m FROM entity WHERE is_fit),
      u AS (SELECT event_type || CAST(user_id AS VARCHAR) AS unit, (sum(y) + 8 * m) / (count(*) + 8) AS e
        FROM entity, g WHERE is_fit GROUP BY 1, m)
    SELECT event_id, {r6("coalesce(e, (SELECT avg(e) FROM u))")} AS encoded
    FROM entity LEFT JOIN u ON event_type || CAST(user_id AS VARCHAR) = u.unit WHERE NOT is_fit""",
)
def _(t):
    unit = F.concat("event_type", F.col("user_id").cast("string"))
    fit, transform = (side.withColumn("unit", unit) for side in _sides(t))
    return E.smoothed_target_encoding(fit, transform, "unit", "y").select("event_id", rounded("encoded").alias("encoded"))


@query(
    "sca4_entity_key",
    """SELECT o_orderkey, substr(sha256(CAST(o_custkey AS VARCHAR) || '|' ||
      coalesce(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END, '<NA>')), 1, 24) AS uid FROM orders""",
)
def _(t):
    rows = t.orders.withColumn("p", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")))
    return rows.select("o_orderkey", C.entity_key("o_custkey", "p").alias("uid"))


FAMILIES = (("o_custkey",), ("o_orderpriority",), ("o_year", "o_month"))
CANDIDATES = (
    ("o_custkey",),
    ("o_custkey", "o_orderpriority"),
    ("o_custkey", "o_year"),
    ("o_custkey", "o_month"),
    ("o_orderpriority", "o_year"),
    ("o_orderpriority", "o_month"),
    ("o_custkey", "o_orderpriority", "o_year"),
    ("o_custkey", "o_orderpriority", "o_month"),
)


def _candidate_sql() -> str:
    arms = " UNION ALL ".join(
        f"SELECT 'uid_{'_'.join(c)}' AS candidate, concat_ws('|', {', '.join(c)}) AS key, v, early FROM o"
        for c in CANDIDATES
    )
    return f"""WITH o AS (SELECT o_custkey, o_orderpriority, year(o_orderdate) AS o_year, month(o_orderdate) AS o_month,
        o_orderstatus AS v, o_orderdate < TIMESTAMP '1998-01-01' AS early FROM orders),
      p AS ({arms}),
      c AS (SELECT candidate, key, v, count(*) AS n, count(*) FILTER (early) AS e, count(*) FILTER (NOT early) AS l
        FROM p GROUP BY ALL),
      k AS (SELECT candidate, key, max(n) AS top, sum(n) AS n, sum(e) AS e, sum(l) AS l FROM c GROUP BY ALL)
    SELECT candidate, count(*) AS entities, {r6("sum(top) / sum(n)")} AS agreement,
      {r6("count(*) FILTER (e > 0 AND l > 0) / CAST(count(*) FILTER (e > 0) AS DOUBLE)")} AS persistence
    FROM k GROUP BY candidate"""


@query("sca6_entity_candidates", _candidate_sql())
def _(t):
    rows = t.orders.select(
        "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate",
        F.year("o_orderdate").alias("o_year"), F.month("o_orderdate").alias("o_month"),
    )
    found = E.entity_candidates(rows.columns, FAMILIES)
    scored = E.score_entity_candidates(rows, found, "o_orderstatus", F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    return scored.select("candidate", "entities", rounded("agreement").alias("agreement"), rounded("persistence").alias("persistence"))


LEVELS = tuple(C.EVIDENCE_WEIGHTS)
LEVEL_SQL = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN {C.EVIDENCE_WEIGHTS[n]}" for i, n in enumerate(LEVELS)) + " END"


def _belief(t):
    levels = F.array(*[F.lit(x) for x in LEVELS])
    return t.events.select(
        "event_id",
        (F.col("user_id") / 150.0).alias("prior"),
        F.element_at(levels, (F.col("event_id") % 7 + 1).cast("int")).alias("level"),
        F.when(F.col("event_id") % 11 == 0, "fail").when(F.col("event_id") % 5 == 0, "disputed").otherwise("pass").alias("verifier"),
        ((F.col("event_id") % 9) / 10.0).alias("p_true"),
        ((F.col("event_id") % 4) / 5.0).alias("p_false"),
        ((F.col("event_id") % 3 + 1) / 3.0).alias("reliability"),
    )


PRIOR = "least(0.95, greatest(0.05, user_id / 150.0::DOUBLE))"


def _posterior(amount: str) -> str:
    return f"least(0.95, greatest(0.05, 1 / (1 + exp(-(ln({PRIOR} / (1 - {PRIOR})) + {amount})))))"


VERIFIED = "CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 5 = 0 THEN 0.5 ELSE 1 END"


@query(
    "sca1_log_odds_update",
    f"SELECT event_id, {r6(_posterior(f'CAST({LEVEL_SQL} AS DOUBLE) * ({VERIFIED})'))} AS posterior FROM events",
)
def _(t):
    return _belief(t).select(
        "event_id", rounded(C.log_odds_update(F.col("prior"), F.col("level"), F.col("verifier"))).alias("posterior")
    )


FACTOR = f"""(ln(greatest((event_id % 9) / 10.0::DOUBLE, 1e-12) / greatest((event_id % 4) / 5.0::DOUBLE, 1e-12))
    * ({VERIFIED}) * ((event_id % 3 + 1) / 3.0::DOUBLE))"""


@query(
    "sca2_bayes_factor_update",
    f"""SELECT event_id, {r6(_posterior(FACTOR))} AS posterior, {r6(f"greatest(-2, least(2, {FACTOR}))")} AS strength
    FROM events""",
)
def _(t):
    posterior, strength = C.bayes_factor_update(
        F.col("prior"), F.col("p_true"), F.col("p_false"), F.col("verifier"), F.col("reliability")
    )
    return _belief(t).select("event_id", rounded(posterior).alias("posterior"), rounded(strength).alias("strength"))


def _gain_term(w: str, p: str, mixed: str) -> str:
    return f"CASE WHEN {w} * {p} > 0 AND {mixed} > 0 THEN {w} * {p} * (ln({p} / {mixed}) / ln(2)) ELSE 0 END"


@query(
    "sca3_information_gain",
    # Terms are added in the operator's order, and only where the mixed probability is positive, as the operator says.
    f"""WITH e AS (SELECT event_id, user_id / 150.0::DOUBLE AS q, (event_id % 9) / 10.0::DOUBLE AS a, (event_id % 4) / 5.0::DOUBLE AS b FROM events),
      m AS (SELECT *, q * a + (1 - q) * b AS m1, q * (1 - a) + (1 - q) * (1 - b) AS m2 FROM e)
    SELECT event_id, {r6(f"greatest(0, {_gain_term('q', 'a', 'm1')} + {_gain_term('(1 - q)', 'b', 'm1')} + {_gain_term('q', '(1 - a)', 'm2')} + {_gain_term('(1 - q)', '(1 - b)', 'm2')})")} AS gain FROM m""",
)
def _(t):
    outcomes = F.array(
        F.struct("p_true", "p_false"), F.struct((1 - F.col("p_true")).alias("p_true"), (1 - F.col("p_false")).alias("p_false"))
    )
    return _belief(t).select("event_id", rounded(C.information_gain(F.col("prior"), outcomes)).alias("gain"))


@query(
    "sca5_experiment_fingerprint",
    """SELECT p_partkey, sha256('{"metrics":' || CASE WHEN p_size % 5 = 0 THEN 'null' ELSE '"' || p_brand || '"' END
      || ',"protocol":"' || p_type || '","seeds":' || CAST(p_size AS VARCHAR) || '}') AS fingerprint FROM part""",
)
def _(t):
    fields = {
        "seeds": F.col("p_size"), "protocol": F.col("p_type"), "metrics": F.when(F.col("p_size") % 5 != 0, F.col("p_brand")),
    }
    return t.part.select("p_partkey", C.canonical_fingerprint(fields).alias("fingerprint"))


@query(
    "sca8_outcome_disposition",
    """WITH d AS (SELECT p_partkey, [x FOR x IN string_split(p_name, ' ') IF x IN ('red', 'blue', 'green', 'gear')] AS s,
        [x FOR x IN string_split(p_name, ' ') IF x IN ('bolt', 'ring', 'blue')] AS c,
        CASE WHEN p_size % 2 = 0 THEN ['size'] ELSE [] END AS f FROM part)
    SELECT p_partkey, CASE WHEN len(c) > 0 AND len(s) = 0 THEN 'falsified' WHEN len(c) > 0 THEN 'weakened'
      WHEN len(s) > 0 AND len(f) > 0 THEN 'survives' ELSE 'inconclusive' END AS disposition FROM d""",
)
def _(t):
    words = F.split("p_name", " ")
    chosen = lambda *w: F.filter(words, lambda x: x.isin(*w))
    confounders = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("size"))).otherwise(F.array().cast("array<string>"))
    return t.part.select(
        "p_partkey",
        C.outcome_disposition(chosen("red", "blue", "green", "gear"), chosen("bolt", "ring", "blue"), confounders).alias("disposition"),
    )
