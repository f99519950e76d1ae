"""Queries for column selection, masking and per-decision scaling."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from foldwright.functions import scalars as C
from foldwright.operators import columns as P
from foldwright.plans.fixtures import rounded
from foldwright.plans.registry import query, r6


def _with_nulls(t):
    return t.lineitem.withColumns(
        {
            "l_tax": F.when(F.col("l_orderkey") % 20 != 0, F.col("l_tax")),
            "l_discount": F.when(F.col("l_orderkey") % 100 == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")),
        }
    )


NUMERIC = ("l_discount", "l_extendedprice", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey", "l_tax")
SHARES = {
    "l_tax": "avg(CAST(l_orderkey % 20 = 0 AS INT))",
    "l_discount": "avg(CAST(l_orderkey % 100 = 0 AS INT))",
}


@query(
    "prj1_missing_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r6(SHARES.get(c, "0.0"))} AS missing_share,
          {SHARES.get(c, "avg(0)")} < 0.02 AS kept FROM lineitem"""
        for c in NUMERIC
    ),
)
def _(t):
    profile = P.missing_profile(_with_nulls(t), ["l_orderkey"])
    return profile.select(
        "column", rounded("missing_share").alias("missing_share"), (F.col("missing_share") < 0.02).alias("kept")
    )


@query(
    "prj1_select_low_missing_numeric",
    """SELECT CASE WHEN l_orderkey % 100 = 0 THEN NULL ELSE l_discount END AS l_discount, l_extendedprice, l_linenumber,
      l_partkey, l_quantity, l_suppkey FROM lineitem""",
)
def _(t):
    rows = _with_nulls(t)
    kept = P.low_missing_columns(rows, ["l_orderkey"])
    return rows.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c == "l_discount" else F.col(c) for c in kept])


@query(
    "prj1_seeded_column_groups",
    "SELECT "
    + ", ".join(
        f"CAST(sum({c}) AS BIGINT) AS {c}"
        for c in sorted(["l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"], key=lambda c: hashlib.md5(f"9:{c}".encode()).hexdigest())[:2]
    )
    + " FROM lineitem",
)
def _(t):
    group = P.seeded_column_groups(["l_linenumber", "l_orderkey", "l_partkey", "l_suppkey"], 2, 9)[0]
    return t.lineitem.agg(*[F.sum(c).alias(c) for c in group])


PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@query(
    "prj4_anonymise_columns",
    "SELECT "
    + ", ".join(
        f"{c} AS feature_{i:04d}_{hashlib.sha256(f's:column:{c}'.encode()).hexdigest()[:8]}" for i, c in enumerate(PART)
    )
    + " FROM part",
)
def _(t):
    return P.anonymise_columns(t.part, "s")


@query(
    "prj6_opaque_row_ids",
    """SELECT 500000 + row_number() OVER (ORDER BY c_name DESC) - 1 AS row_id, c_custkey FROM customer""",
)
def _(t):
    _, id_map = P.opaque_row_ids(t.customer.select("c_custkey", "c_name"), "c_custkey", 500_000, [F.desc("c_name")])
    return id_map


@query(
    "prj7_opaque_identifier",
    """SELECT c_custkey, 'anonymous-' || substr(sha256('pepper:' || c_name), 1, 12) AS opaque FROM customer""",
)
def _(t):
    return t.customer.select("c_custkey", C.opaque_identifier(F.col("c_name"), "pepper").alias("opaque"))


@query(
    "prj9_redact_fields",
    """SELECT event_id, event_type, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END AS visible_keys,
      CASE WHEN user_id % 2 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS value FROM events""",
)
def _(t):
    payload = F.map_filter(
        F.create_map(
            F.lit("k"), F.get_json_object("props", "$.k"),
            F.lit("score"), F.col("user_id").cast("string"),
            F.lit("value"), F.when(F.col("user_id") % 2 != 0, F.col("value").cast("string")),
        ),
        lambda _, v: v.isNotNull(),
    )
    rows = t.events.withColumn("payload", payload).withColumn("payload", P.redact_keys("payload", ["score"]))
    return rows.select(
        "event_id", "event_type", F.size("payload").alias("visible_keys"), F.try_element_at("payload", F.lit("value")).alias("value")
    )


@query(
    "prj10_agent_view",
    """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS x_0, o_orderpriority AS x_1
    FROM orders""",
)
def _(t):
    rows = t.orders.withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    )
    return P.agent_view(rows, {"o_totalprice": "x_0", "o_orderpriority": "x_1"}, "o_orderkey", None, 4)


def _extent(x: str, key: str) -> str:
    return f"min({x}) OVER (PARTITION BY {key}) AS lo, max({x}) OVER (PARTITION BY {key}) AS hi"


@query(
    "prj11_relative_coordinate",
    f"""SELECT o_orderkey, {r6("CAST(t - lo AS DOUBLE) / greatest(hi - lo, 1)")} AS relative FROM (
      SELECT o_orderkey, t, {_extent("t", "o_orderstatus")}
      FROM (SELECT *, epoch_us(o_orderdate) // 1000000 AS t FROM orders))""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.unix_seconds("o_orderdate").alias("t"))
    return P.relative_coordinate(rows, ["o_orderstatus"], "t").select("o_orderkey", rounded("relative").alias("relative"))


@query(
    "prj12_min_max_scale",
    f"""SELECT o_orderkey, {r6("CASE WHEN hi = lo THEN 0.5 ELSE (o_totalprice - lo) / (hi - lo) END")} AS scaled
    FROM (SELECT *, {_extent("o_totalprice", "o_custkey, o_orderstatus")} FROM orders)""",
)
def _(t):
    return P.min_max_scale(t.orders, ["o_custkey", "o_orderstatus"], "o_totalprice").select(
        "o_orderkey", rounded("scaled").alias("scaled")
    )


@query(
    "prj13_relative_gain",
    f"""SELECT event_id, {r6("CASE WHEN top = 0 THEN 0 ELSE g / top END")} AS relative_gain FROM (
      SELECT event_id, g, max(abs(g)) OVER (PARTITION BY user_id, event_type) AS top FROM (
        SELECT *, CASE WHEN user_id % 10 = 0 THEN 0 ELSE value - 40 END AS g FROM events))""",
)
def _(t):
    gain = F.when(F.col("user_id") % 10 == 0, 0.0).otherwise(F.col("value") - 40)
    rows = t.events.withColumn("g", gain)
    return P.relative_gain(rows, ["user_id", "event_type"], "g").select("event_id", rounded("relative_gain").alias("relative_gain"))


@query(
    "prj14_direction_normalise",
    """SELECT event_id, CASE event_type WHEN 'error' THEN -value WHEN 'click' THEN NULL ELSE value END AS better,
      event_type = 'click' AS unknown_direction FROM events""",
)
def _(t):
    direction = (
        F.when(F.col("event_type") == "error", "minimize").when(F.col("event_type") == "click", "sideways").otherwise("maximize")
    )
    rows = t.events.withColumn("better", C.direction_normalised(F.col("value"), direction))
    return rows.select("event_id", "better", F.col("better").isNull().alias("unknown_direction"))


@query(
    "prj15_safe_number",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE o_totalprice END AS number
    FROM orders""",
)
def _(t):
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority"))
        .when(F.col("o_orderkey") % 4 == 1, "NaN")
        .when(F.col("o_orderkey") % 4 == 3, F.col("o_totalprice").cast("string"))
    )
    return t.orders.select("o_orderkey", C.safe_number(text).alias("number"))


RULES = {"strict_forward": ("final", "ensemble"), "fold_train_only": ("ensemble",), "diagnostic_only": ("audit",)}
USES = ("final", "ensemble", "audit", "explore")


@query(
    "prj18_validation_use_filter",
    """WITH a AS (SELECT p_partkey AS id, p_size % 7 <> 0 AS contract, p_size % 5 <> 0 AS leak, p_size % 3 <> 0 AS past,
        p_size % 4 <> 0 AS fit, CASE WHEN p_type = 'ECONOMY' THEN 'shuffled' ELSE 'strict_forward' END AS geometry,
        ['final', 'ensemble', 'audit', 'explore'][p_partkey % 4 + 1] AS use FROM part)
    SELECT id, concat_ws(',',
      CASE WHEN NOT contract THEN 'artifact_contract_invalid' END, CASE WHEN NOT leak THEN 'leakage_check_failed' END,
      CASE WHEN use IN ('final', 'ensemble') AND (geometry <> 'strict_forward' OR NOT past OR NOT fit) THEN 'strict_forward_oof_required' END,
      CASE WHEN use = 'ensemble' AND NOT fit THEN 'feature_fit_crosses_fold_boundary' END,
      CASE WHEN use = 'audit' THEN 'geometry_is_diagnostic_only' END) AS reasons FROM a""",
)
def _(t):
    size = F.col("p_size")
    rows = t.part.select(
        F.col("p_partkey").alias("id"),
        (size % 7 != 0).alias("artifact_contract_valid"),
        (size % 5 != 0).alias("leakage_check_passed"),
        (size % 3 != 0).alias("past_only"),
        (size % 4 != 0).alias("fold_train_only"),
        F.when(F.col("p_type") == "ECONOMY", "shuffled").otherwise("strict_forward").alias("geometry"),
        F.element_at(F.array(*[F.lit(u) for u in USES]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("use"),
    )
    return rows.select("id", F.concat_ws(",", P.validation_use_reasons(RULES, F.col("use"))).alias("reasons"))


@query(
    "prj18_promotion_basis",
    """WITH e AS (SELECT p_brand || p_type || CAST(p_size % 10 AS VARCHAR) AS issue, CASE WHEN p_size > 25 THEN p_partkey % 2 ELSE 0 END AS agent, p_size % 5 AS horizons, p_size % 6 AS seeds,
        p_size % 2 = 0 AS same, p_size % 3 <> 0 AS gate, p_size % 7 <> 0 AS ver, p_size = 13 AS safety FROM part)
    SELECT issue, count(DISTINCT agent) AS agents, CASE WHEN count(DISTINCT agent) >= 2 THEN 'independent_replication'
      WHEN bool_or(horizons >= 3 AND seeds >= 3 AND same AND gate AND ver) THEN 'strong_single_agent_replication'
      WHEN bool_or(safety) THEN 'safety' END AS basis FROM e GROUP BY issue""",
)
def _(t):
    size = F.col("p_size")
    rows = t.part.select(
        F.concat("p_brand", "p_type", (size % 10).cast("string")).alias("issue"),
        F.when(size > 25, F.col("p_partkey") % 2).otherwise(0).alias("agent"),
        (size % 5).alias("horizons"),
        (size % 6).alias("seeds"),
        (size % 2 == 0).alias("same_direction"),
        (size % 3 != 0).alias("artifact_gate"),
        (size % 7 != 0).alias("verifier"),
        (size == 13).alias("safety"),
    )
    return P.promotion_basis(rows, "issue")


@query(
    "prj19_candidate_eligibility",
    """WITH c AS (SELECT p_partkey AS id, p_size % 11 <> 0 AS contract, p_size % 7 <> 0 AS leak, p_size % 5 <> 0 AS honest,
        p_size / 50.0::DOUBLE <= 0.9 AS stable, p_retailprice >= 950 AS quality, p_size % 3 > 0 AS gain,
        p_partkey % 6 >= greatest(2, (p_partkey % 5 + 1) // 2) AS hor, (p_partkey % 10) / 10.0::DOUBLE <= 0.8 AS w FROM part),
      n AS (SELECT *, concat_ws(',', CASE WHEN NOT contract THEN 'artifact_contract' END, CASE WHEN NOT leak THEN 'leakage_check' END,
        CASE WHEN NOT honest THEN 'oof_honesty' END, CASE WHEN NOT stable THEN 'seed_stability' END) AS common FROM c)
    SELECT id, common = '' AND quality AS standalone, common = '' AND gain AND hor AND w AS ensemble,
      concat_ws(',', nullif(common, ''), CASE WHEN NOT quality THEN 'standalone_quality' END) AS standalone_failures,
      concat_ws(',', nullif(common, ''), CASE WHEN NOT gain THEN 'positive_leave_one_out_gain' END,
        CASE WHEN NOT hor THEN 'multi_horizon_gain_stability' END, CASE WHEN NOT w THEN 'weight_not_fold_concentrated' END) AS ensemble_failures
    FROM n""",
)
def _(t):
    size, key = F.col("p_size"), F.col("p_partkey")
    rows = t.part.select(
        key.alias("id"),
        (size % 11 != 0).alias("artifact_contract_passed"),
        (size % 7 != 0).alias("leakage_check_passed"),
        (size % 5 != 0).alias("oof_honesty_passed"),
        (size / 50.0).alias("seed_std"),
        F.lit(0.9).alias("stability_threshold"),
        F.col("p_retailprice").alias("mean_auc"),
        F.lit(950.0).alias("quality_floor"),
        (size % 3).alias("loo_gain"),
        (key % 6).alias("positive_horizons"),
        (key % 5).alias("evaluated_horizons"),
        ((key % 10) / 10.0).alias("max_fold_weight"),
    )
    made = P.candidate_eligibility(rows)
    return made.select(
        "id", "standalone", "ensemble",
        F.concat_ws(",", "standalone_failures").alias("standalone_failures"),
        F.concat_ws(",", "ensemble_failures").alias("ensemble_failures"),
    )
