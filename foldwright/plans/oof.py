"""Queries for out-of-fold tables and blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.operators import metrics as M
from foldwright.operators import oof as O
from foldwright.operators import sets as X
from foldwright.plans.fixtures import ENTITY, OOF, SCORED, rounded
from foldwright.plans.registry import query, r6
from foldwright.session import scratch_path
from foldwright.sources import oof as source
from foldwright.sources import submissions as submit

PLANTED = f"""WITH {OOF}, planted AS (SELECT candidate_id, validation_world, row_id, target, oof_prediction,
    CASE WHEN CAST(row_id AS BIGINT) % 50 = 0 THEN residual + 0.5 ELSE residual END AS residual FROM oof
    UNION ALL SELECT candidate_id, validation_world, row_id, target, oof_prediction, residual FROM oof
      WHERE CAST(row_id AS BIGINT) % 40 = 1 AND candidate_id = 'B')"""


def _written(t, form):
    oof = t.oof_long()
    number = F.col("row_id").cast("long")
    bad = oof.withColumn("residual", F.when(number % 50 == 0, F.col("residual") + 0.5).otherwise(F.col("residual")))
    rows = bad.unionByName(oof.filter((number % 40 == 1) & (F.col("candidate_id") == "B")))
    path = scratch_path(t.spark, "oof") + f".{form}"
    source.sink_oof(rows, path, form)
    return source.scan_oof(t.spark, path, form)


@query(
    "src1_scan_oof_violations",
    f"""{PLANTED} SELECT candidate_id, validation_world, row_id, 'duplicate' AS problem FROM planted
      GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT candidate_id, validation_world, row_id, 'residual' FROM planted
      WHERE abs(residual - (target - oof_prediction)) > 1e-9""",
)
def _(t):
    return _written(t, "parquet").violations


@query(
    "src2_sink_oof_json",
    f"""{PLANTED} SELECT candidate_id, row_id, {r6("target")} AS target, {r6("oof_prediction")} AS oof_prediction,
      {r6("residual")} AS residual FROM planted""",
)
def _(t):
    rows = _written(t, "json").result
    return rows.select("candidate_id", "row_id", *[rounded(c).alias(c) for c in ("target", "oof_prediction", "residual")])


@query(
    "joi1_aligned_pair_join",
    f"""WITH {OOF} SELECT a.row_id, {r6("a.residual")} AS residual_l, {r6("b.residual")} AS residual_r
    FROM oof a JOIN oof b ON a.row_id = b.row_id AND a.candidate_id = 'A' AND b.candidate_id = 'C'""",
)
def _(t):
    oof = t.oof_long()
    pair = O.aligned_pair_join(
        oof.filter("candidate_id = 'A'"), oof.filter("candidate_id = 'C'"), ["validation_world", "row_id"]
    )
    return pair.checked().select(
        "row_id", rounded("residual_l").alias("residual_l"), rounded("residual_r").alias("residual_r")
    )


@query(
    "joi1_aligned_pair_violations",
    f"""WITH {SCORED}, s AS (SELECT CAST(doc_id AS VARCHAR) AS row_id, doc_id FROM scored)
    SELECT row_id, CASE WHEN doc_id % 30 = 0 THEN 'missing_right' WHEN doc_id % 31 = 0 THEN 'missing_left'
      WHEN doc_id % 37 = 0 OR doc_id % 43 = 0 THEN 'target' ELSE 'fold' END AS problem
    FROM s WHERE (doc_id % 30 = 0) <> (doc_id % 31 = 0)
      OR (doc_id % 30 <> 0 AND doc_id % 31 <> 0 AND (doc_id % 37 = 0 OR doc_id % 41 = 0 OR doc_id % 43 = 0 OR doc_id % 47 = 0))""",
)
def _(t):
    oof = t.oof_long()
    number = F.col("row_id").cast("long")
    left = oof.filter("candidate_id = 'A'").filter(number % 31 != 0)
    right = (
        oof.filter("candidate_id = 'C'")
        .filter(number % 30 != 0)
        .withColumn("target", F.when(number % 37 == 0, F.col("target") + 1).when(number % 43 != 0, F.col("target")))
        .withColumn("fold_id", F.when(number % 41 == 0, F.lit("x")).when(number % 47 != 0, F.col("fold_id")))
    )
    return O.aligned_pair_join(left, right, ["validation_world", "row_id"]).violations.select("row_id", "problem")


@query(
    "joi2_candidate_matrix",
    f"""WITH {SCORED} SELECT CAST(doc_id AS VARCHAR) AS row_id, {r6("target - a")} AS "A", {r6("target - b")} AS "B",
      {r6("target - c")} AS "C" FROM scored WHERE doc_id % 7 <> 0 AND doc_id % 13 <> 0""",
)
def _(t):
    wide = M.candidate_matrix(_gapped(t), "row_id", "candidate_id", "residual", ("A", "B", "C"))
    return wide.select("row_id", *[rounded(c).alias(c) for c in ("A", "B", "C")])


def _gapped(t):
    """Rows with a candidate D that is not asked for, some without B and some with a null residual of C."""
    number, candidate = F.col("row_id").cast("long"), F.col("candidate_id")
    kept = t.oof_long().filter((candidate != "B") | (number % 7 != 0))
    return kept.withColumn("residual", F.when((candidate != "C") | (number % 13 != 0), F.col("residual")))


@query(
    "joi2_misaligned_rows",
    f"""WITH {SCORED} SELECT CAST(doc_id AS VARCHAR) AS row_id, concat_ws(',', CASE WHEN doc_id % 7 = 0 THEN 'B' END, CASE WHEN doc_id % 13 = 0 THEN 'C' END) AS misaligned
    FROM scored WHERE doc_id % 7 = 0 OR doc_id % 13 = 0""",
)
def _(t):
    found = M.audited_matrix(_gapped(t), "row_id", "candidate_id", "residual", ("A", "B", "C")).violations
    return found.select("row_id", F.array_join("misaligned", ",").alias("misaligned"))


@query(
    "joi9_oof_honesty",
    """WITH o AS (SELECT doc_id, doc_id % 5 - CASE WHEN doc_id % 60 = 0 THEN 9 ELSE 0 END AS fold,
          CASE WHEN doc_id % 45 = 0 THEN 1.5 ELSE 0.5 END AS p FROM labels
        UNION ALL SELECT doc_id, doc_id % 5, 0.5 FROM labels WHERE doc_id % 50 = 3),
      f AS (SELECT doc_id, doc_id % 5 + CASE WHEN doc_id % 70 = 0 THEN 1 ELSE 0 END AS fold FROM labels
        UNION ALL SELECT doc_id, doc_id % 5 FROM labels WHERE doc_id % 80 = 7),
      d AS (SELECT doc_id, count(*) AS n FROM o GROUP BY ALL), g AS (SELECT doc_id, count(*) AS n, min(fold) AS fold FROM f GROUP BY ALL)
    SELECT count(*) AS rows, count(*) FILTER (p < 0 OR p > 1) AS bad_probability,
      count(*) FILTER (o.fold < 0 OR g.fold IS NULL OR o.fold <> g.fold) AS bad_fold,
      (SELECT count(*) FROM d WHERE n > 1) AS duplicate_oof_ids, (SELECT count(*) FROM g WHERE n > 1) AS duplicate_fold_ids
    FROM o LEFT JOIN g ON o.doc_id = g.doc_id""",
)
def _(t):
    ids, key = t.labels.select("doc_id"), F.col("doc_id")
    oof = ids.select(
        "doc_id",
        (key % 5 - F.when(key % 60 == 0, 9).otherwise(0)).alias("fold"),
        F.when(key % 45 == 0, 1.5).otherwise(0.5).alias("p"),
    ).unionByName(ids.filter(key % 50 == 3).select("doc_id", (key % 5).alias("fold"), F.lit(0.5).alias("p")))
    folds = ids.select("doc_id", (key % 5 + F.when(key % 70 == 0, 1).otherwise(0)).alias("fold")).unionByName(
        ids.filter(key % 80 == 7).select("doc_id", (key % 5).alias("fold"))
    )
    return O.oof_honesty(oof, folds, "doc_id", "p", "fold")


@query(
    "joi10_coverage_check",
    """SELECT doc_id, 'missing_left' AS side FROM documents ANTI JOIN labels USING (doc_id)
    UNION ALL SELECT doc_id + 10000000, 'missing_right' FROM labels WHERE toxic = 1""",
)
def _(t):
    supplied = t.labels.select("doc_id").unionByName(
        t.labels.filter("toxic = 1").select((F.col("doc_id") + 10_000_000).alias("doc_id"))
    )
    return X.key_set_difference(supplied, t.documents.select("doc_id"), ["doc_id"])


@query(
    "joi22_common_oof_rows",
    f"""WITH {SCORED}, c AS (SELECT *, ntile(3) OVER (ORDER BY doc_id * 7919 % 1009, doc_id) - 1 AS block
        FROM scored WHERE doc_id % 11 <> 0)
    SELECT doc_id, block, target, {r6("a")} AS "A", {r6("b")} AS "B", {r6("c")} AS "C" FROM c""",
)
def _(t):
    oof = t.oof_long().filter("candidate_id <> 'D'").withColumn("doc_id", F.col("row_id").cast("long"))
    gaps = oof.withColumn(
        "oof_prediction",
        F.when((F.col("candidate_id") != "B") | (F.col("doc_id") % 11 != 0), F.col("oof_prediction")),
    )
    times = t.labels.select("doc_id", (F.col("doc_id") * 7919 % 1009).alias("t"))
    common = O.common_oof_rows(
        gaps, "doc_id", "candidate_id", "oof_prediction", "target", times, "t", ("A", "B", "C"), minimum=100
    ).checked()
    return common.select("doc_id", "block", "target", *[rounded(c).alias(c) for c in ("A", "B", "C")])


@query(
    "set1_shared_keys",
    """WITH k AS (SELECT DISTINCT l_linenumber AS c, l_partkey FROM lineitem)
    SELECT l_partkey FROM k GROUP BY l_partkey HAVING count(*) = (SELECT count(DISTINCT c) FROM k)""",
)
def _(t):
    return X.shared_keys(t.lineitem.select("l_linenumber", "l_partkey"), "l_linenumber", "l_partkey")


@query(
    "set2_union_and_missed",
    """WITH f AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 60),
      u AS (SELECT DISTINCT user_id FROM events WHERE value > 120)
    SELECT coalesce(f.user_id, u.user_id) AS user_id, f.user_id IS NOT NULL AS found, u.user_id IS NOT NULL AS is_true,
      f.user_id IS NULL AS missed FROM f FULL JOIN u ON f.user_id = u.user_id""",
)
def _(t):
    found = t.events.filter((F.col("event_type") == "error") & (F.col("value") > 60))
    return X.union_and_missed(found, t.events.filter("value > 120"), "user_id")


@query(
    "set3_key_set_equality",
    """WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'),
      b AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O')
    SELECT *, 'missing_right' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'missing_left' FROM (FROM b EXCEPT FROM a)""",
)
def _(t):
    orders = t.orders
    return X.key_set_difference(
        orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'"), ["o_custkey", "o_orderpriority"]
    )


# Two candidates make the simplex an interval, so the projection has a closed form in SQL.
BLEND_SQL = f"""WITH RECURSIVE {SCORED}, m AS (SELECT fold_id, count(*) AS n, sum(a * a) AS aa, sum(a * c) AS ac, sum(c * c) AS cc,
        sum(a * target) AS ya, sum(c * target) AS yc, sum(target * target) AS yy FROM scored GROUP BY fold_id),
      tr AS (SELECT x.fold_id, sum(m.n) AS n, sum(m.aa) AS aa, sum(m.ac) AS ac, sum(m.cc) AS cc, sum(m.ya) AS ya, sum(m.yc) AS yc
        FROM m x JOIN m ON m.fold_id <> x.fold_id GROUP BY x.fold_id),
      w(fold_id, i, wa) AS (SELECT fold_id, 0, 0.5::DOUBLE FROM tr
        UNION ALL SELECT w.fold_id, i + 1, least(1, greatest(0, (1
            + (wa - 0.4 * (aa * wa + ac * (1 - wa) - ya) / n) - ((1 - wa) - 0.4 * (ac * wa + cc * (1 - wa) - yc) / n)) / 2))
          FROM w JOIN tr ON w.fold_id = tr.fold_id WHERE i < 400),
      f AS (SELECT fold_id, wa FROM w WHERE i = 400),
      e AS (SELECT sum(pow(target - wa * a - (1 - wa) * c, 2)) / count(*) AS loss,
          least(avg(pow(target - a, 2)), avg(pow(target - c, 2))) AS best FROM scored JOIN f USING (fold_id)),
      o AS (SELECT fold_id, wa FROM f UNION ALL SELECT 'final', avg(wa) FROM f)"""


@query(
    "mlj1_simplex_blend_crossfit",
    f"""{BLEND_SQL} SELECT fold_id, candidate_id, {r6("weight")} AS weight, {r6("loss")} AS loss,
      {r6("best")} AS best_single_loss, {r6("best - loss")} AS gain
    FROM (SELECT fold_id, 'a' AS candidate_id, wa AS weight FROM o UNION ALL SELECT fold_id, 'c', 1 - wa FROM o), e""",
)
def _(t):
    made = O.simplex_blend_crossfit(t.scored(), "target", "fold_id", ("a", "c"))
    return made.select(
        "fold_id", "candidate_id", *[rounded(c).alias(c) for c in ("weight", "loss", "best_single_loss", "gain")]
    )


@query(
    "mlj2_weighted_blend",
    f"WITH {SCORED} SELECT doc_id, {r6('0.25 * a + 0.45 * b + 0.3 * c')} AS blended FROM scored",
)
def _(t):
    oof = t.oof_long()
    weights = O.weights_frame(oof, {"A": 0.25, "B": 0.45, "C": 0.3})
    made = O.weighted_blend(oof, weights, ["row_id"], "oof_prediction", ["candidate_id"])
    return made.select(F.col("row_id").cast("long").alias("doc_id"), rounded("blended").alias("blended"))


@query(
    "mlj3_histogram_calibration",
    f"""WITH {SCORED}, r AS (SELECT greatest(0, least(19, CAST(trunc(a * 20) AS INT))) AS bin, avg(target) AS r
        FROM scored WHERE fold_id <> '0' GROUP BY 1),
      x AS (SELECT doc_id, greatest(0, least(19, CAST(trunc(a * 20) AS INT))) AS bin FROM scored WHERE fold_id = '0')
    SELECT doc_id, {r6("coalesce(r, (x.bin + 0.5) / 20)")} AS calibrated FROM x LEFT JOIN r ON x.bin = r.bin""",
)
def _(t):
    rows = t.scored()
    made = O.histogram_calibration(rows.filter("fold_id <> '0'"), rows.filter("fold_id = '0'"), "a", "target")
    return made.select("doc_id", rounded("calibrated").alias("calibrated"))


@query(
    "mlj4_isotonic_calibration",
    f"""WITH {ENTITY}, s AS (SELECT event_id, user_id / 150.0::DOUBLE AS p, y, is_fit FROM entity),
      x AS (SELECT p, row_number() OVER (ORDER BY p) AS i, CAST(sum(y) AS DOUBLE) AS s, count(*) AS n
        FROM s WHERE is_fit GROUP BY p),
      c AS (SELECT i, p, sum(s) OVER (ORDER BY i) AS cs, sum(n) OVER (ORDER BY i) AS cn, s, n FROM x),
      a AS (SELECT j.i AS j, k.i AS k, (k.cs - j.cs + j.s) / (k.cn - j.cn + j.n) AS m FROM c j JOIN c k ON j.i <= k.i),
      low AS (SELECT j, k AS i, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM a),
      v AS (SELECT x.i, x.p, max(m) AS value FROM low JOIN x ON x.i = low.i WHERE j <= x.i GROUP BY ALL),
      top AS (SELECT value FROM v ORDER BY i DESC LIMIT 1),
      q AS (SELECT s.event_id, min(v.i) AS i FROM s LEFT JOIN v ON s.p <= v.p WHERE NOT is_fit GROUP BY s.event_id)
    SELECT event_id, {r6("coalesce(v.value, (SELECT value FROM top))")} AS calibrated FROM q LEFT JOIN v ON q.i = v.i""",
)
def _(t):
    rows = t.entity_events().withColumn("p", F.col("user_id") / 150.0)
    steps = O.fit_isotonic(rows.filter("is_fit"), "p", "y")
    return O.apply_steps(rows.filter("NOT is_fit"), steps, "p").select("event_id", rounded("calibrated").alias("calibrated"))


@query(
    "mlj10_blend_and_score",
    f"""{BLEND_SQL}, b AS (SELECT CAST(target AS BIGINT) AS y, wa * a + (1 - wa) * c AS s FROM scored JOIN f USING (fold_id)),
      r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM b)
    SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, {r6("(sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y)))")} AS auc
    FROM r""",
)
def _(t):
    weights = O.simplex_blend_crossfit(t.scored(), "target", "fold_id", ("a", "c"))
    weights = weights.filter("fold_id <> 'final'").select("fold_id", F.upper("candidate_id").alias("candidate_id"), "weight")
    made = O.blend_and_score(t.oof_long(), weights, "row_id", "fold_id", "candidate_id", "oof_prediction", "target")
    return made.select("n", "positives", rounded("auc").alias("auc"))


@query(
    "src8_submission_with_ids",
    """SELECT row_number() OVER (ORDER BY c_name DESC) AS position, c_custkey, c_acctbal AS prediction FROM customer""",
)
def _(t):
    from foldwright.operators.columns import opaque_row_ids
    from foldwright.operators.ordering import with_row_number

    customer = t.customer.select("c_custkey", "c_name", "c_acctbal")
    view, id_map = opaque_row_ids(customer, "c_custkey", offset=1_000_000)
    sample = with_row_number(customer.select("c_custkey", "c_name"), [F.desc("c_name")], "position")
    made = submit.submission_with_ids(
        view.select("row_id", F.col("c_acctbal").alias("prediction")), id_map, sample, "row_id", "c_custkey", "position"
    )
    return made.checked()


@query(
    "src9_submission_validate",
    """WITH s AS (SELECT CASE WHEN l_orderkey % 997 = 0 THEN '' ELSE CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) END AS id,
        CASE WHEN l_orderkey % 500 = 1 THEN 'n/a' WHEN l_orderkey % 500 = 2 THEN '1.7' ELSE CAST(l_discount AS VARCHAR) END AS p
        FROM lineitem),
      v AS (SELECT id, TRY_CAST(p AS DOUBLE) AS p FROM s)
    SELECT count(*) AS row_count, count(*) FILTER (id = '') AS empty_ids,
      count(*) FILTER (id <> '') - count(DISTINCT id) FILTER (id <> '') AS duplicate_rows,
      count(*) FILTER (id <> '' AND p IS NULL) AS non_numeric, count(*) FILTER (id <> '' AND (p < 0 OR p > 1)) AS outside_range,
      min(p) FILTER (id <> '' AND p BETWEEN 0 AND 1) AS minimum, max(p) FILTER (id <> '' AND p BETWEEN 0 AND 1) AS maximum,
      false AS valid FROM v""",
)
def _(t):
    key = F.col("l_orderkey")
    rows = t.lineitem.select(
        F.when(key % 997 == 0, "").otherwise((key * 10 + F.col("l_linenumber")).cast("string")).alias("id"),
        F.when(key % 500 == 1, "n/a").when(key % 500 == 2, "1.7").otherwise(F.col("l_discount").cast("string")).alias("p"),
    )
    return submit.submission_validate(rows, "id", "p", 60_000)
