"""Queries for fold assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.operators import folds as S
from foldwright.plans.registry import query

HASH = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"

EVENTS_NUMBERED = """e AS (SELECT event_id, user_id, epoch_us(ts) AS t,
    row_number() OVER (ORDER BY ts, event_id) AS row_no, count(*) OVER () AS n FROM events)"""


def blocks(parts: int) -> str:
    return f"b AS (SELECT *, ntile({parts}) OVER (ORDER BY row_no) - 1 AS block FROM e)"


def roles(n_splits: int, gap: int) -> str:
    return f"""{EVENTS_NUMBERED}, {blocks(n_splits + 1)},
      f AS (SELECT i AS fold, max(row_no) - {gap} AS train_end FROM b, range({n_splits}) r(i)
        WHERE block <= i GROUP BY i),
      r AS (SELECT CAST(fold AS VARCHAR) AS fold_id, event_id, user_id, row_no, train_end,
        CASE WHEN block = fold + 1 THEN 'validation' WHEN row_no <= train_end THEN 'train' ELSE 'purged' END AS role
        FROM b JOIN f ON block <= fold + 1)"""


def _events(t):
    return t.events.select("event_id", "user_id", F.unix_micros("ts").alias("t"))


@query(
    "spl1_random_folds",
    f"""SELECT o_orderkey, (row_number() OVER (ORDER BY {HASH.format("'42:' || o_orderkey")}, o_orderkey) - 1) % 5 AS fold
    FROM orders""",
)
def _(t):
    return S.random_folds(t.orders, "o_orderkey", 5, 42)


@query(
    "spl2_group_folds",
    """WITH RECURSIVE g AS (SELECT o_custkey, count(*) AS size, row_number() OVER (
          ORDER BY count(*) DESC, CAST(o_custkey AS VARCHAR)) AS i FROM orders GROUP BY o_custkey),
      walk(i, o_custkey, size, fold, l0, l1, l2, l3, l4) AS (
        SELECT 0::BIGINT, NULL::BIGINT, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT
        UNION ALL
        SELECT p.i, p.o_custkey, p.size, p.f,
          l0 + CASE WHEN p.f = 0 THEN p.size ELSE 0 END, l1 + CASE WHEN p.f = 1 THEN p.size ELSE 0 END,
          l2 + CASE WHEN p.f = 2 THEN p.size ELSE 0 END, l3 + CASE WHEN p.f = 3 THEN p.size ELSE 0 END,
          l4 + CASE WHEN p.f = 4 THEN p.size ELSE 0 END
        FROM (SELECT g.i, g.o_custkey, g.size, l0, l1, l2, l3, l4,
            CASE least(l0, l1, l2, l3, l4) WHEN l0 THEN 0 WHEN l1 THEN 1 WHEN l2 THEN 2 WHEN l3 THEN 3 ELSE 4 END AS f
          FROM walk w JOIN g ON g.i = w.i + 1) p)
    SELECT o_custkey, size, fold FROM walk WHERE i > 0""",
)
def _(t):
    return S.group_folds(t.orders, "o_custkey", 5)


@query("spl3_time_folds", f"WITH {roles(4, 25)} SELECT fold_id, event_id, role FROM r")
def _(t):
    return S.time_folds(_events(t), "event_id", "t", 4, 25).select("fold_id", "event_id", "role")


@query(
    "spl4_time_group_folds",
    f"""WITH {roles(4, 25)}, v AS (SELECT DISTINCT fold_id, user_id FROM r WHERE role = 'validation')
    SELECT r.fold_id, event_id, r.user_id,
      CASE WHEN role = 'train' AND v.user_id IS NOT NULL THEN 'purged' ELSE role END AS role
    FROM r LEFT JOIN v ON r.fold_id = v.fold_id AND r.user_id = v.user_id""",
)
def _(t):
    return S.time_group_folds(_events(t), "event_id", "t", "user_id", 4, 25).select("fold_id", "event_id", "user_id", "role")


@query("spl5_multi_horizon_folds", f"WITH {roles(3, 10)} SELECT fold_id, event_id, role FROM r")
def _(t):
    return S.multi_horizon_folds(_events(t), "event_id", "t", 3, 10).select("fold_id", "event_id", "role")


@query(
    "spl6_rolling_window_folds",
    f"WITH {roles(3, 10)} SELECT fold_id, event_id, role FROM r WHERE role <> 'train' OR row_no > train_end - 1000",
)
def _(t):
    return S.rolling_window_folds(_events(t), "event_id", "t", 1000, 3, 10).select("fold_id", "event_id", "role")


DAY = 86_400
ORDERS_NUMBERED = """o AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS t,
    row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_no, count(*) OVER () AS n FROM orders)"""


def _orders(t):
    return t.orders.select("o_orderkey", F.unix_seconds("o_orderdate").alias("t"))


@query(
    "spl7_fraction_horizon_folds",
    f"""WITH {ORDERS_NUMBERED},
      k AS (SELECT i AS fold, (SELECT CAST(floor((0.4::DOUBLE + (1 - 0.4::DOUBLE) / 3 * i) * max(n)) AS BIGINT) FROM o) AS s,
        (SELECT CASE WHEN i = 2 THEN max(n) ELSE CAST(floor((0.4::DOUBLE + (1 - 0.4::DOUBLE) / 3 * (i + 1)) * max(n)) AS BIGINT)
          END FROM o) AS e FROM range(3) r(i)),
      c AS (SELECT k.*, o.t - 7 * {DAY} AS cutoff FROM k JOIN o ON o.row_no = k.s + 1)
    SELECT fold, o_orderkey, CASE WHEN row_no > s AND row_no <= e THEN 'validation' ELSE 'train' END AS role
    FROM o, c WHERE (row_no > s AND row_no <= e) OR t < cutoff""",
)
def _(t):
    return S.fraction_horizon_folds(_orders(t), "o_orderkey", "t").select("fold", "o_orderkey", "role")


@query(
    "spl8_crossfit_plan",
    f"""WITH {ORDERS_NUMBERED}, research AS (SELECT * FROM o WHERE row_no <= floor(n * 0.8::DOUBLE)),
      m AS (SELECT count(*) AS total FROM research),
      k AS (SELECT i AS fold, CAST(round_even((i + 1) * total / 4.0, 0) AS BIGINT) AS s,
        CAST(round_even((i + 2) * total / 4.0, 0) AS BIGINT) AS e FROM m, range(3) r(i)),
      c AS (SELECT k.*, r.t - 7 * {DAY} AS cutoff FROM k JOIN research r ON r.row_no = k.s + 1)
    SELECT fold, o_orderkey, CASE WHEN row_no > s THEN 'validation' ELSE 'train' END AS role
    FROM research, c WHERE (row_no > s AND row_no <= e) OR (row_no <= s AND t < cutoff)""",
)
def _(t):
    return S.crossfit_plan(_orders(t), "o_orderkey", "t").select("fold", "o_orderkey", "role")


@query(
    "spl9_research_sealed_partition",
    f"""WITH {ORDERS_NUMBERED} SELECT o_orderkey,
      CASE WHEN row_no <= floor(n * 0.8::DOUBLE) THEN 'research' ELSE 'sealed' END AS part FROM o""",
)
def _(t):
    return S.research_sealed_partition(_orders(t), "o_orderkey", "t").select("o_orderkey", "part")


@query(
    "spl10_segments_60_20_20",
    f"""WITH {ORDERS_NUMBERED} SELECT o_orderkey, CASE WHEN row_no <= floor(n * 0.6::DOUBLE) THEN 'research'
      WHEN row_no <= floor(n * 0.8::DOUBLE) THEN 'confirmation' ELSE 'transfer' END AS segment FROM o""",
)
def _(t):
    return S.segments_60_20_20(_orders(t), "o_orderkey", ["t", "o_orderkey"], ["t"]).select("o_orderkey", "segment")


SIZES = (500, 150, 150)


@query(
    "spl11_windowed_sample_split",
    f"""WITH {EVENTS_NUMBERED}, s AS (SELECT {HASH.format("'7:window'")} % (count(*) - 800 + 1) AS start FROM events)
    SELECT event_id, row_no - start - 1 AS position, CASE WHEN row_no - start <= 500 THEN 'research'
      WHEN row_no - start <= 650 THEN 'confirmation' ELSE 'transfer' END AS segment
    FROM e, s WHERE row_no > start AND row_no <= start + 800""",
)
def _(t):
    return S.sample_split(_events(t), "event_id", "t", SIZES, 7)


@query(
    "spl11_shuffled_sample_split",
    f"""WITH e AS (SELECT event_id, row_number() OVER (ORDER BY {HASH.format("'7:' || event_id")}, event_id) AS row_no FROM events)
    SELECT event_id, row_no - 1 AS position, CASE WHEN row_no <= 500 THEN 'research'
      WHEN row_no <= 650 THEN 'confirmation' ELSE 'transfer' END AS segment FROM e WHERE row_no <= 800""",
)
def _(t):
    return S.sample_split(_events(t), "event_id", None, SIZES, 7)


@query(
    "spl12_sample_segment",
    f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {HASH.format(chr(39) + '3:' + chr(39) + ' || o_orderkey')}, o_orderkey LIMIT 400",
)
def _(t):
    return S.sample_segment(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 400, 3)


@query(
    "spl13_fold_audit",
    f"""WITH {roles(4, 0)}, d AS (SELECT fold_id, event_id, role FROM r
        UNION ALL SELECT fold_id, event_id, 'validation' FROM r WHERE event_id % 97 = 0 AND role = 'train')
    SELECT fold_id, event_id, count(*) AS n, count(DISTINCT role) AS roles FROM d GROUP BY ALL HAVING count(*) > 1""",
)
def _(t):
    folds = S.time_folds(_events(t), "event_id", "t", 4, 0).select("world_id", "fold_id", "event_id", "role")
    planted = folds.filter((F.col("event_id") % 97 == 0) & (F.col("role") == "train")).withColumn("role", F.lit("validation"))
    return S.fold_audit(folds.unionByName(planted), "event_id").select("fold_id", "event_id", "n", "roles")


@query(
    "spl14_task_sample",
    f"""SELECT 'selection' AS purpose, p_partkey FROM (SELECT p_partkey FROM part
        ORDER BY {HASH.format("'0:selection:' || p_partkey")}, p_partkey LIMIT 64)
    UNION ALL SELECT 'iteration', p_partkey FROM (SELECT p_partkey FROM part
        ORDER BY {HASH.format("'0:iteration:3:' || p_partkey")}, p_partkey LIMIT 12)""",
)
def _(t):
    selection = S.task_sample(t.part, "p_partkey", 64, "selection").withColumn("purpose", F.lit("selection"))
    iteration = S.task_sample(t.part, "p_partkey", 12, "iteration", 3).withColumn("purpose", F.lit("iteration"))
    return selection.unionByName(iteration)
