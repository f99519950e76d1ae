"""Queries for tabular scans, fingerprints and row-set hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.operators import folds as S
from foldwright.plans.folds import HASH
from foldwright.plans.registry import query
from foldwright.session import scratch_path
from foldwright.sources import tabular as source

SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, day date, o_orderpriority string"


def _csv(t):
    path = scratch_path(t.spark, "orders-csv")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    rows.write.csv(path, header=True)
    return path


@query(
    "src6_scan_tabular_by_time",
    """SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS position FROM orders""",
)
def _(t):
    return source.scan_tabular_pruned(t.spark, _csv(t), SCHEMA, ["o_totalprice"], "o_orderkey", "day")


@query(
    "src6_scan_tabular_shuffled",
    f"SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY {HASH.format(chr(39) + '3:' + chr(39) + ' || o_orderkey')}, o_orderkey) - 1 AS position FROM orders",
)
def _(t):
    return source.scan_tabular_pruned(t.spark, _csv(t), SCHEMA, ["o_custkey"], "o_orderkey", None, 3)


@query("src10_dataset_fingerprint")
def _(t):
    return source.dataset_fingerprint(t.spark, t.folder, "*.parquet")


@query(
    "src11_row_set_hash",
    f"""WITH o AS (SELECT CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'research' ELSE 'sealed' END AS part,
        {HASH.format("'rows:' || (epoch_us(o_orderdate) // 1000000) || ':' || o_orderkey")} AS h FROM orders)
    SELECT part, count(*) AS rows, bit_xor(h) AS xor_hash, CAST(sum(h) AS VARCHAR) AS sum_hash FROM o GROUP BY part""",
)
def _(t):
    rows = t.orders.select("o_orderkey", F.unix_seconds("o_orderdate").alias("t"))
    return source.row_set_hash(S.research_sealed_partition(rows, "o_orderkey", "t"), ["part"], ["t", "o_orderkey"])
