"""Queries against their SQL where ties, rounding or unusual inputs decided before."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from check import TABLES, canonical
from foldwright.operators.studies import sign_test_p

LARGER = "/root/testdata/sf0.1"


def agree(spark, folder, name):
    made = contract.queries()[name](spark, str(folder))
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{LARGER}/{table}.parquet'")
    for path in folder.glob("*.parquet") if folder != LARGER else ():
        connection.execute(f"CREATE OR REPLACE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = connection.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    return canonical([tuple(r) for r in made.collect()], made.columns) == canonical(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", [
    "agg4_rank_reversal_rate", "agg5_kendall_tau_b", "agg29_paired_arm_statistics", "agg43_alarm_threshold", "sca3_information_gain",
])
def test_larger_tables_agree(spark, name):
    assert agree(spark, LARGER, name)


def test_arms_with_equal_values_in_another_order_tie(spark, tmp_path):
    """The users of an arm hold one of two sets of values, each in many orders."""
    values = "[0.1, 0.2, 0.3, 1e6, 0.7, 123456.78, 0.01]"
    duckdb.sql(f"""COPY (SELECT u * 7 + i AS event_id, TIMESTAMP '2024-01-01' AS ts, u::BIGINT AS user_id, 'view' AS event_type,
        {values}[(i * (1 + u // 3 % 6) + u // 3) % 7 + 1]::DOUBLE + u // 3 % 2 * 5 AS value, '' AS props FROM range(60) a(u), range(7) b(i)) TO '{tmp_path}/events.parquet'""")
    assert agree(spark, tmp_path, "agg29_arm_outcomes")
    ranks = {r["spearman"] for r in contract.queries()["agg29_arm_outcomes"](spark, str(tmp_path)).collect()}
    assert ranks == {1.0}  # scores tie just where the largest values do


def test_sign_test_of_thousands_of_pairs(spark):
    cases = [(0, 0), (0, 1), (3, 3), (5, 12), (1450, 3000), (1600, 3000), (14_900, 30_000), (0, 2000)]
    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", sign_test_p(F.col("k"), F.col("n")).alias("p"))
    for k, n, p in rows.collect():
        exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n) if n and n < 1000 else None
        if exact is None and n:
            tail, term, total = min(k, n - k), 1, 0
            for i in range(tail + 1):
                total += term
                term = term * (n - i) // (i + 1)
            exact = float(min(1, 2 * total / (1 << n))) if total else 1.0
        assert p == pytest.approx(1.0 if exact is None else exact, rel=1e-8, abs=1e-12)
