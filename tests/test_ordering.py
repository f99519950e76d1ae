"""Ordered building blocks: the split path for hot keys must equal the plain one."""

import random

import pytest
from pyspark.sql import functions as F

from foldwright.operators import ordering as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(("hot" if i % 3 else f"k{i % 7}"), (5 if i % 2 else rng.randrange(40)), i, rng.random()) for i in range(600)]
    return spark.createDataFrame(data, "k string, t long, id long, v double").cache()


def brute(data, ties):
    expected = {}
    for r in data:
        earlier = [
            o for o in data if o.k == r.k and (o.t < r.t if ties == "exclude" else (o.t, o.id) < (r.t, r.id))
        ]
        expected[r.id] = (round(sum(o.v for o in earlier), 9), max((o.v for o in earlier), default=None))
    return expected


@pytest.mark.parametrize("ties", ["rows", "exclude"])
@pytest.mark.parametrize("max_rows", [10, 10_000])
def test_prefix_matches_brute_force(rows, ties, max_rows):
    made = O.prefix_by_key(rows, ["k"], ["t", "id"], {"s": F.col("v")}, {"m": F.col("v")}, ties=ties, max_rows=max_rows)
    got = {r.id: (round(r.s, 9), r.m) for r in made.collect()}
    assert got == brute(rows.collect(), ties)


@pytest.mark.parametrize("partitions", ["1", "7", "50"])
def test_numbers_do_not_depend_on_partitioning(spark, rows, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.id: r.n for r in O.with_row_number(rows.repartition(5), ["t", "id"], "n", total="all").collect()}
        hot = {r.id: r.n for r in O.number_by_key(rows, [], ["t", "id"], "n", max_rows=20).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted((r.t, r.id) for r in rows.collect())
    assert got == {i: n for n, (_, i) in enumerate(order, 1)} == hot


@pytest.mark.parametrize("max_rows", [8, 10_000])
def test_average_rank_and_quantiles(rows, max_rows):
    data = rows.collect()
    ranked = O.average_rank(rows, "t", ["k"], "r", max_rows=max_rows).collect()
    for r in ranked[::37]:
        peers = [o.t for o in data if o.k == r.k]
        assert r.r == sum(o < r.t for o in peers) + (sum(o == r.t for o in peers) + 1) / 2
    values = sorted(o.v for o in data)
    low = O.exact_quantile(rows, "v", 0.1, rule="nearest", max_rows=max_rows).first()[0]
    assert low == values[59]
    mid = O.exact_quantile(rows, "v", 0.5, rule="linear", max_rows=max_rows).first()[0]
    assert mid == pytest.approx((values[299] + values[300]) / 2)


@pytest.mark.parametrize("max_rows", [12, 10_000])
def test_neighbours_cross_block_edges(rows, max_rows):
    build = lambda w: {"b": F.sum("v").over(w.rowsBetween(-3, -1)), "a": F.lead("id").over(w)}
    got = {r.id: (None if r.b is None else round(r.b, 9), r.a) for r in O.with_neighbours(rows, ["k"], ["t", "id"], build, before=3, after=1, max_rows=max_rows).collect()}
    for key in {r.k for r in rows.collect()}:
        line = sorted((r for r in rows.collect() if r.k == key), key=lambda r: (r.t, r.id))
        for i, r in enumerate(line):
            recent = line[max(0, i - 3) : i]
            expected = round(sum(o.v for o in recent), 9) if recent else None
            assert got[r.id] == (expected, line[i + 1].id if i + 1 < len(line) else None)


@pytest.mark.parametrize("max_rows", [20, 10_000])
def test_medians_of_heavy_groups_and_groups_without_values(spark, rows, max_rows):
    from statistics import median

    lone = spark.createDataFrame([(None, 1, 1000, 2.5), ("empty", 1, 1001, None)], "k string, t long, id long, v double")
    data = rows.unionByName(lone)
    made = data.groupBy("k").agg(F.count("*").alias("n"))
    got = {r.k: (r.n, r.mv, r.mt) for r in O.with_medians(made, data, ["k"], {"mv": F.col("v"), "mt": F.when(F.col("t") > 3, F.col("t"))}, max_rows=max_rows).collect()}
    by_key = {}
    for r in data.collect():
        by_key.setdefault(r.k, []).append(r)
    middle = lambda values: median(values) if values else None
    for k, group in by_key.items():
        want = middle([r.v for r in group if r.v is not None]), middle([r.t for r in group if r.t > 3])
        assert got[k][0] == len(group) and got[k][1] == pytest.approx(want[0]) and got[k][2] == want[1]
    whole = O.with_medians(data.agg(F.count("*").alias("n")), data, [], {"mv": F.col("v")}, max_rows=max_rows).collect()
    assert [(r.n, r.mv) for r in whole] == [(602, pytest.approx(median([r.v for r in data.collect() if r.v is not None])))]
