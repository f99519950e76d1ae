"""Bootstraps, nulls and gates: properties and planted controls."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.operators import resample as B


@pytest.fixture(scope="module")
def linked(spark):
    rng = random.Random(6)
    rows = []
    for period in range(12):
        for client in range(30):
            risk = 0.9 if client % 5 == 0 else 0.05
            rows.append((len(rows), client, period, client % 3, client % 7, int(rng.random() < risk)))
    return spark.createDataFrame(rows, "id long, uid long, period int, miss int, dev int, y int").cache()


@pytest.mark.parametrize("max_rows", [5, 10_000])
def test_shuffle_keeps_every_stratum(linked, max_rows):
    made = B.matched_null_shuffle(linked, "uid", "id", "period", ["miss"], 3, 2, max_rows=max_rows).collect()
    before, after, moved = Counter(), Counter(), 0
    for r in made:
        before[(r.rep, r.period, r.miss, r.uid)] += 1
        after[(r.rep, r.period, r.miss, r.shuffled)] += 1
        moved += r.uid != r.shuffled
    assert before == after and moved > len(made) / 2


def test_split_and_plain_shuffles_agree(linked):
    take = lambda m: sorted((r.id, r.shuffled) for r in B.matched_null_shuffle(linked, "uid", "id", "period", ["miss"], 3, max_rows=m).collect())
    assert take(5) == take(10_000)


def test_planted_link_is_found_and_its_shuffle_is_not(linked):
    def verdict(rows):
        statistics = B.matched_null_statistics(rows, "uid", "id", "period", "y", "dev", ["miss"], 3, 4, 8, 42, 20)
        return B.matched_null_test(statistics).first()

    assert verdict(linked)["rejects_null"]
    broken = B.matched_null_shuffle(linked, "uid", "id", "period", ["miss"], 99).drop("uid", "rep").withColumnRenamed("shuffled", "uid")
    assert verdict(broken)["real_auc"] < verdict(linked)["real_auc"] - 0.1


def test_strata_are_permuted_by_the_stated_rule(spark):
    """Many strata in one batch, a stratum over several batches, and null strata, labels and periods."""
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None, *map(str, range(40))]) if i % 3 else "large", f"l{i}" if i % 11 else None) for i in range(25_000)]
    df = spark.createDataFrame(rows, "id long, s string, label string").repartition(5)
    expected = {}
    for rep in (1, 2, 3):
        for s in {r[1] for r in rows}:
            by_id = [r for r in rows if r[1] == s]
            by_draw = sorted(by_id, key=lambda r: (int(hashlib.md5(f"4:{rep}:{r[0]}".encode()).hexdigest()[:15], 16), r[0]))
            expected.update({(rep, a[0]): (a[1], a[2], b[2]) for a, b in zip(by_id, by_draw)})
    for max_rows in (None, 1000):
        made = B.stratified_shuffle(df, ["s"], "id", "label", 4, 3, max_rows=max_rows).collect()
        assert len(made) == len(expected) and {(r.rep, r.id): (r.s, r.label, r.shuffled) for r in made} == expected


def test_a_shuffle_moves_rows_once_for_all_repetitions(spark, linked):
    made = B.stratified_shuffle(linked, ["period", "miss"], "id", "uid", 3, 20)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_null_statistics_of_large_entities_agree(spark, linked):
    odd = linked.withColumn("period", F.when(F.col("id") % 29 != 0, F.col("period"))).withColumn("dev", F.when(F.col("id") % 13 != 0, F.col("dev")))
    odd = odd.withColumn("uid", F.when(F.col("id") % 17 != 0, F.col("uid")))

    def take(rows, max_rows):
        made = B.matched_null_statistics(rows, "uid", "id", "period", "y", "dev", ["miss"], 3, 4, 8, 42, 4, max_rows=max_rows)
        return {r.rep: (r.auc, r.agreement, r.persistence) for r in made.collect()}

    plain = take(odd, None)
    assert set(plain) == set(range(5)) and take(odd, 5) == plain


def _means(rows, n_reps, seed, **options):
    return {(r["k"], r["_rep"]): r["_mean"] for r in B.bootstrap_means(rows, ["k"], "task", "d", n_reps, seed, **options).collect()}


def _plain_means(values, reps, seed, chunk):
    """Replicate means of one group by the stated rule: hashed index draws up to `chunk` rows, a walk of the whole tree beyond."""
    n, made = len(values), {}
    if n <= chunk:
        draw = lambda rep, slot: int(hashlib.md5(f"{seed}:{rep}:{slot}".encode()).hexdigest()[:15], 16) % n
        return {rep: sum(values[draw(rep, slot)] for slot in range(1, n + 1)) / n for rep in range(1, reps + 1)}
    generator = lambda *parts: np.random.Generator(np.random.Philox(key=int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest(), 16)))
    for first in range(1, reps + 1, 128):
        width = min(128, reps - first + 1)
        sums, held = [0.0] * width, [0] * width

        def walk(low, high, counts):
            if high - low > 1:
                middle = (low + high) // 2
                left = [x for k in range(low, middle) for x in range(k * chunk, min(n, (k + 1) * chunk))]
                all_rows = [x for k in range(low, high) for x in range(k * chunk, min(n, (k + 1) * chunk))]
                taken = generator("split", seed, n, first, low, high).binomial(counts, len(left) / len(all_rows))
                walk(low, middle, taken)
                walk(middle, high, counts - taken)
                return
            part = values[low * chunk : (low + 1) * chunk]
            at = iter(generator("draw", seed, n, first, low).integers(0, len(part), int(counts.sum())).tolist())
            for i, count in enumerate(counts.tolist()):
                held[i] += count
                sums[i] += sum(part[next(at)] for _ in range(count))

        walk(0, -(-n // chunk), np.full(width, n))
        assert held == [n] * width
        made.update({first + i: sums[i] / n for i in range(width)})
    return made


@pytest.mark.parametrize("chunk", [4096, 39, 4])
def test_pieces_of_a_group_follow_the_plain_walk(spark, chunk):
    rng = random.Random(8)
    groups = {k: [rng.gauss(1, 2) for _ in range(n)] for k, n in (("a", 40), (None, 23), ("c", 7), ("d", 1))}
    rows = spark.createDataFrame([(k, i, v) for k, values in groups.items() for i, v in enumerate(values)], "k string, task long, d double")
    expected = {(k, rep): m for k, values in groups.items() for rep, m in _plain_means(values, 150, 7, chunk).items()}
    assert _means(rows, 150, 7, chunk=chunk) == pytest.approx(expected)


def test_a_group_of_a_hundred_thousand_rows(spark):
    n, seed = 100_000, 3
    values = [math.sin(i) + (i % 1000 == 0) for i in range(n)]
    rows = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("task"), (F.sin("id") + (F.col("id") % 1000 == 0).cast("int")).alias("d"))
    got = _means(rows, 3, seed)
    assert {rep: m for (_, rep), m in got.items()} == pytest.approx(_plain_means(values, 3, seed, B.CHUNK))


def test_replicates_of_a_large_group_spread_as_an_index_bootstrap_does(spark):
    n = 9000
    values = [math.sin(i) for i in range(n)]
    rows = spark.createDataFrame([("a", *v) for v in enumerate(values)], "k string, task long, d double")
    means = np.array(list(_means(rows, 2000, 5, chunk=1000).values()))
    error = np.std(values) / math.sqrt(n)
    assert abs(means.mean() - np.mean(values)) < 5 * error / math.sqrt(2000)
    assert means.std() == pytest.approx(error, rel=0.08)


def test_a_null_value_drawn_makes_the_replicate_zero_at_every_size(spark):
    values = [1.0, None, 3.0, 5.0, 7.0]
    rows = spark.createDataFrame([("a", *v) for v in enumerate(values)], "k string, task long, d double")
    for chunk in (10, 2):
        assert {m == 0 for m in _means(rows, 60, 1, chunk=chunk).values()} == {True, False}


def test_long_gate_arrays_have_the_bound_of_short_ones(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [0.1, 0.5, 0.2, 0.9]), (2, [0.3]), (3, [0.7, 0.1, 0.4])], "id int, v array<double>")
    read = lambda: {r["id"]: r["_low_v"] for r in B.add_array_bounds(rows, "id", ["v"], repetitions=60).collect()}
    short = read()
    monkeypatch.setattr(B, "CHUNK", 2)
    assert read() == pytest.approx(short)


def test_short_gate_arrays_cost_as_many_means_as_they_have_different_draws(spark):
    sizes = spark.createDataFrame([(1,), (2,), (3,)], "_n long")
    folded = {}
    for r in B.distinct_draws(sizes, 2000, 42).collect():
        folded.setdefault(r["_n"], []).append(r["_times"])
    assert {n: sum(times) for n, times in folded.items()} == {1: 2000, 2: 2000, 3: 2000}
    assert all(len(times) <= n**n for n, times in folded.items())
    arrays = [[0.1, -0.2, 0.4], [0.3], [0.1, None, 0.2], [0.5, 0.7]]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "id long, v array<double>")
    made = {r["id"]: r["_low_v"] for r in B.add_array_bounds(rows, "id", ["v"], 0.5, 200).collect()}
    for i, values in enumerate(arrays):
        n = len(values)
        drawn = [[values[at % n] for at in row] for row in B.index_draws(42, 1, 200, n)]
        means = [None if None in d else sum(d) / n for d in drawn]
        assert made[i] == sorted(means, key=lambda m: (m is None, m or 0.0))[99]


def test_twelve_tasks_and_two_points_do_not_separate(spark):
    noise = [math.sin(i * 2.399) * 20 for i in range(12)]
    rows = [("x", f"t{i}", 50 + n) for i, n in enumerate(noise)] + [("y", f"t{i}", 52 + math.cos(i * 1.7) * 20 + n) for i, n in enumerate(noise)]
    scores = spark.createDataFrame(rows, "c string, task string, v double")
    assert not B.compare_pairs(scores, "c", "task", "v", resamples=500).first()["separated"]
    tiers = B.gated_ranking(scores, "c", "task", "v", resamples=500)
    assert {r.tier for r in tiers.collect()} == {1}
    with pytest.raises(B.ContractError):
        B.total_order(tiers, "c")


def test_clear_difference_separates(spark):
    rows = [(c, f"t{i}", 50 + i + 9 * (c == "y") + (i % 3)) for c in "xy" for i in range(20)]
    scores = spark.createDataFrame([(c, t, float(v)) for c, t, v in rows], "c string, task string, v double")
    verdict = B.compare_pairs(scores, "c", "task", "v", resamples=300).first()
    assert verdict["separated"] and verdict["better"] == "y"


def test_spread_floor_widens(spark):
    rows = spark.createDataFrame([("a", i, 1.0) for i in range(16)], "k string, task long, d double")
    flat = B.paired_bootstrap_interval(rows, ["k"], "task", "d", 200).first()
    wide = B.paired_bootstrap_interval(rows, ["k"], "task", "d", 200, minimum_spread=4.0).first()
    assert flat["low"] == flat["high"] == 1.0
    assert wide["low"] == pytest.approx(1 - 1.959963984540054) and wide["high"] == pytest.approx(1 + 1.959963984540054)


def test_futility_needs_five_nulls(spark):
    rows = spark.createDataFrame([("h", i, 1.0, 0.5) for i in range(8)], "h string, i long, g double, real double")
    made = B.sequential_futility(rows, "h", "i", "g", "real").orderBy("repetitions").collect()
    assert [r.stop for r in made] == [False] * 4 + [True] * 4
