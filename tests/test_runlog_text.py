"""Log folds against sequential walks, similarity joins against brute force, streams against batches."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from foldwright.operators import runlog as L
from foldwright.operators import selection as K
from foldwright.operators import text as X
from foldwright.operators.audit import ContractError


def chain(run, n):
    rows, previous = [], None
    for sequence in range(1, n + 1):
        body = {"payload": f"p{sequence}", "previous_hash": previous, "run_id": run, "sequence": sequence}
        digest = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        rows.append((run, sequence, body["payload"], previous, digest))
        previous = digest
    return rows


@pytest.mark.parametrize("max_rows", [10, 10_000])
def test_hash_chain_accepts_a_true_chain_and_finds_an_edit(spark, max_rows):
    schema = "run_id string, sequence long, payload string, previous_hash string, event_hash string"
    fields = ("payload", "previous_hash", "run_id", "sequence")
    rows = chain("a", 30) + chain("b", 12)
    check = lambda d: L.hash_chain_violations(spark.createDataFrame(d, schema), "run_id", "sequence", fields, "previous_hash", "event_hash", max_rows=max_rows)
    assert check(rows).isEmpty()
    edited = [(*r[:2], "x", *r[3:]) if r[:2] == ("a", 7) else r for r in rows]
    assert [tuple(r) for r in L.first_violation(check(edited), "run_id", "sequence").collect()] == [("a", 7, "digest")]
    assert {tuple(r) for r in check([r for r in rows if r[:2] != ("b", 4)]).collect()} == {("b", 5, "sequence")}


@pytest.mark.parametrize("max_rows", [50, 10_000])
def test_clipped_walks_match_a_sequential_fold(spark, max_rows):
    rng = random.Random(2)
    updates = [("long", i, rng.choice([2.0, 0.5, -0.5, -2.0])) for i in range(700)] + [("short", i, 1.0) for i in range(3)]
    frame = spark.createDataFrame(updates, "h string, s long, w double")
    priors = spark.createDataFrame([("long", 0.99), ("short", 0.4)], "h string, prior double")
    got = {(r.h, r.s): r.confidence for r in L.belief_trajectory(frame, priors, "h", "s", "w", "prior", max_rows=max_rows).collect()}
    state = {"long": 0.99, "short": 0.4}
    clip = lambda p: min(0.95, max(0.05, p))
    for h, s, w in updates:
        p = clip(state[h])
        state[h] = clip(1 / (1 + math.exp(-(math.log(p / (1 - p)) + w))))
        assert got[(h, s)] == pytest.approx(state[h], abs=1e-9)


@pytest.mark.parametrize("max_rows", [20, 10_000])
def test_budget_never_falls_below_zero(spark, max_rows):
    rng = random.Random(5)
    deltas = [("r", i, rng.uniform(-3, 2)) for i in range(300)]
    frame = spark.createDataFrame(deltas, "run string, s long, cost double")
    got = {r.s: r.cost for r in L.budget_running_totals(frame, "run", "s", ["cost"], max_rows=max_rows).collect()}
    usage = 0.0
    for _, s, d in deltas:
        usage = max(0.0, usage + d)
        assert got[s] == pytest.approx(usage, abs=1e-9)


def test_query_budget_of_one_leaks_no_number(spark):
    rows = [("r", 1, 0.9, 0.5, True), ("r", 2, 0.9, 0.5, False), ("r", 3, 0.2, 0.5, False)]
    frame = spark.createDataFrame(rows, "run string, s long, score double, threshold double, reveal_score boolean")
    made = L.query_budget_gate(frame, "run", "s", "gated_binary", 1).orderBy("s").collect()
    assert [r.refusal for r in made] == ["NUMERIC_SCORE_REQUEST", None, "QUERY_BUDGET_EXCEEDED"]
    assert all(r.revealed_score is None for r in made) and made[1].passed
    strict = L.query_budget_gate(frame, "run", "s", "strict_blind", 0).collect()
    assert {r.refusal for r in strict} == {"STRICT_BLIND_QUERY"}


def test_set_pairs_match_brute_force(spark):
    rng = random.Random(7)
    base = rng.sample(range(80), 25)
    sets = {}
    for i in range(70):
        source = base if i % 2 else rng.sample(range(80), rng.randrange(1, 30))
        members = {t for t in source if rng.random() > 0.08} | {rng.randrange(80)}
        sets[i] = sorted(members)
    distinct = {tuple(v): k for k, v in reversed(list(sets.items()))}
    rows = spark.createDataFrame([("x", k, [f"t{t}" for t in v]) for v, k in distinct.items()], "g string, id long, tokens array<string>")
    got = {(r.id_l, r.id_r) for r in X.similar_set_pairs(rows, ["g"], "id", "tokens", 0.8).collect()}
    items = sorted((k, set(v)) for v, k in distinct.items())
    expected = {(a, b) for i, (a, s) in enumerate(items) for b, t in items[i + 1 :] if len(s & t) / len(s | t) >= 0.8}
    assert got == expected and expected


def test_set_candidates_stay_few_in_a_fixed_vocabulary(spark):
    rng = random.Random(12)
    sets = {i: set(rng.sample(range(1500), rng.choice((20, 90, 400)))) for i in range(240)}
    for i in range(240, 280):
        kept = set(rng.sample(sorted(sets[i - 240]), int(0.9 * len(sets[i - 240]))))
        sets[i] = kept | set(range(2000 + i, 2000 + i + rng.randrange(1, 12)))
    rows = spark.createDataFrame([("x", i, [f"w{t}" for t in s]) for i, s in sets.items()], "g string, id long, tokens array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r.id_l, r.id_r) for r in X.similar_set_pairs(rows, ["g"], "id", "tokens", 0.8).collect()} == want and len(want) > 20
    coded = rows.withColumn("_n", F.size("tokens")).withColumn("_codes", X._token_codes("tokens"))
    # Thousands of pairs share one of the rarest tokens; nearly none of them may leave the join.
    assert X._set_candidates(coded, ["g"], "id", 0.8).count() <= 2 * len(want)


def test_merge_prefers_the_earliest_best(spark):
    rows = [(1, "h", "one two three four five"), (2, "h", "One two, three four five!"), (3, "h", "one two three four five six"), (4, "g", "one two three four five"), (5, "h", ""), (6, "h", "!!")]
    made = X.merge_candidates(spark.createDataFrame(rows, "id long, k string, t string"), "id", "k", "t")
    got = {r.id: (r.match_id, round(r.similarity, 4)) for r in made.collect()}
    assert got == {2: (1, 1.0), 3: (1, 0.8333), 6: (5, 1.0)}


def _near_copies(rng, groups, copies, common):
    """Claims of a fixed vocabulary in groups of near copies; the first words are frequent."""
    words = [f"w{i}" for i in range(600)]
    claims = {}
    for _ in range(groups):
        base = words[:common] + rng.sample(words[common:], rng.choice((6, 30, 90)))
        for _ in range(rng.randrange(1, copies)):
            kept = [w for w in base if rng.random() > rng.choice((0.0, 0.02, 0.1))]
            claims[len(claims)] = kept + [f"x{rng.randrange(40)}" for _ in range(rng.randrange(3))]
    return {k: v for k, v in claims.items() if v}


def _plain_best(claims, threshold):
    best = {}
    for k, v in claims.items():
        near = [(len(set(v) & set(u)) / len(set(v) | set(u)), -i) for i, u in claims.items() if i < k]
        top = max(near, default=(0.0, 0))
        if top[0] >= threshold:
            best[k] = (-top[1], round(top[0], 9))
    return best


@pytest.mark.parametrize("frequent, words", [(5, 8), (40, 1)])
def test_merge_finds_the_best_of_many_near_copies(spark, monkeypatch, frequent, words):
    # Few words of a sketch make bounds loose; few sets make nearly every token frequent.
    monkeypatch.setattr(X, "FREQUENT_SETS", frequent)
    monkeypatch.setattr(X, "SKETCH_WORDS", words)
    claims = _near_copies(random.Random(frequent), 25, 12, 3)
    rows = spark.createDataFrame([(k, "h", " ".join(v)) for k, v in claims.items()], "id long, k string, t string")
    made = X.merge_candidates(rows, "id", "k", "t").collect()
    want = _plain_best(claims, 0.8)
    assert {r.id: (r.match_id, round(r.similarity, 9)) for r in made} == want
    assert len(made) == len(want) and any(s < 0.95 for _, s in want.values()) and any(0.95 <= s < 1 for _, s in want.values())


def test_merge_verifies_few_of_the_pairs_of_a_large_group(spark, monkeypatch):
    pairs, verified = [], X._verified
    monkeypatch.setattr(X, "_verified", lambda candidates, *rest: pairs.append(candidates.count()) or verified(candidates, *rest))
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    claims = {k: [w for w in base if rng.random() > 0.05] for k in range(150)}
    made = X.merge_candidates(spark.createDataFrame([(k, "h", " ".join(v)) for k, v in claims.items()], "id long, k string, t string"), "id", "k", "t")
    assert {r.id: (r.match_id, round(r.similarity, 9)) for r in made.collect()} == _plain_best(claims, 0.8)
    # 11,175 pairs are similar.
    assert sum(pairs) < 2000


def test_similar_sets_of_frequent_tokens_meet_by_two(spark, monkeypatch):
    rng = random.Random(5)
    sets = {i: set(rng.sample(range(60), rng.randrange(1, 14))) for i in range(300)}
    for i in range(300, 330):
        sets[i] = sets[i - 300] ^ {rng.randrange(60)}
    distinct = {tuple(sorted(v)): k for k, v in reversed(list(sets.items())) if v}
    rows = spark.createDataFrame([("x", k, [f"w{t}" for t in v]) for v, k in distinct.items()], "g string, id long, tokens array<string>")
    coded = rows.withColumn("_n", F.size("tokens")).withColumn("_codes", X._token_codes("tokens"))
    counts, joined = X._code_counts(coded), []
    for frequent in (10**9, 5):
        monkeypatch.setattr(X, "FREQUENT_SETS", frequent)
        prefixes = coded.select("id", F.lit(1).cast("long"), F.col("_n").cast("int"), "_codes", F.lit(1)).mapInArrow(
            X._part_prefixes(counts, 0.8), "_key long, _item long, _seeks int, _n int, _held int, _pos int, _bits long"
        )
        joined.append(prefixes.groupBy("_key").count().agg(F.sum(F.expr("count * (count - 1)"))).first()[0])
    assert joined[1] < joined[0] / 3
    got = {(r.id_l, r.id_r) for r in X.similar_set_pairs(rows, ["g"], "id", "tokens", 0.8).collect()}
    items = sorted((k, set(v)) for v, k in distinct.items())
    assert got == {(a, b) for i, (a, s) in enumerate(items) for b, t in items[i + 1 :] if len(s & t) / len(s | t) >= 0.8} and len(got) > 20


def test_components_match_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    nodes = sorted({*range(60), *range(100, 131)})
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    frame = spark.createDataFrame(edges, "a long, b long")
    made = X.connected_components(frame, spark.createDataFrame([(n,) for n in nodes], "n long"), "a", "b", "n")
    assert {r.n: r.component for r in made.collect()} == {n: find(n) for n in nodes}


def test_signature_edges_match_brute_force(spark):
    rng = random.Random(10)
    word = lambda p, n: f"{p}{rng.randrange(n)}"
    rows = [
        (i, sorted({word("h", 6) for _ in range(4)}), [word("s", 2)], sorted({word("o", 3), word("o", 3)}), [word("b", 2)], [word("d", 2)], rng.random() < 0.5)
        for i in range(120)
    ]
    schema = "id long, target_hypotheses array<string>, data_slice array<string>, operation array<string>, observable array<string>, decision_affected array<string>, candidate_producing boolean"
    signatures, _ = X.fold_signatures(spark.createDataFrame(rows, schema), "id")
    first = {r.signature: r for r in signatures.collect()}
    expected = set()
    names = sorted(first)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = first[a], first[b]
            parts = [len(set(x[f]) & set(y[f])) / len(set(x[f]) | set(y[f])) for f in X.SIGNATURE_FIELDS] + [float(x.candidate_producing == y.candidate_producing)]
            if sum(parts) / 6 >= 0.85:
                expected.add((a, b))
    assert {(r.left_signature, r.right_signature) for r in X.signature_edges(signatures).collect()} == expected and expected


def test_cycles_are_refused(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, depends_on long")
    with pytest.raises(ContractError):
        K.dependency_levels(edges, spark.createDataFrame([(1,), (2,), (3,)], "node long"))


def test_spend_decision_order(spark):
    candidates = spark.createDataFrame([("a", "f1", 0.9, 0.01), ("b", "f2", 0.8, 0.01)], "name string, fingerprint string, estimate double, noise double")
    empty = spark.createDataFrame([], "fingerprint string, estimate double, public_score double")
    assert K.spend_decision(candidates, empty, 0, "maximize").first().reason == "allowance_spent"
    assert tuple(K.spend_decision(candidates, empty, 1, "maximize").first())[:3] == (True, "first_point", "a")
    one = spark.createDataFrame([("f1", 0.9, 0.7)], "fingerprint string, estimate double, public_score double")
    assert tuple(K.spend_decision(candidates, one, 1, "maximize").first())[:3] == (True, "calibrating", "b")
    spent = spark.createDataFrame([("f1", 0.9, 0.7), ("f2", 0.8, 0.6)], "fingerprint string, estimate double, public_score double")
    assert K.spend_decision(candidates, spent, 1, "maximize").first().reason == "all_submitted"


def test_aggregation_stream_keeps_keys_of_every_batch(spark, tmp_path):
    from foldwright.streaming import folds

    batches = [[(1, 1, "a"), (2, 2, "b")], [(1, 3, "c")], [(3, 4, "d"), (2, 1, "old")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "e long, s long, v string").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    stream = spark.readStream.schema("e long, s long, v string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    latest = folds.run_to_completion(folds.stream_latest(stream, ["e"], "s", "v"), "latest-test", ["e"])
    assert sorted(tuple(r) for r in latest.select("e", "v", "s").collect()) == [(1, "c", 3), (2, "b", 2), (3, "d", 4)]


def test_streamed_run_state_equals_batch(spark, tmp_path):
    from foldwright.streaming import folds

    rows = [("r", 1, "RUN_CREATED", "discovery", "created", None), ("r", 2, "PHASE_CHANGED", "exploitation", None, None), ("r", 3, "RESEARCH_BRIEF_CREATED", None, None, None),
            ("r", 4, "PHASE_CHANGED", "discovery", None, None), ("s", 1, "RUN_CREATED", "discovery", "created", None), ("s", 2, "VIOLATION_DETECTED", None, None, None)]
    schema = "run string, sequence long, event_type string, phase string, run_status string, loop_state string"
    frame = spark.createDataFrame(rows, schema)
    batch = sorted(map(str, L.run_state_fold(frame, "run", "sequence").collect()))
    frame.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    made = folds.run_to_completion(folds.stream_run_state(stream, "run", "sequence"), "state", ["run"])
    assert sorted(map(str, made.select(*L.run_state_fold(frame, "run", "sequence").columns).collect())) == batch
    state = {r.run: r for r in made.collect()}
    assert state["r"].brief_sequence is None and state["s"].status == "blocked"
