"""Run states from raw events against a plain walk of the log; stateful streams against their batch twins."""

import json
import random

import pytest

from foldwright.operators import runlog as L
from foldwright.operators import runstate as R

EVENTS = "run_id string, sequence long, event_id string, event_type string, occurred_at string, payload string"
COSTS = ("cpu_hours", "gpu_hours", "wall_hours", "llm_tokens", "monetary_cost")


def walk(events):
    """{(entity, id, field): value} of one run's events in order; lists stay lists. None where there is no creation."""
    out, proposals, usage, born = {}, {}, None, False
    run = events[0][0]

    def charge(cost, sign=1.0, floor=False):
        for f in COSTS:
            name = "cost" if f == "monetary_cost" else f
            usage[name] += sign * cost.get(f, 0.0)

    for _, _, _, kind, at, p in events:
        r = lambda f: ("run", run, f)
        if kind == "RUN_CREATED":
            born = True
            out |= {r("status"): p["status"], r("phase"): p["phase"], r("finalized_at"): None}
            usage = {f: p["budget_usage"].get(f, 0.0) for f in R.USAGE}
        elif kind == "STATE_CHANGED":
            out[r("loop_state")] = p["state"]
            if p.get("run_status") and born:
                out[r("status")] = p["run_status"]
        elif kind == "PHASE_CHANGED":
            out[r("phase")] = p["phase"]
            if p["phase"] != "exploitation":
                out[r("brief")] = None
        elif kind == "RESEARCH_BRIEF_CREATED":
            out[r("brief")] = p["id"]
        elif kind == "VIOLATION_DETECTED":
            out[r("violations")] = out.get(r("violations"), 0) + 1
            if born:
                out[r("status")] = "blocked"
        elif kind == "RUN_FINALIZED":
            out[r("phase")] = "finalized"
            if born:
                out |= {r("status"): "completed", r("finalized_at"): at}
        elif kind in ("HYPOTHESIS_PROPOSED", "HYPOTHESIS_REVISED"):
            out |= {("hypothesis", p["id"], "confidence"): p["current_confidence"], ("hypothesis", p["id"], "version"): p.get("version", 1)}
        elif kind == "BELIEF_UPDATED" and ("hypothesis", p["hypothesis_id"], "version") in out:
            out[("hypothesis", p["hypothesis_id"], "confidence")] = p["posterior_confidence"]
            out[("hypothesis", p["hypothesis_id"], "version")] += 1
        elif kind == "EXPERIMENT_PROPOSED":
            proposals[p["id"]] = p
            out.setdefault(("experiment", p["id"], "status"), p["status"])
        elif kind == "EXPERIMENT_SELECTED":
            for i in p.get("rejected_reasons", {}):
                out[("experiment", i, "status")] = "rejected"
            for i in p["selected_experiment_ids"]:
                out[("experiment", i, "status")] = "selected"
                out.setdefault(r("selection_order"), []).append(i)
                if i in proposals and usage is not None:
                    usage["experiments"] += 1
                    charge(proposals[i]["estimated_cost"])
        elif kind == "EXPERIMENT_STARTED":
            out |= {("experiment", p["experiment_id"], "status"): "running", ("experiment", p["experiment_id"], "attempt"): p.get("attempt", 1)}
        elif kind in ("EXPERIMENT_COMPLETED", "EXPERIMENT_FAILED"):
            out[("experiment", p["experiment_id"], "status")] = kind.split("_")[1].lower()
        elif kind == "VALIDATION_WORLD_REGISTERED":
            w = lambda f: ("world", p["id"], f)
            out |= {w("posterior"): p["posterior_probability"], w("version"): p.get("version", 1), w("evidence"): list(p["evidence_ids"])}
        elif kind == "VALIDATION_POSTERIOR_UPDATED":
            for i, value in p["posterior"].items():
                if ("world", i, "version") in out:
                    out[("world", i, "posterior")] = value
                    out[("world", i, "version")] += 1
                    out[("world", i, "evidence")] = [*out[("world", i, "evidence")], p["evidence_id"]]
        elif kind == "RESOURCE_RECONCILED" and usage is not None:
            for f in COSTS:
                name = "cost" if f == "monetary_cost" else f
                usage[name] = max(0.0, usage[name] - p["estimated"].get(f, 0.0) + p["charged"].get(f, 0.0))
        elif kind == "AGENT_RESOURCE_RECORDED" and usage is not None:
            usage["llm_tokens"] += p["total_tokens"]
            usage["cost"] += p["monetary_cost"]
        elif kind == "EXPERIMENT_RETRY_SCHEDULED" and usage is not None:
            charge(p["charged_cost"])
    if not born:
        return None
    return {k: v for k, v in out.items() if v != []} | {("run", run, f"usage.{f}"): usage[f] for f in R.USAGE}


def random_log(rng, run, n, created=True):
    cost = lambda: {f: rng.choice([0.0, 0.5, 2.0]) for f in rng.sample(COSTS, 4)}
    h, x, w = (lambda letter, m: lambda: f"{letter}{rng.randrange(m)}")("h", 3), (lambda: f"x{rng.randrange(4)}"), (lambda: f"w{rng.randrange(2)}")
    makers = {
        "STATE_CHANGED": lambda: {"state": f"S{rng.randrange(3)}", "run_status": rng.choice([None, "", "running"])},
        "PHASE_CHANGED": lambda: {"phase": rng.choice(["exploitation", "discovery"])},
        "RESEARCH_BRIEF_CREATED": lambda: {"id": f"b{rng.randrange(9)}"},
        "VIOLATION_DETECTED": dict, "RUN_FINALIZED": dict,
        "HYPOTHESIS_PROPOSED": lambda: {"id": h(), "current_confidence": rng.random()},
        "HYPOTHESIS_REVISED": lambda: {"id": h(), "current_confidence": rng.random(), "version": 4},
        "BELIEF_UPDATED": lambda: {"hypothesis_id": h(), "posterior_confidence": rng.random()},
        "EXPERIMENT_PROPOSED": lambda: {"id": x(), "status": rng.choice(["proposed", "draft"]), "estimated_cost": cost()},
        "EXPERIMENT_SELECTED": lambda: {"selected_experiment_ids": [x() for _ in range(rng.randrange(3))], "rejected_reasons": {x(): "why"} if rng.random() < 0.6 else {}},
        "EXPERIMENT_STARTED": lambda: {"experiment_id": x()} | ({"attempt": 2} if rng.random() < 0.5 else {}),
        "EXPERIMENT_COMPLETED": lambda: {"experiment_id": x()}, "EXPERIMENT_FAILED": lambda: {"experiment_id": x()},
        "VALIDATION_WORLD_REGISTERED": lambda: {"id": w(), "posterior_probability": rng.random(), "evidence_ids": [f"e{k}" for k in range(rng.randrange(3))]},
        "VALIDATION_POSTERIOR_UPDATED": lambda: {"posterior": {f"w{k}": rng.random() for k in range(2)}, "evidence_id": f"u{rng.randrange(99)}"},
        "RESOURCE_RECONCILED": lambda: {"estimated": cost(), "charged": cost()},
        "AGENT_RESOURCE_RECORDED": lambda: {"total_tokens": rng.randrange(50), "monetary_cost": 0.25},
        "EXPERIMENT_RETRY_SCHEDULED": lambda: {"charged_cost": cost()},
    }
    kinds = [rng.choice(list(makers)) for _ in range(n)]
    events = [(kind, makers[kind]()) for kind in kinds]
    if created:
        at = rng.randrange(3)
        events.insert(at, ("RUN_CREATED", {"id": run, "status": "created", "phase": "discovery", "budget_usage": {"cost": 1.5}}))
    return [(run, k, f"{run}-{k}", kind, f"t{k}", p) for k, (kind, p) in enumerate(events, 1)]


def folded(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.place):
        key = (r.entity, r.id, r.field)
        if r.place:
            out.setdefault(key, []).append(r.text)
        elif r.field in ("confidence", "version", "violations", "attempt", "posterior") or r.field.startswith("usage."):
            out[key] = pytest.approx(r.number)
        else:
            out[key] = r.text
    return out


def test_run_state_equals_a_plain_walk(spark):
    rng = random.Random(11)
    logs = [random_log(rng, f"r{k}", rng.choice([1, 12, 150]), created=k % 6 != 5) for k in range(18)]
    rows = [(*e[:5], json.dumps(e[5])) for log in logs for e in log]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, EVENTS)
    by_run = {}
    for r in R.run_state(frame, max_rows=40).collect():
        by_run.setdefault(r.run_id, []).append(r)
    for log in logs:
        got, expected = by_run[log[0][0]], walk(log)
        if expected is None:
            assert [(r.field, r.text) for r in got] == [("error", R.NO_RUN)]
        else:
            assert expected == folded(got)


def test_patches_compose_per_field(spark):
    rows = [("f", 1, 0, "add", None, 2.0), ("f", 2, 0, "set", None, 10.0), ("f", 2, 1, "add", None, 1.0), ("f", 3, 0, "bump", None, 1.0), ("g", 1, 0, "change", "x", None), ("g", 2, 0, "bump", None, 1.0),
            ("h", 5, 0, "default", "late", None), ("h", 2, 0, "default", "first", None), ("i", 1, 0, "set", "a", None), ("i", 3, 0, "default", "b", None), ("i", 2, 0, "change", None, None), ("j", 1, 0, "add", None, 4.0)]
    frame = spark.createDataFrame(rows, "field string, sequence long, place int, op string, text string, number double")
    assert {tuple(r) for r in R.fold_patches(frame, ["field"]).collect()} == {("f", None, 12.0), ("h", "first", None), ("i", None, None), ("j", None, 4.0)}
    assert R.run_state(spark.createDataFrame([], EVENTS)).count() == 0


def test_entity_tables_replace_change_and_ignore_repeats(spark):
    rows = [
        ("r", 1, "a", "EXPERIMENT_STARTED", "t", {"experiment_id": "x"}), ("r", 2, "b", "EXPERIMENT_PROPOSED", "t", {"id": "x", "experiment_type": "e", "status": "proposed"}),
        ("r", 3, "c", "EXPERIMENT_SELECTED", "t", {"selected_experiment_ids": ["x", "unknown"]}), ("r", 4, "d", "EXPERIMENT_FAILED", "t", {"experiment_id": "x"}),
        ("r", 5, "b", "EXPERIMENT_PROPOSED", "t", {"id": "x", "experiment_type": "again", "status": "proposed"}), ("r", 6, "v", "VIOLATION_DETECTED", "t", {}),
    ]
    made = R.entity_tables(spark.createDataFrame([(*e[:5], json.dumps(e[5])) for e in rows], EVENTS)).collect()
    assert {(r.entity, r.id, r.label, r.status) for r in made} == {("experiments", "x", "e", "failed"), ("violations", "v", None, None)}


def test_payloads_are_parsed_once_and_repeats_shuffle_no_payload(spark):
    log = random_log(random.Random(3), "r", 40, created=True)
    frame = spark.createDataFrame([(*e[:5], json.dumps(e[5])) for e in log], EVENTS)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for made in (R.usage_deltas(R.parsed(frame)), R.run_state(frame), R.entity_tables(frame)):
        assert "from_json" not in plan(made)


def parts(spark, tmp_path, name, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}*")


@pytest.mark.parametrize("policy, most", [("gated_binary", 5), ("open", 0), ("strict_blind", 3)])
def test_streamed_gate_equals_batch_out_of_order(spark, tmp_path, policy, most):
    from foldwright.streaming import gates

    rng = random.Random(3)
    schema = "run string, sequence long, score double, threshold double, reveal_score boolean"
    rows = [(run, s, rng.random(), rng.choice([None, 0.5, 0.5]), rng.random() < 0.2) for run in ("a", "b") for s in range(1, 30)]
    batch = sorted(map(tuple, L.query_budget_gate(spark.createDataFrame(rows, schema), "run", "sequence", policy, most).collect()))
    rng.shuffle(rows)
    stream = parts(spark, tmp_path, "q", [rows[:20], [*rows[20:35], *rows[:4]], rows[35:]], schema)
    made = gates.run_with_keyed_state(gates.stream_query_gate(stream, "run", "sequence", policy, most), "gate-test")
    assert sorted(map(tuple, made.collect())) == batch


def test_admission_knows_old_events_and_rivals(spark, tmp_path):
    from foldwright.streaming import gates

    schema = "run string, sequence long, event_id string, ts string"
    batches = [[("r", 1, "a", "2020"), ("r", 3, "c", "2020"), ("s", 1, "z", "2020")], [("r", 2, "b", "2021"), ("r", 3, "other", "2021")], [("r", 1, "a", "2030"), ("r", 3, "other", "2030"), ("s", 2, None, "2030")]]
    made = gates.run_with_keyed_state(gates.stream_admission(parts(spark, tmp_path, "e", batches, schema), "run", "sequence", "event_id"), "admission-test")
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(
        [("r", 1, "a", None), ("r", 2, "b", None), ("r", 3, "c", None), ("r", 3, "other", "sequence_taken"), ("s", 1, "z", None), ("s", 2, "null", None)], key=repr
    )
