"""Run states and entity tables from raw events, by typed patches.

Every event becomes rows (run, entity, id, field, sequence, place, operation, text, number). Operations:

    set      makes the field, whatever came before
    default  makes the field where nothing has made it yet
    change   sets the field of an entity that exists
    add      adds to the field since it was last made, or since the beginning
    bump     adds to the field of an entity that exists
    append   puts an id behind the field's list since it was last made

They compose per field without regard to how rows are grouped: the latest maker is a maximum, and what was added after
it is a sum, so both are partial aggregates and no run is ever held in one task. Lists stay exploded, one row per place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.operators.ordering import join_null_safe, number_by_key, prefix_by_key
from foldwright.operators.runlog import budget_running_totals
from foldwright.session import cut_lineage

_COST = "struct<cpu_hours:double,gpu_hours:double,wall_hours:double,llm_tokens:double,monetary_cost:double>"
#: The payload fields that the folds read.
PAYLOAD = (
    "id string, run_id string, competition_id string, mode string, phase string, status string, state string, run_status string, finalized_at string, "
    "type string, experiment_type string, split_type string, current_confidence double, version double, hypothesis_id string, posterior_confidence double, "
    "experiment_id string, attempt double, candidate_id string, proposer_agent string, agent string, selected_experiment_ids array<string>, "
    "rejected_reasons map<string,string>, posterior map<string,double>, posterior_probability double, evidence_id string, evidence_ids array<string>, "
    f"total_tokens double, monetary_cost double, estimated_cost {_COST}, charged_cost {_COST}, estimated {_COST}, charged {_COST}, "
    "budget_usage struct<experiments:double,cpu_hours:double,gpu_hours:double,wall_hours:double,llm_tokens:double,cost:double>"
)
USAGE = ("experiments", "cpu_hours", "gpu_hours", "wall_hours", "llm_tokens", "cost")
NO_RUN = "event log does not contain a RunCreated event"
_PATCH = "struct<entity:string,id:string,field:string,place:int,op:string,text:string,number:double>"


def parsed(events: DataFrame) -> DataFrame:
    """Raw events (run_id, sequence, event_id, event_type, occurred_at, payload as JSON text) with the payload's fields in `p`."""
    return events.select(
        F.col("run_id").cast("string").alias("run_id"), F.col("sequence").cast("long").alias("sequence"), F.col("event_id").cast("string").alias("event_id"),
        "event_type", F.col("occurred_at").cast("string").alias("occurred_at"), F.from_json(F.col("payload").cast("string"), PAYLOAD).alias("p"),
    )


def _patch(entity: str, id: Column, field: str, op: str, text: Column | None = None, number: Column | None = None, place: Column | int = 0) -> Column:
    none = F.lit(None)
    parts = {
        "entity": F.lit(entity), "id": id, "field": F.lit(field), "place": F.lit(place) if isinstance(place, int) else place, "op": F.lit(op),
        "text": (none if text is None else text).cast("string"), "number": (none if number is None else number).cast("double"),
    }
    return F.struct(*[c.alias(n) for n, c in parts.items()]).cast(_PATCH)


def _of_each(ids: Column, make) -> Column:
    """Patches of every id of an array, in its order."""
    return F.coalesce(F.transform(ids, make), F.array().cast(f"array<{_PATCH}>"))


def _patches_of(rules: Mapping[tuple[str, ...], list[Column]]) -> Column:
    """The array of an event's patches; a rule gives arrays of patches for its event types."""
    none = F.array().cast(f"array<{_PATCH}>")
    return reduce(lambda rest, rule: F.when(F.col("event_type").isin(*rule[0]), F.concat(*rule[1])).otherwise(rest), rules.items(), none)


def _spread(events: DataFrame, rules: Mapping[tuple[str, ...], list[Column]]) -> DataFrame:
    """One row per patch."""
    return events.select("run_id", "sequence", F.explode(_patches_of(rules)).alias("x")).select("run_id", "sequence", "x.*")


def state_patches(events: DataFrame) -> DataFrame:
    """The patches of the run state (STR3) of parsed events."""
    p, run = F.col("p"), F.col("run_id")
    number = F.col("sequence")

    def status(ids: Column, value: str, place: int) -> Column:
        return _of_each(ids, lambda i: _patch("experiment", i, "status", "set", F.lit(value), place=place))

    return _spread(events, {
        ("RUN_CREATED",): [F.array(
            _patch("run", run, "status", "set", p["status"]), _patch("run", run, "finalized_at", "set", p["finalized_at"]), _patch("run", run, "phase", "set", p["phase"]),
        )],
        ("STATE_CHANGED",): [
            F.array(_patch("run", run, "loop_state", "set", p["state"])),
            F.when(F.length(p["run_status"]) > 0, F.array(_patch("run", run, "status", "change", p["run_status"]))).otherwise(F.array().cast(f"array<{_PATCH}>")),
        ],
        ("PHASE_CHANGED",): [
            F.array(_patch("run", run, "phase", "set", p["phase"])),
            F.when(p["phase"] != "exploitation", F.array(_patch("run", run, "brief", "set"))).otherwise(F.array().cast(f"array<{_PATCH}>")),
        ],
        ("RESEARCH_BRIEF_CREATED",): [F.array(_patch("run", run, "brief", "set", p["id"], number))],
        ("VIOLATION_DETECTED",): [F.array(_patch("run", run, "violations", "add", number=F.lit(1)), _patch("run", run, "status", "change", F.lit("blocked")))],
        ("RUN_FINALIZED",): [F.array(
            _patch("run", run, "phase", "set", F.lit("finalized")), _patch("run", run, "status", "change", F.lit("completed")),
            _patch("run", run, "finalized_at", "change", F.col("occurred_at")),
        )],
        ("HYPOTHESIS_PROPOSED", "HYPOTHESIS_REVISED"): [F.array(
            _patch("hypothesis", p["id"], "confidence", "set", number=p["current_confidence"]),
            _patch("hypothesis", p["id"], "version", "set", number=F.coalesce(p["version"], F.lit(1.0))),
        )],
        ("BELIEF_UPDATED",): [F.array(
            _patch("hypothesis", p["hypothesis_id"], "confidence", "change", number=p["posterior_confidence"]),
            _patch("hypothesis", p["hypothesis_id"], "version", "bump", number=F.lit(1)),
        )],
        ("EXPERIMENT_PROPOSED",): [F.array(_patch("experiment", p["id"], "status", "default", p["status"]))],
        ("EXPERIMENT_SELECTED",): [
            status(F.map_keys(p["rejected_reasons"]), "rejected", 0), status(p["selected_experiment_ids"], "selected", 1),
            F.coalesce(F.transform(p["selected_experiment_ids"], lambda i, k: _patch("run", run, "selection_order", "append", i, place=k)), F.array().cast(f"array<{_PATCH}>")),
        ],
        ("EXPERIMENT_STARTED",): [status(F.array(p["experiment_id"]), "running", 0), F.array(
            _patch("experiment", p["experiment_id"], "attempt", "set", number=F.coalesce(p["attempt"], F.lit(1.0))),
        )],
        ("EXPERIMENT_COMPLETED",): [status(F.array(p["experiment_id"]), "completed", 0)],
        ("EXPERIMENT_FAILED",): [status(F.array(p["experiment_id"]), "failed", 0)],
        ("VALIDATION_WORLD_REGISTERED",): [F.array(
            _patch("world", p["id"], "posterior", "set", number=p["posterior_probability"]),
            _patch("world", p["id"], "version", "set", number=F.coalesce(p["version"], F.lit(1.0))), _patch("world", p["id"], "evidence", "set"),
        ), F.coalesce(F.transform(p["evidence_ids"], lambda i, k: _patch("world", p["id"], "evidence", "append", i, place=k + 1)), F.array().cast(f"array<{_PATCH}>"))],
        ("VALIDATION_POSTERIOR_UPDATED",): [
            _of_each(F.map_entries(p["posterior"]), lambda e: _patch("world", e["key"], "posterior", "change", number=e["value"])),
            _of_each(F.map_keys(p["posterior"]), lambda i: _patch("world", i, "version", "bump", number=F.lit(1))),
            _of_each(F.map_keys(p["posterior"]), lambda i: _patch("world", i, "evidence", "append", p["evidence_id"])),
        ],
    })


_FIELD = ("run_id", "entity", "id", "field")


def fold_patches(patches: DataFrame, keys: Sequence[str] = _FIELD) -> DataFrame:
    """The value of every field: keys, text, number. A field that was only changed or bumped does not exist."""
    order, op = F.struct("sequence", "place"), F.col("op")
    value = F.struct("text", "number")
    last = patches.groupBy(*keys).agg(
        F.max_by(value, F.when(op.isin("set", "change"), order)).alias("_last"), F.max(F.when(op == "set", order)).alias("_set"),
        F.min_by(value, F.when(op == "default", order)).alias("_default"), F.count_if(op == "default").alias("_defaults"), F.count_if(op == "add").alias("_adds"),
    ).filter(F.col("_set").isNotNull() | (F.col("_defaults") + F.col("_adds") > 0))
    additions = patches.filter(op.isin("add", "bump"))
    made = last.filter(F.col("_set").isNotNull()).select(*keys, "_set")
    added = join_null_safe(additions, made, keys).filter(
        F.when(F.col("_set").isNull(), op == "add").otherwise(order > F.col("_set"))
    ).groupBy(*keys).agg(F.sum("number").alias("_sum"))
    start = F.when(F.col("_set").isNotNull(), F.col("_last")).otherwise(F.col("_default"))
    more = F.col("_sum")
    number = F.when(more.isNull(), start["number"]).otherwise(F.coalesce(start["number"], F.lit(0.0)) + more)
    return join_null_safe(last, added, keys).select(*keys, start["text"].alias("text"), number.alias("number"))


def fold_lists(patches: DataFrame, keys: Sequence[str] = _FIELD, needs_maker: Sequence[str] = ("world",), *, max_rows: int | None = None) -> DataFrame:
    """The list of every field, one row per place from 1 on: keys, place, text. Entities in `needs_maker` have lists only once made."""
    order = F.struct("sequence", "place")
    made = patches.filter(F.col("op") == "set").groupBy(*keys).agg(F.max(order).alias("_set"))
    entries = join_null_safe(patches.filter(F.col("op") == "append"), made, keys)
    kept = entries.filter(F.when(F.col("_set").isNull(), ~F.col("entity").isin(*needs_maker)).otherwise(order > F.col("_set")))
    numbered = number_by_key(kept.withColumn("_place", F.col("place").cast("long")), keys, ["sequence", "_place"], "_no", max_rows=max_rows)
    return numbered.select(*keys, F.col("_no").alias("place"), "text")


def usage_deltas(events: DataFrame, *, max_rows: int | None = None) -> DataFrame:
    """What every event adds to its run's usage (STR4), from parsed events: run_id, sequence and one column per usage field.

    A selection charges the latest proposal before it; selections of unknown experiments charge nothing. A reconciliation
    takes the estimate back and charges what was used. A run's usage begins with its latest creation.
    """
    p, kind = F.col("p"), F.col("event_type")
    zero = F.lit(0.0)
    cost = lambda c: {"cpu_hours": c["cpu_hours"], "gpu_hours": c["gpu_hours"], "wall_hours": c["wall_hours"], "llm_tokens": c["llm_tokens"], "cost": c["monetary_cost"]}
    given, taken = cost(p["charged"]), cost(p["estimated"])
    direct = {
        "RUN_CREATED": {f: p["budget_usage"][f] for f in USAGE},
        "AGENT_RESOURCE_RECORDED": {"llm_tokens": p["total_tokens"], "cost": p["monetary_cost"]},
        "EXPERIMENT_RETRY_SCHEDULED": cost(p["charged_cost"]),
        "RESOURCE_RECONCILED": {f: F.coalesce(given[f], zero) - F.coalesce(taken[f], zero) for f in given},
    }
    proposal = {"experiments": F.lit(1.0), **cost(p["estimated_cost"])}
    amounts = {**direct, "EXPERIMENT_PROPOSED": proposal}
    # The payloads are read once; every step below reads this narrow table.
    read = cut_lineage(events.filter(kind.isin(*amounts, "EXPERIMENT_SELECTED")).select(
        "run_id", "sequence", "event_type",
        *[F.coalesce(reduce(lambda rest, e: F.when(kind == e[0], e[1].get(f, zero)).otherwise(rest), amounts.items(), zero), zero).alias(f) for f in USAGE],
        F.when(kind == "EXPERIMENT_PROPOSED", p["id"]).alias("id"), F.when(kind == "EXPERIMENT_SELECTED", p["selected_experiment_ids"]).alias("selected"),
    ))
    plain = read.filter(kind.isin(*direct)).select("run_id", "sequence", *USAGE)
    proposed = read.filter(kind == "EXPERIMENT_PROPOSED").select(
        "run_id", "id", "sequence", F.lit(0).cast("long").alias("place"), F.col("sequence").alias("_proposed")
    )
    chosen = read.filter(kind == "EXPERIMENT_SELECTED").select("run_id", "sequence", F.posexplode("selected").alias("place", "id"))
    chosen = chosen.select("run_id", "id", "sequence", F.col("place").cast("long").alias("place"), F.lit(None).cast("long").alias("_proposed"))
    met = prefix_by_key(proposed.unionByName(chosen), ["run_id", "id"], ["sequence", "place"], maxima={"_latest": F.col("_proposed")}, max_rows=max_rows)
    charged = met.filter(F.col("_proposed").isNull() & F.col("_latest").isNotNull()).select("run_id", "sequence", F.col("_latest").alias("_at"))
    estimates = read.filter(kind == "EXPERIMENT_PROPOSED").select("run_id", F.col("sequence").alias("_at"), *USAGE)
    selections = join_null_safe(charged, estimates, ["run_id", "_at"], "inner").select("run_id", "sequence", *USAGE)
    summed = plain.unionByName(selections).groupBy("run_id", "sequence").agg(*[F.sum(f).alias(f) for f in USAGE])
    begun = read.filter(kind == "RUN_CREATED").groupBy("run_id").agg(F.max("sequence").alias("_from"))
    return cut_lineage(join_null_safe(summed, begun, ["run_id"], "inner").filter(F.col("sequence") >= F.col("_from")).drop("_from"))


def run_state(events: DataFrame, *, max_rows: int | None = None) -> DataFrame:
    """The whole state of every run from raw events (STR3): run_id, entity, id, field, place, text, number.

    Single values have place 0; `selection_order` and `evidence` have one row per place. Usage fields stand under the run.
    A run without a creation event has one row, the field `error`.
    """
    log = parsed(events)
    # Three folds read the patches; the payloads are parsed once for all of them.
    patches = cut_lineage(state_patches(log))
    created = cut_lineage(events.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.max(F.col("event_type") == "RUN_CREATED").alias("_created")))
    totals = budget_running_totals(usage_deltas(log, max_rows=max_rows), "run_id", "sequence", USAGE, max_rows=max_rows)
    final = totals.groupBy("run_id").agg(F.max_by(F.struct(*USAGE), "sequence").alias("u"))
    none, run = F.lit(None).cast("string"), F.col("run_id")
    usage = final.select("run_id", F.explode(F.array(*[F.struct(F.lit(f"usage.{f}").alias("field"), F.col("u")[f].alias("number")) for f in USAGE])).alias("x"))
    names = ["run_id", "entity", "id", "field", "place", "text", "number"]
    zero = F.lit(0).cast("long")
    values = fold_patches(patches.filter(F.col("op") != "append")).filter(F.col("field") != "evidence").withColumn("place", zero).select(*names)
    lists = fold_lists(patches, max_rows=max_rows).withColumn("number", F.lit(None).cast("double")).select(*names)
    spent = usage.select("run_id", F.lit("run").alias("entity"), run.alias("id"), F.col("x.field").alias("field"), zero.alias("place"), none.alias("text"), F.col("x.number").alias("number"))
    whole = join_null_safe(values.unionByName(lists).unionByName(spent), created, ["run_id"]).filter("_created").select(*names)
    lost = created.filter(~F.col("_created")).select(
        "run_id", F.lit("run").alias("entity"), run.alias("id"), F.lit("error").alias("field"), zero.alias("place"), F.lit(NO_RUN).alias("text"), F.lit(None).cast("double").alias("number")
    )
    return whole.unionByName(lost)


#: Event types that put a whole row into an entity table, and which payload fields its label and number come from.
_KINDS = {
    "HYPOTHESIS_PROPOSED": ("hypotheses", "type", "current_confidence"), "HYPOTHESIS_REVISED": ("hypotheses", "type", "current_confidence"),
    "EXPERIMENT_PROPOSED": ("experiments", "experiment_type", None), "OBSERVATION_RECORDED": ("observations", "experiment_id", None),
    "VALIDATION_WORLD_REGISTERED": ("validation_worlds", "split_type", "posterior_probability"), "QD_CANDIDATE_EVALUATED": ("qd_candidates", "experiment_id", None),
    "OOF_ARTIFACT_RECORDED": ("oof_artifacts", "candidate_id", None), "OOF_ENSEMBLE_CREATED": ("oof_ensembles", None, None),
    "FORECAST_CALIBRATION_RECORDED": ("forecast_calibrations", "proposer_agent", None), "AGENT_RESOURCE_RECORDED": ("agent_resource_records", "agent", None),
    "EXPERIMENT_RETRY_SCHEDULED": ("experiment_retries", "experiment_id", None), "RUN_CREATED": ("runs", "competition_id", None),
}


def entity_patches() -> Column:
    """The patches of a parsed event for the twelve entity tables and the violations (STR2)."""
    p, run = F.col("p"), F.col("run_id")

    def row(entity: str, id: Column, label: Column, number: Column) -> Column:
        return F.array(
            _patch(entity, id, "label", "set", label), _patch(entity, id, "status", "set", p["status"]),
            _patch(entity, id, "phase", "set", p["phase"]), _patch(entity, id, "number", "set", number=number),
            _patch(entity, id, "version", "set", number=F.coalesce(p["version"], F.lit(1.0))),
            _patch(entity, id, "evidence", "set", number=F.coalesce(F.size(p["evidence_ids"]), F.lit(0))),
        )

    def change(entity: str, ids: Column, field: str, value: str) -> Column:
        return _of_each(ids, lambda i: _patch(entity, i, field, "change", F.lit(value)))

    none = F.lit(None).cast("string")
    rules = {
        (kind,): [row(entity, p["id"], none if label is None else p[label], F.lit(None).cast("double") if number is None else p[number])]
        for kind, (entity, label, number) in _KINDS.items()
    }
    one = F.array(p["experiment_id"])
    rules |= {
        ("BELIEF_UPDATED",): [F.array(_patch("hypotheses", p["hypothesis_id"], "number", "change", number=p["posterior_confidence"]))],
        ("EXPERIMENT_SELECTED",): [change("experiments", F.coalesce(p["selected_experiment_ids"], one), "status", "selected")],
        ("EXPERIMENT_STARTED",): [change("experiments", F.coalesce(p["selected_experiment_ids"], one), "status", "running")],
        ("EXPERIMENT_COMPLETED",): [change("experiments", one, "status", "completed")],
        ("EXPERIMENT_FAILED",): [change("experiments", one, "status", "failed")],
        ("VALIDATION_POSTERIOR_UPDATED",): [
            _of_each(F.map_entries(p["posterior"]), lambda e: _patch("validation_worlds", e["key"], "number", "change", number=e["value"])),
            _of_each(F.map_keys(p["posterior"]), lambda i: _patch("validation_worlds", i, "version", "bump", number=F.lit(1))),
            _of_each(F.map_keys(p["posterior"]), lambda i: _patch("validation_worlds", i, "evidence", "bump", number=F.lit(1))),
        ],
        ("PHASE_CHANGED",): [F.array(_patch("runs", run, "phase", "change", p["phase"]))],
        ("STATE_CHANGED",): [_of_each(F.when(F.length(p["run_status"]) > 0, F.array(run)), lambda i: _patch("runs", i, "status", "change", p["run_status"]))],
        ("RUN_FINALIZED",): [F.array(_patch("runs", run, "phase", "change", F.lit("finalized")), _patch("runs", run, "status", "change", F.lit("completed")))],
        ("VIOLATION_DETECTED",): [row("violations", F.col("event_id"), none, F.lit(None).cast("double")), change("runs", F.array(run), "status", "blocked")],
    }
    return _patches_of(rules)


def entity_tables(events: DataFrame) -> DataFrame:
    """The entity tables after all raw events (STR2): entity, id, run_id, label, status, phase, number, version, evidence.

    Later rows of one id replace earlier ones; changes reach only rows that exist; the first event of an id counts.
    """
    # Repeats are settled by what an event does, which is far less than its payload.
    done = parsed(events).select("event_id", F.struct("run_id", "sequence", entity_patches().alias("patches")).alias("e"))
    first = done.groupBy("event_id").agg(F.min_by("e", F.struct("e.run_id", "e.sequence")).alias("e"))
    patches = cut_lineage(first.select("e.run_id", "e.sequence", F.explode("e.patches").alias("x")).select("run_id", "sequence", "x.*"))
    folded = fold_patches(patches, ["run_id", "entity", "id", "field"])
    texts, numbers = ("label", "status", "phase"), ("number", "version", "evidence")
    pick = lambda c, f: F.max(F.when(F.col("field") == f, F.col(c))).alias(f)
    return folded.groupBy("entity", "id", "run_id").agg(*[pick("text", f) for f in texts], *[pick("number", f) for f in numbers])
