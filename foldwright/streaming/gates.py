"""Stateful streams that need more than a counter: events admitted once per place, and queries judged in log order.

State is keyed and lives in Spark's RocksDB state store, so its size is bounded by disk and not by a task's memory. A
micro-batch's rows of a run are taken batch by batch and never gathered in one frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foldwright.streaming.folds import run_to_completion

# Places of a run that one entry of the state holds: a call to the state store costs more than the rows of an entry.
PLACES = 256
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_with_keyed_state(stream: DataFrame, name: str) -> DataFrame:
    """`run_to_completion` with the state store that keyed maps need."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKSDB)
    try:
        return run_to_completion(stream, name)
    finally:
        conf.set(_PROVIDER, before)


class _Admission(StatefulProcessor):
    """Which id holds each place of a run, by blocks of places, and which other ids have claimed one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.holders = handle.getMapState("holders", "block long", "places array<long>, ids array<string>")
        self.rivals = handle.getMapState("rivals", "claim string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        for frame in rows:
            out, blocks, changed = [], {}, set()
            for place, name in zip(frame["sequence"].tolist(), frame["event_id"].tolist(), strict=True):
                block = place // PLACES
                if block not in blocks:
                    found = self.holders.getValue((block,))
                    blocks[block] = dict(zip(*found, strict=True)) if found else {}
                if place not in blocks[block]:
                    blocks[block][place] = name
                    changed.add(block)
                    out.append((place, name, None))
                elif blocks[block][place] != name and not self.rivals.containsKey((f"{place}:{name}",)):
                    self.rivals.updateValue((f"{place}:{name}",), (True,))
                    out.append((place, name, "sequence_taken"))
            for block in changed:
                self.holders.updateValue((block,), (list(blocks[block]), list(blocks[block].values())))
            yield pd.DataFrame({"run_id": [key[0]] * len(out), **{c: [r[k] for r in out] for k, c in enumerate(("sequence", "event_id", "violation"))}}, dtype=object)

    def close(self) -> None:
        pass


def stream_admission(events: DataFrame, run: str, sequence: str, event_id: str) -> DataFrame:
    """Every event of a run once, however late it comes (STR1): run_id, sequence, event_id, violation.

    The first id to arrive at a place of a run holds it. A repeat of it gives no row, another id is a violation, stated
    once. Null ids count as the text `null`. There is no time bound; the state holds one entry per place.
    """
    rows = events.select(F.col(run).alias("run_id"), F.col(sequence).cast("long").alias("sequence"), F.coalesce(F.col(event_id).cast("string"), F.lit("null")).alias("event_id"))
    kind = rows.schema["run_id"].dataType.simpleString()
    return rows.groupBy("run_id").transformWithStateInPandas(
        _Admission(), f"run_id {kind}, sequence long, event_id string, violation string", "Append", "None"
    )


class _Gate(StatefulProcessor):
    """Judges queries in log order; those that come before their turn wait in a map by the block of their place."""

    def __init__(self, policy: str, max_queries: int):
        self.strict, self.gated, self.most = policy == "strict_blind", policy == "gated_binary", max_queries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turn = handle.getValueState("turn", "next long, used long")
        self.waiting = handle.getMapState("waiting", "block long", "places array<long>, scores array<double>, thresholds array<double>, reveals array<boolean>")

    def judge(self, used: int, score: float | None, threshold: float | None, reveal: bool | None) -> tuple[str | None, bool | None, float | None, int]:
        if self.strict:
            return "STRICT_BLIND_QUERY", None, None, used
        bad = None
        if self.gated:
            bad = "THRESHOLD_REQUIRED" if threshold is None else "NUMERIC_SCORE_REQUEST" if reveal else None
        if self.most and used >= self.most:
            return "QUERY_BUDGET_EXCEEDED", None, None, used + (bad is None)
        if bad:
            return bad, None, None, used
        passed = None if score is None or threshold is None else score >= threshold
        return None, passed, None if self.gated else score, used + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        place, used = self.turn.get() if self.turn.exists() else (1, 0)
        for frame in rows:
            out, blocks, stored, changed = [], {}, set(), set()

            def held(block: int, blocks=blocks, stored=stored) -> dict:
                if block not in blocks:
                    found = self.waiting.getValue((block,))
                    blocks[block] = {at: value for at, *value in zip(*found, strict=True)} if found else {}
                    stored.update([block] if found else [])
                return blocks[block]

            frame = frame.sort_values("sequence", kind="stable").astype(object)
            values = frame[["score", "threshold", "reveal"]].where(frame[["score", "threshold", "reveal"]].notna(), None).itertuples(index=False, name=None)
            for at, value in zip(frame["sequence"].tolist(), values, strict=True):
                if at >= place and at not in held(at // PLACES):
                    held(at // PLACES)[at] = value
                    changed.add(at // PLACES)
            while (value := held(place // PLACES).pop(place, None)) is not None:
                changed.add(place // PLACES)
                refusal, passed, shown, used = self.judge(used, *value)
                out.append((place, refusal, refusal is None, passed, shown))
                place += 1
            for block in changed:
                if blocks[block]:
                    self.waiting.updateValue((block,), (list(blocks[block]), *([v[i] for v in blocks[block].values()] for i in range(3))))
                elif block in stored:
                    self.waiting.removeKey((block,))
            names = ("sequence", "refusal", "accepted", "passed", "revealed_score")
            yield pd.DataFrame({"run_id": [key[0]] * len(out), **{c: [r[k] for r in out] for k, c in enumerate(names)}}, dtype=object)
        self.turn.update((place, used))

    def close(self) -> None:
        pass


def stream_query_gate(queries: DataFrame, run: str, sequence: str, policy: str, max_queries: int) -> DataFrame:
    """The rows of `query_budget_gate` (STR6) from a stream in any order: a query is judged when all before it are there.

    Places of a run begin with 1 and have no gaps in the end; a place that was judged or is held is not taken again. Columns
    read: score, threshold (nullable), reveal_score.
    """
    rows = queries.select(F.col(run).alias("run_id"), F.col(sequence).cast("long").alias("sequence"), "score", "threshold", F.col("reveal_score").alias("reveal"))
    kind = rows.schema["run_id"].dataType.simpleString()
    return rows.groupBy("run_id").transformWithStateInPandas(
        _Gate(policy, max_queries), f"run_id {kind}, sequence long, refusal string, accepted boolean, passed boolean, revealed_score double", "Append", "None"
    )
