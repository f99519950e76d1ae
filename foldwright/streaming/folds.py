"""Structured Streaming forms of the log folds; each has a batch twin in `operators.runlog`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from foldwright.operators.runlog import run_state_fold
from foldwright.session import scratch_path


def run_to_completion(stream: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Drain the available input into a table in the shared folder and return it.

    With `keys` the stream is an aggregation: each micro-batch appends the keys it changed under its own
    number, a repeated batch replaces itself, and the latest row of each key is read.
    """
    spark = stream.sparkSession
    target, progress = scratch_path(spark, name), scratch_path(spark, f"{name}-progress")
    writer = stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True)
    if keys is None:
        writer.format("parquet").outputMode("append").start(target).awaitTermination()
        return spark.read.schema(stream.schema).parquet(target)
    writer.outputMode("update").foreachBatch(
        lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
    ).start().awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    changes = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(target)
    latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_latest"))
    return latest.select(*keys, "_latest.*").select(*stream.columns)


def stream_event_dedup(events: DataFrame, event_id: str, event_time: str, delay: str) -> DataFrame:
    """Drop repeated event ids (STR1); `delay` bounds how long an id is remembered and how late an event may come."""
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([event_id])


def stream_run_state(events: DataFrame, run: str, sequence: str) -> DataFrame:
    """Run states as a streaming aggregation (STR3): state holds one row per run."""
    return run_state_fold(events, run, sequence)


def stream_latest(events: DataFrame, entity: list[str], sequence: str, value: str) -> DataFrame:
    """Latest value per entity as a streaming aggregation (STR2)."""
    return events.groupBy(*entity).agg(F.max_by(value, sequence).alias(value), F.max(sequence).alias(sequence))


def stream_query_budget(queries: DataFrame, run: str, max_queries: int) -> DataFrame:
    """Accept at most `max_queries` per run across batches (STR6), counting in keyed state.

    Within a batch the order is by sequence; across batches it is arrival order.
    """
    kind = queries.schema[run].dataType.simpleString()

    def gate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("sequence")
        rank = used + rows["valid"].cumsum()
        accepted = rows["valid"] & (rank <= max_queries)
        state.update((used + int(accepted.sum()),))
        yield pd.DataFrame({run: key[0], "sequence": rows["sequence"], "accepted": accepted})

    return queries.groupBy(run).applyInPandasWithState(
        gate, f"{run} {kind}, sequence long, accepted boolean", "used long", "append", GroupStateTimeout.NoTimeout
    )


def stream_budget_totals(deltas: DataFrame, run: str, field: str) -> DataFrame:
    """Running usage held at zero (STR4); state is one number per run."""
    kind = deltas.schema[run].dataType.simpleString()

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values("sequence")
        summed = start + rows[field].cumsum()
        shortfall = (-summed).cummax().clip(lower=0.0)
        usage = summed + shortfall
        state.update((float(usage.iloc[-1]),))
        yield pd.DataFrame({run: key[0], "sequence": rows["sequence"], field: usage})

    return deltas.groupBy(run).applyInPandasWithState(
        fold, f"{run} {kind}, sequence long, {field} double", f"{field} double", "append", GroupStateTimeout.NoTimeout
    )


def stream_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A Parquet table of a folder as a file stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)
