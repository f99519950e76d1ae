"""Event logs and query ledgers as JSON lines, batch and streaming (SRC3, SRC7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = (
    "event_id string, sequence long, run_id string, event_type string, occurred_at timestamp, payload string,"
    " schema_version int, previous_hash string, event_hash string"
)
LEDGER = "run_id string, actor string, query_kind string, request string, response_kind string, created_at timestamp"


def scan_event_logs(spark: SparkSession, root: str) -> DataFrame:
    """Every */events.jsonl under a root with its file; the schema is declared, nothing is inferred."""
    rows = spark.read.schema(ENVELOPE).json(f"{root}/*/events.jsonl")
    return rows.select("*", F.col("_metadata.file_path").alias("file_path"))


def stream_event_logs(spark: SparkSession, root: str) -> DataFrame:
    """The same files as an unbounded stream."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", 64).json(f"{root}/*/events.jsonl")


def append_query_ledger(queries: DataFrame, path: str) -> None:
    """Append holdout queries; files are laid out by run so that a listing prunes to one run."""
    columns = [c.split()[0] for c in LEDGER.split(", ")]
    queries.select(*columns).write.mode("append").partitionBy("run_id").parquet(path)


def list_queries(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    rows = spark.read.schema(LEDGER).parquet(path)
    return rows if run_id is None else rows.filter(F.col("run_id") == run_id)
