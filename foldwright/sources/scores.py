"""Append-only per-task metric vectors (SRC4, SRC5)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.operators.audit import Audited
from foldwright.operators.rates import score_violations

SCHEMA = "candidate_id string, task_id string, kind string, metrics map<string,double>, append_seq long, batch_order long"


def append_task_scores(scores: DataFrame, path: str) -> None:
    """Append checked scores; composites, empty vectors and non-finite values are refused.

    `append_seq` orders batches: it continues after the largest sequence already stored. `batch_order` keeps the order
    of the rows inside a batch. One writer appends at a time.
    """
    checked = Audited(scores, score_violations(scores)).checked("task scores refused")
    spark = scores.sparkSession
    stored = load_task_scores(spark, path)
    last = stored.agg(F.max("append_seq")).first()[0] if stored is not None else None
    following = 0 if last is None else last + 1
    checked.select(
        "candidate_id", "task_id", "kind", "metrics", F.lit(following).cast("long").alias("append_seq"), F.monotonically_increasing_id().alias("batch_order")
    ).write.mode("append").parquet(path)


def load_task_scores(spark: SparkSession, path: str) -> DataFrame | None:
    """All stored rows, or None when nothing was appended yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def latest_task_scores(scores: DataFrame, kind: str | None = "candidate") -> DataFrame:
    """The last row per (candidate, task), optionally of one kind (SRC5)."""
    rows = scores if kind is None else scores.filter(F.col("kind") == kind)
    order = F.struct("append_seq", "batch_order") if "batch_order" in scores.columns else F.col("append_seq")
    last = F.max_by(F.struct("kind", "metrics"), order).alias("_last")
    return rows.groupBy("candidate_id", "task_id").agg(last).select("candidate_id", "task_id", "_last.*")
