"""Out-of-fold prediction tables: scan with checks, atomic write (SRC1, SRC2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.operators.audit import Audited, ContractError
from foldwright.operators.folds import duplicate_keys
from foldwright.operators.oof import fill_residual

SCHEMA = (
    "row_id string, fold_id string, target double, oof_prediction double, residual double, timestamp string,"
    " entity_id string, subgroup_id string, validation_world string, candidate_id string"
)
KEY = ("candidate_id", "validation_world", "row_id")


def scan_oof(spark: SparkSession, path: str, form: str | None = None) -> Audited:
    """Read Parquet or JSON lines; the suffix decides unless `form` does.

    Violations hold duplicate keys and residuals that contradict target minus prediction.
    """
    form = form or ("parquet" if path.rstrip("/").endswith(".parquet") else "json")
    rows = spark.read.schema(SCHEMA).format(form).load(path)
    if rows.isEmpty():
        raise ContractError("an out-of-fold table must hold at least one row")
    filled = fill_residual(rows)
    duplicates = duplicate_keys(rows, KEY).select(*KEY, F.lit("duplicate").alias("problem"))
    residuals = filled.violations.select(*KEY, F.lit("residual").alias("problem"))
    return Audited(filled.result, duplicates.unionByName(residuals))


def sink_oof(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Write once; the commit protocol publishes all files or none."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    shaped = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])
    shaped.write.mode("errorifexists").format(form).save(path)
