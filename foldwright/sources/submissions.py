"""Prediction files: re-attach real ids, validate (SRC8, SRC9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.operators.audit import Audited


def submission_with_ids(
    predictions: DataFrame, id_map: DataFrame, sample: DataFrame, row_id: str, real_id: str, position: str
) -> Audited:
    """Predictions keyed by real id in the sample's order (SRC8).

    Violations name predicted rows without a real id, sample ids without a prediction, and predicted
    ids outside the sample.
    """
    mapped = predictions.join(id_map.select(row_id, real_id), row_id, "left")
    unmapped = mapped.filter(F.col(real_id).isNull()).select(
        F.lit("unmapped").alias("problem"), F.col(row_id).cast("string").alias("id")
    )
    known = mapped.filter(F.col(real_id).isNotNull())
    merged = sample.select(real_id, position).join(known.select(real_id, "prediction"), real_id, "full_outer")
    problem = F.when(F.col(position).isNull(), "extra").when(F.col("prediction").isNull(), "missing")
    marked = merged.withColumn("problem", problem)
    wrong = marked.filter(F.col("problem").isNotNull()).select("problem", F.col(real_id).cast("string").alias("id"))
    result = marked.filter(F.col("problem").isNull()).select(position, real_id, "prediction")
    return Audited(result, unmapped.unionByName(wrong))


def write_submission(ordered: DataFrame, path: str, real_id: str, position: str, header: tuple[str, str]) -> None:
    """CSV with a header, rows in sample order across the part files."""
    ordered.orderBy(position).select(
        F.col(real_id).alias(header[0]), F.col("prediction").alias(header[1])
    ).write.mode("errorifexists").csv(path, header=True)


def submission_validate(rows: DataFrame, id_column: str, prediction: str, expected_rows: int) -> DataFrame:
    """Counts per rule over text columns, one row (SRC9)."""
    trimmed = F.trim(F.coalesce(F.col(id_column), F.lit("")))
    number = F.trim(F.coalesce(F.col(prediction), F.lit(""))).try_cast("double")
    outside = F.isnan(number) | (number < 0) | (number > 1)
    per_id = rows.select(trimmed.alias("_id"), number.alias("_p"), outside.alias("_o")).groupBy("_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("_p").isNull()).alias("_text"),
        F.count_if(F.col("_o")).alias("_out"),
        F.min(F.when(~F.col("_o"), F.col("_p"))).alias("_min"),
        F.max(F.when(~F.col("_o"), F.col("_p"))).alias("_max"),
    )
    filled = F.col("_id") != ""
    counted = per_id.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(~filled, F.col("_n"))), F.lit(0)).alias("empty_ids"),
        F.coalesce(F.sum(F.when(filled, F.col("_n") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(filled, F.col("_text"))), F.lit(0)).alias("non_numeric"),
        F.coalesce(F.sum(F.when(filled, F.col("_out"))), F.lit(0)).alias("outside_range"),
        F.min(F.when(filled, F.col("_min"))).alias("minimum"),
        F.max(F.when(filled, F.col("_max"))).alias("maximum"),
    )
    problems = F.col("empty_ids") + F.col("duplicate_rows") + F.col("non_numeric") + F.col("outside_range")
    return counted.withColumn("valid", (problems == 0) & (F.col("row_count") == expected_rows))


def header_is_exact(columns: list[str], expected: tuple[str, ...]) -> bool:
    return tuple(columns) == tuple(expected)
