"""Labelled rows for fits: the fold rule, bounded samples by digest order, and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may learn from: crc32 of the id's text is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) outside the held-out fold; an id labelled twice counts with its largest label, null labels do not."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))


def sample(rows: DataFrame, most: int) -> DataFrame:
    """The `most` rows whose ids come first by digest: the same ones in every run, spread evenly."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def with_texts(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """Texts of a bounded sample of ids; the ids are small enough to go to every task."""
    texts = documents.select(F.col("doc_id").alias("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id")
