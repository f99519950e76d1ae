"""The cleaning pipeline over `documents`: each stage reads what the one before it wrote.

`run` writes every stage's result to the shared scratch folder and reads it again, so a lost executor repeats a part of
one stage only. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.base import read_table, stored
from foldwright.llm.decontaminate import decontaminated
from foldwright.llm.line_spread import remove_spread_lines
from foldwright.llm.near_copies import first_of_near_copies
from foldwright.llm.packing import pack
from foldwright.llm.queries import END_ID, TOKENIZER
from foldwright.llm.simhash import first_of_groups
from foldwright.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; `n_chars` counts what is left."""
    cleaned = remove_spread_lines(docs)
    count = F.when(F.col("n_removed_lines") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", count).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: by SimHash, at 3 differing bits or fewer, then, of what is left, by
    five-word shingles at a similarity of 0.8 or more, which finds copies whose fingerprints lie further apart."""
    return first_of_near_copies(stored(first_of_groups(docs), "simhash-kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of packed sequences."""
    return pack(docs, TOKENIZER, END_ID)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: A trained classifier, 64-bit fingerprints of shingles and a linear program have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
