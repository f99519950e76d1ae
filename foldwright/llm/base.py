"""Small helpers shared by the operators: table access, shared scratch tables, raw text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared scratch folder and read again: a lost executor never makes it differ or run again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores after it where `df` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key() -> Column:
    """Digest of a document's id and text, whatever type the id has."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def rows_of_keys(documents: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of `documents` whose key is in `kept` (kept_row_key). Rows equal in id and text share a key, and one of them stays."""
    key = free_name(documents, "kept_row_key")
    keyed = documents.withColumn(key, row_key())
    return keyed.join(kept.withColumnRenamed("kept_row_key", key), key).dropDuplicates([key]).select(*documents.columns)


def input_partitions(df: DataFrame, bytes_per_task: int = 128 << 20) -> int:
    """Shuffle partitions for `df`: the session's number, or more when the planner's size estimate asks for it."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A plan without statistics reports an absurd size; then the session's number stands.
    return session if estimate > 1 << 60 else max(session, -(-estimate // bytes_per_task))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `most_bytes` of text, one row at least; null text becomes empty."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        batch = batch.set_column(at, column, pc.fill_null(batch.column(at).cast(pa.large_string()), ""))
        ends = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(first, last - first)
            first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a `large_string` column without nulls, and the offsets of its rows in them."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
