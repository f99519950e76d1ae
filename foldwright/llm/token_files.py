"""Token-id output: Arrow stream files of fixed-size-list batches.

Documents are range-partitioned by id and encoded in order; every task's ids form one stream file of equal-length
sequences. A record batch holds `ids` (fixed-size list of unsigned integers, two bytes when the vocabulary allows),
`mask` (fixed-size list of bytes, one bit per position, 1 where an id stands), `docs` (the documents that end in the
sequence and where) and `n_ids`. Reading maps a file and slices it; nothing is decoded or copied.

The files are written by Spark's own committed writer: a task emits one row per batch message and the writer's record
separator, a zero byte, restores the last byte of every message, which is always zero (the padded high end of `n_ids`).
A lost executor repeats its task and the commit keeps one copy.

Defined results: null text is empty; each document, empty ones too, ends with `end_id`; rows with equal ids stand in
order of their text's hash; a null id sorts first; other columns are ignored; an empty table gives no files.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.llm.base import input_partitions, stored, text_bytes, text_slices
from foldwright.llm.word_tokens import TextEncoder
from foldwright.session import scratch_path

SEQUENCE = 2048
BATCH = 256
#: One encoder per worker process and tokenizer file, so that known words stay known from task to task.
_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids of all their texts with the end ids, end offset of each text in these) for slices of rows."""
    for rows in text_slices(batches):
        ids, counts = encoder(path).encode(*text_bytes(rows.column(rows.schema.get_field_index("text"))))
        ends = np.cumsum(counts + 1)
        out = np.full(int(ends[-1]), end_id, dtype=np.uint32)
        inner = np.ones(len(out), dtype=bool)
        inner[ends - 1] = False
        out[inner] = ids
        yield rows, out, ends


def sequence_schema(length: int, vocabulary: int, stream: int = 0) -> pa.Schema:
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    docs = pa.list_(pa.struct([("doc_id", pa.int64()), ("end", pa.int32())]))
    return pa.schema(
        [("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length // 8)), ("docs", docs), ("n_ids", pa.uint32())],
        metadata={"stream": str(stream), "sequence": str(length)},
    )


class _Messages:
    """Arrow stream writer that hands out the bytes written since the last call."""

    def __init__(self, schema: pa.Schema):
        self.sink = io.BytesIO()
        self.writer = pa.ipc.new_stream(self.sink, schema)
        self.schema = schema

    def taken(self) -> bytes:
        out = self.sink.getvalue()
        self.sink.seek(0)
        self.sink.truncate()
        return out

    def add(self, ids: np.ndarray, ends: list[tuple[int | None, int]], length: int) -> None:
        """Write `ids` as sequences; `ends` are (document, position of its last id) with positions from the first id."""
        rows = -(-len(ids) // length)
        padded = np.zeros(rows * length, dtype=self.schema.field("ids").type.value_type.to_pandas_dtype())
        padded[: len(ids)] = ids
        mask = np.packbits(np.arange(rows * length) < len(ids), bitorder="little")
        docs: list[list[dict]] = [[] for _ in range(rows)]
        for doc, at in ends:
            docs[at // length].append({"doc_id": doc, "end": at % length})
        self.writer.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(padded), length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), length // 8),
            pa.array(docs, self.schema.field("docs").type),
            pa.array(np.minimum(length, len(ids) - length * np.arange(rows)), pa.uint32()),
        ], schema=self.schema))


def _stream_messages(path: str, end_id: int, length: int, batch: int, vocabulary: int):
    full = length * batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        held: list[np.ndarray] = []
        ends: list[tuple[int | None, int]] = []
        size = 0

        def message(data: bytes) -> pa.RecordBatch:
            assert data[-1] == 0
            return pa.record_batch([pa.array([data[:-1]], pa.binary())], names=["message"])

        for rows, ids, stops in encoded(batches, path, end_id):
            out = out or _Messages(sequence_schema(length, vocabulary, TaskContext.get().partitionId()))
            ends += zip(rows.column("doc_id").to_pylist(), (stops - 1 + size).tolist(), strict=True)
            held.append(ids)
            size += len(ids)
            while size > full:
                joined = np.concatenate(held)
                out.add(joined[:full], [e for e in ends if e[1] < full], length)
                yield message(out.taken())
                held, size = [joined[full:]], size - full
                ends = [(doc, at - full) for doc, at in ends if at >= full]
        if out:
            out.add(np.concatenate(held), ends, length)
            out.writer.close()
            yield message(out.taken())

    return run


def write_token_files(
    documents: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = SEQUENCE, batch: int = BATCH, vocabulary: int = 1 << 16
) -> None:
    """Write `documents` (doc_id, text) to `folder` in ascending doc_id order, one stream file per task."""
    if length % 8:
        raise ValueError("the sequence length must be a multiple of 8")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = (F.col("doc_id"), F.xxhash64("text"))
    rows = rows.repartitionByRange(input_partitions(rows), *order).sortWithinPartitions(*order)
    messages = rows.mapInArrow(_stream_messages(tokenizer, end_id, length, batch, vocabulary), "message binary")
    messages.select(F.col("message").cast("string")).write.option("lineSep", "\x00").option("compression", "none").text(folder)


class SequenceFile:
    """Random access to one stream file without copies: `SequenceFile(pa.memory_map(path))` or over a buffer."""

    def __init__(self, source):
        reader = pa.ipc.open_stream(source)
        self.batches = list(reader)
        self.stream = int(reader.schema.metadata[b"stream"])
        self.length = int(reader.schema.metadata[b"sequence"])
        self.firsts = np.cumsum([0] + [b.num_rows for b in self.batches])

    def __len__(self) -> int:
        return int(self.firsts[-1])

    def _of(self, column: str, batch: int) -> np.ndarray:
        return self.batches[batch].column(column).flatten().to_numpy(zero_copy_only=True).reshape(self.batches[batch].num_rows, -1)

    def sequence(self, k: int) -> np.ndarray:
        batch = int(np.searchsorted(self.firsts, k, "right")) - 1
        return self._of("ids", batch)[k - self.firsts[batch]]

    def mask(self, k: int) -> np.ndarray:
        """The packed bits; `np.unpackbits(..., bitorder="little")` spreads them."""
        batch = int(np.searchsorted(self.firsts, k, "right")) - 1
        return self._of("mask", batch)[k - self.firsts[batch]]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document, position of its first id in the file, its ids) in file order."""
        start, parts = 0, []
        for k, batch in enumerate(self.batches):
            ids = self._of("ids", k).reshape(-1)[: int(np.sum(batch.column("n_ids").to_numpy()))]
            at = 0
            for row, docs in enumerate(batch.column("docs").to_pylist()):
                for doc in docs:
                    stop = row * self.length + doc["end"] + 1
                    whole = np.concatenate([*parts, ids[at:stop]]) if parts else ids[at:stop]
                    yield doc["doc_id"], start, whole
                    start, at, parts = start + len(whole), stop, []
            if at < len(ids):
                parts.append(ids[at:])


_DOCUMENTS = "doc_id long, stream long, first long, n_tokens long, ids_crc32 long"


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            if content.as_buffer().size == 0:
                continue
            file = SequenceFile(content.as_buffer())
            rows = [(doc, file.stream, first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, first, ids in file.documents()]
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "stream", "first", "n_tokens", "ids_crc32"])


def read_token_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document as the files hold it: where it starts among all ids, its number of ids, their checksum."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    docs = stored(files.mapInArrow(_read_documents, _DOCUMENTS), "token-documents")
    # One row per file, so one task orders them.
    totals = docs.groupBy("stream").agg(F.sum("n_tokens").alias("ids"))
    order = Window.orderBy("stream").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("stream", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before"))
    return docs.join(before, "stream").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", F.col("stream").alias("file_number")
    )


def token_round_trip(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files to the shared scratch folder and read them back."""
    spark = documents.sparkSession
    folder = scratch_path(spark, "token-files")
    write_token_files(documents, folder, tokenizer, end_id, vocabulary=_vocabulary(tokenizer))
    return read_token_documents(spark, folder)


def _vocabulary(tokenizer: str) -> int:
    with open(tokenizer, encoding="utf-8") as file:
        spec = json.load(file)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
