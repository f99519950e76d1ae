"""Tabular files: pruned scans, fingerprints, row-set hashes (SRC6, SRC10, SRC11)."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.functions.draws import hash_key
from foldwright.operators.audit import ContractError
from foldwright.operators.ordering import with_row_number
from foldwright.session import cut_lineage, scratch_path

# Bytes of a file that one task hashes, and of the blocks they are kept in.
RANGE_BYTES = 128 << 20
_BLOCK_BYTES, _LINES_AT_ONCE = 1 << 18, 1000
_BLOCK_NAMES = ["path", "start", "number", "bytes", "content"]
_BLOCK_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
# Bytes of a SHA-256 state: eight words, two of length, a block, two counts.
_STATE_BYTES = 112
_MARK = b"\xef\xbb\xbf"
_PACKED = re.compile(r"\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd|passthrough)$")


def scan_tabular_pruned(
    spark: SparkSession, path: str, schema: str, columns: Sequence[str], row_id: str, time: str | None = None,
    seed: int | str = 0, form: str = "csv",
) -> DataFrame:
    """Only the wanted columns, numbered from 0 in time order or in a seeded shuffle (SRC6).

    The schema is declared: inferring it would cost a pass. The reader parses only the selected columns.
    """
    reader = spark.read.schema(schema).format(form)
    if form == "csv":
        reader = reader.option("header", "true").option("enforceSchema", "false")
    wanted = list(dict.fromkeys([row_id, *columns, *([time] if time else [])]))
    rows = reader.load(path).select(*wanted)
    order = [time, row_id] if time else [hash_key(seed, row_id), row_id]
    return with_row_number(rows, order, "_no").withColumn("position", F.col("_no") - 1).drop("_no")


def dataset_fingerprint(spark: SparkSession, folder: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Name, size and SHA-256 of every file, and one digest over them (SRC10).

    A file of at most `range_bytes` is hashed where it is read. A longer one is read in ranges and hashed range after
    range, so no task holds it whole. The digest of digests covers the sorted file list, which is small; it is not the
    digest of the concatenated bytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    row = lambda rows: rows.select(name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))
    # One row per file above a range. A reader of lines unpacks what its name calls packed: such a file stays whole.
    listed = files.filter(F.col("length") > range_bytes).select(F.col("_metadata.file_path").alias("path"), name.alias("name"), "length")
    longer = {r.path: (r.name, r.length) for r in listed.collect()}
    cut = {p: n for p, (_, n) in longer.items() if not _PACKED.search(p)} if sha256_steps() else {}
    hashed = row(files.filter(F.col("length") <= range_bytes))
    if len(cut) < len(longer):
        whole_files = files.filter((F.col("length") > range_bytes) & ~F.col("_metadata.file_path").isin(list(cut)))
        hashed = hashed.unionByName(row(whole_files))
    if cut:
        digests = _digests_by_range(spark, folder, pattern, cut, range_bytes)
        made = [(*longer[p], d) for p, d in sorted(digests.items())]
        hashed = hashed.unionByName(spark.createDataFrame(made, "name string, size long, digest string"))
    hashed = cut_lineage(hashed)
    line = F.concat_ws(":", "name", F.col("size").cast("string"), "digest")
    whole = hashed.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"))
    return hashed.withColumn("_k", F.lit(1)).join(F.broadcast(whole.withColumn("_k", F.lit(1))), "_k").drop("_k")


def sha256_steps():
    """SHA-256 of the crypto library that hashlib is built on, whose state can be kept between calls; None without one."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        library.SHA256_Init.argtypes = [ctypes.c_char_p]
        library.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
        library.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_char_p]
        return library
    except (ImportError, OSError, AttributeError):
        return None


def _blocks_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive lines of a split as blocks of bytes, numbered within the split, each line with its end."""
    place, number, held = None, 0, bytearray()

    def block():
        made = [[place[0]], [place[1]], [number], [len(held)], [bytes(held)]]
        return pa.record_batch([pa.array(v, t) for v, t in zip(made, _BLOCK_TYPES)], names=_BLOCK_NAMES)

    for batch in batches:
        paths, starts = batch["path"].dictionary_encode(), batch["start"].to_numpy()
        changes = np.flatnonzero((np.diff(paths.indices.to_numpy()) != 0) | (np.diff(starts) != 0)) + 1
        edges = [0, *changes.tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            if low == high:
                continue
            here = (batch["path"][low].as_py(), int(starts[low]))
            if here != place:
                if held:
                    yield block()
                place, number, held = here, 0, bytearray()
            for at in range(low, high, _LINES_AT_ONCE):
                lines = batch["line"].slice(at, min(_LINES_AT_ONCE, high - at))
                held += b"\n".join([*lines.to_pylist(), b""])
                if len(held) >= _BLOCK_BYTES:
                    yield block()
                    number, held = number + 1, bytearray()
    if held:
        yield block()


def _hash_on(states: dict[str, tuple[bytes, int, int]]):
    """Blocks in order to the state of their file's hash: `states` holds (state, bytes hashed, length) per path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, open_files = sha256_steps(), {}
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                path = path.as_py()
                if path not in open_files:
                    state, done, length = states[path]
                    open_files[path] = [ctypes.create_string_buffer(state, _STATE_BYTES), done, length]
                entry = open_files[path]
                # The last line's end is cut off where the file has none.
                part = content.as_py()[: entry[2] - entry[1]]
                steps.SHA256_Update(entry[0], part, len(part))
                entry[1] += len(part)
        made = [(p, s.raw, n) for p, (s, n, _) in open_files.items()]
        yield pa.record_batch(
            [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["path", "state", "done"]
        )

    return run


def _digests_by_range(spark: SparkSession, folder: str, pattern: str, lengths: dict[str, int], range_bytes: int) -> dict[str, str]:
    """SHA-256 of long files, by path. SHA-256 has an order, so ranges follow each other; files go on side by side.

    The reader of lines gives a file's bytes in splits, whatever they are. They are kept once as blocks, by range; each
    round hashes the next range of every file, and only the states (112 bytes a file) pass from round to round.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("lineSep", "\n").text(folder)
    lines = lines.filter(F.col("_metadata.file_path").isin(list(lengths))).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line")
    )
    kept = scratch_path(spark, "file-ranges")
    blocks = lines.mapInArrow(_blocks_of_lines, "path string, start long, number int, bytes int, content binary")
    blocks.withColumn("_range", F.floor(F.col("start") / range_bytes)).write.option("compression", "none").partitionBy("_range").parquet(kept)
    stored = spark.read.schema("path string, start long, number int, bytes int, content binary, _range long").parquet(kept)
    read = {r.path: r.bytes for r in stored.groupBy("path").agg(F.sum("bytes").alias("bytes")).collect()}
    steps, states = sha256_steps(), {}
    for path, length in lengths.items():
        state, done = ctypes.create_string_buffer(_STATE_BYTES), 0
        steps.SHA256_Init(state)
        # Lines end with one byte that the file may lack at its end; the reader leaves out a byte order mark.
        missing = length - read.get(path, 0)
        if missing in (len(_MARK), len(_MARK) - 1):
            steps.SHA256_Update(state, _MARK, len(_MARK))
            done = len(_MARK)
        elif missing not in (0, -1):
            raise ContractError(f"{path}: {read.get(path, 0)} bytes read, {length} listed")
        states[path] = (state.raw, done, length)
    ranges = sorted(r[0] for r in stored.select("_range").distinct().collect())
    for number in ranges:
        part = stored.filter(F.col("_range") == number).repartition(len(lengths), "path").sortWithinPartitions("path", "start", "number")
        for r in part.select("path", "content").mapInArrow(_hash_on(states), "path string, state binary, done long").collect():
            states[r.path] = (bytes(r.state), r.done, lengths[r.path])
    digests, digest = {}, ctypes.create_string_buffer(32)
    for path, (state, done, length) in states.items():
        if done != length:
            raise ContractError(f"{path}: {done} bytes hashed, {length} listed")
        steps.SHA256_Final(digest, ctypes.create_string_buffer(state, _STATE_BYTES))
        digests[path] = digest.raw.hex()
    return digests


def row_set_hash(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free hash of a set of rows per key: count, xor and sum of row draws (SRC11)."""
    draw = hash_key("rows", *columns)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(draw).alias("xor_hash"),
        F.sum(draw.cast("decimal(38,0)")).cast("string").alias("sum_hash"),
    )
