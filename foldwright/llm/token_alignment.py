"""Alignment of two tokenizers over the same texts: groups of ids that cover equal bytes, and links of overlapping tokens.

Each id list has cumulative byte ends. A dictionary per list leads from an end to its index; the ends that both hold,
sorted, cut both lists into groups, and inside a group every two tokens that share a byte are linked. Neither tokenizer
joins across a blank that follows a non-blank, so texts are cut there, a worker aligns each distinct segment once, and a
document is its segments' results one after the other.

`with_pair_counts` compares each link with the whole corpus. Links are counted per block of documents (a few megabytes of
text) inside the task that aligned them, so that what is shuffled are the distinct pairs of every block; corpus counts go
back to the blocks that asked for them, and a block's answers meet its documents in one task.

Defined results: a text that is null or empty, or whose tokens of either side do not spell a blank and the text, has no
tokens; strings of special tokens are plain text; repeated rows stay repeated; a null doc_id stays; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldwright.llm.base import stored, text_slices
from foldwright.llm.bpe_codec import lists_of, spelling
from foldwright.llm.list_store import Lists, ListStore
from foldwright.llm.runs import spread_index

_SEGMENT = re.compile(r"(?<=\S)(?= )")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_BLANK = "▁"
#: Fixed: text that a normalising piece model would change.
_PROBE = "ﬁ① Å  b　\tＡ"
_BLOCK_BYTES = 2 << 20
#: Segments that a worker keeps.
_SEGMENTS = 3 << 17


def cut_at_common_ends(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """Where the groups end in either list: the number of tokens up to each end that both lists hold."""
    a_index = dict(zip(a_ends, range(1, len(a_ends) + 1), strict=True))
    b_index = dict(zip(b_ends, range(1, len(b_ends) + 1), strict=True))
    common = sorted(a_index.keys() & b_index.keys())
    return [a_index[end] for end in common], [b_index[end] for end in common]


def links_in_groups(a_ends: list[int], b_ends: list[int], a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of every two tokens of a group that share a byte, group by group."""
    a_first, b_first = (np.concatenate([[0], cuts[:-1]])[: len(cuts)] for cuts in (a_cuts, b_cuts))
    a_size, b_size = a_cuts - a_first, b_cuts - b_first
    # A token that is a whole side of its group overlaps all of the other side.
    plain = np.flatnonzero((a_size == 1) | (b_size == 1))
    size = np.maximum(a_size, b_size)[plain]
    step = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
    left = np.repeat(a_first[plain], size) + step * np.repeat(a_size[plain] > 1, size)
    right = np.repeat(b_first[plain], size) + step * np.repeat(b_size[plain] > 1, size)
    group = np.repeat(plain, size)
    more: list[tuple[int, int, int]] = []
    for g in np.flatnonzero((a_size > 1) & (b_size > 1)).tolist():
        i, k, a_stop, b_stop = int(a_first[g]), int(b_first[g]), int(a_cuts[g]), int(b_cuts[g])
        while i < a_stop and k < b_stop:
            more.append((g, i, k))
            a_end, b_end = a_ends[i], b_ends[k]
            i += a_end <= b_end
            k += b_end <= a_end
    if more:
        others = np.array(more, dtype=np.int64).T
        group, left, right = (np.concatenate([x, y]) for x, y in zip((group, left, right), others, strict=True))
        order = np.argsort(group, kind="stable")
        left, right = left[order], right[order]
    return left, right


class PieceModel:
    """A sentencepiece model whose pieces hold blanks only at their beginning, and the bytes of its pieces."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(_BLANK, " ").encode() for p in pieces]
        self.lone_blank = self.model.piece_to_id(_BLANK)
        spelled = b"".join(self.bytes_of[i] for i in self.model.encode(_PROBE))
        if spelled != b" " + _PROBE.encode() or any(_BLANK in p.lstrip(_BLANK) for p in pieces):
            raise ValueError(f"{path} normalises texts or has pieces across blanks")

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many each, of segments that begin with a blank, which the model itself puts in front."""
        got = self.model.encode([s[1:] for s in segments], num_threads=1)
        got = [ids if len(s) > 1 else [self.lone_blank] for s, ids in zip(segments, got, strict=True)]
        counts = np.array([len(x) for x in got], dtype=np.int64)
        return np.fromiter(itertools.chain.from_iterable(got), np.int64, int(counts.sum())), counts


class ByteModel:
    """A byte-level file of the tokenizers library that takes strings of special tokens as plain text, and the bytes of its tokens."""

    def __init__(self, path: str):
        # A task is one of many on its machine and keeps to its own core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.bytes_of = spelling(path).bytes_of

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.model.encode_batch_fast(segments, add_special_tokens=False)]
        counts = np.array([len(x) for x in got], dtype=np.int64)
        return np.fromiter(itertools.chain.from_iterable(got), np.int64, int(counts.sum())), counts


class Spelling:
    """The bytes of token ids as one buffer."""

    def __init__(self, bytes_of: list[bytes]):
        self.lengths = np.array([len(b) for b in bytes_of], dtype=np.int64)
        self.heads = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(bytes_of), dtype=np.uint8)

    def spells(self, ids: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether the tokens of each run, joined, are its bytes."""
        owner = np.repeat(np.arange(len(raw)), counts)
        wanted = np.array([len(r) for r in raw], dtype=np.int64)
        equal = np.bincount(owner, weights=self.lengths[ids], minlength=len(raw)).astype(np.int64) == wanted
        kept = ids[equal[owner]]
        mine = self.pool[spread_index(self.heads[kept], self.lengths[kept])]
        theirs = np.frombuffer(b"".join(itertools.compress(raw, equal.tolist())), dtype=np.uint8)
        equal[np.repeat(np.flatnonzero(equal), wanted[equal])[mine != theirs]] = False
        return equal


class Aligner:
    """Aligns texts; results of distinct segments are kept, up to a bounded number."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteModel(a_path), PieceModel(b_path)
        self.a_spelling, self.b_spelling = Spelling(self.a.bytes_of), Spelling(self.b.bytes_of)
        self.b_size = len(self.b.bytes_of)
        links = np.int32 if len(self.a.bytes_of) * self.b_size < 1 << 31 else np.int64
        kinds = {"a_ids": np.int32, "b_ids": np.int32, "a_cuts": np.int32, "b_cuts": np.int32, "links": links, "unsound": np.int8}
        self.store = ListStore(self._learn, kinds, _SEGMENTS)

    def _learn(self, segments: list[str]) -> Lists:
        raw = [s.encode() for s in segments]
        a_ids, a_counts = self.a.encode(segments)
        b_ids, b_counts = self.b.encode(segments)
        sound = self.a_spelling.spells(a_ids, a_counts, raw) & self.b_spelling.spells(b_ids, b_counts, raw)
        # Segments end in both lists, so all sound ones are aligned as one text.
        a_ids, b_ids = a_ids[np.repeat(sound, a_counts)], b_ids[np.repeat(sound, b_counts)]
        a_counts, b_counts = a_counts * sound, b_counts * sound
        a_ends, b_ends = np.cumsum(self.a_spelling.lengths[a_ids]).tolist(), np.cumsum(self.b_spelling.lengths[b_ids]).tolist()
        a_cuts, b_cuts = (np.array(cuts, dtype=np.int64) for cuts in cut_at_common_ends(a_ends, b_ends))
        left, right = links_in_groups(a_ends, b_ends, a_cuts, b_cuts)
        a_stops, b_stops = np.cumsum(a_counts), np.cumsum(b_counts)
        groups = np.diff(np.searchsorted(a_cuts, a_stops, "right"), prepend=0)
        return {
            "a_ids": (a_ids, a_counts), "b_ids": (b_ids, b_counts),
            "a_cuts": (a_cuts - np.repeat(a_stops - a_counts, groups), groups), "b_cuts": (b_cuts - np.repeat(b_stops - b_counts, groups), groups),
            "links": (a_ids[left] * self.b_size + b_ids[right], np.diff(np.searchsorted(left, a_stops), prepend=0)),
            "unsound": (np.ones(int((~sound).sum())), (~sound).astype(np.int64)),
        }

    def align(self, texts: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """(values, how many per text) of a_ids, b_ids, a_cuts, b_cuts and links for all texts."""
        segments = [_SEGMENT.split(" " + t) if t else [] for t in texts]
        found = self.store.find(list(itertools.chain.from_iterable(segments)))
        text = np.repeat(np.arange(len(texts)), [len(s) for s in segments])
        spelled = np.bincount(text[self.store.sizes["unsound"][found] > 0], minlength=len(texts)) == 0
        found, text = found[spelled[text]], text[spelled[text]]
        begins = np.searchsorted(text, np.arange(len(texts) + 1))
        out = {}
        for name in ("a_ids", "b_ids", "a_cuts", "b_cuts", "links"):
            values, per_segment = self.store.take(name, found)
            ends = np.concatenate([[0], np.cumsum(per_segment)])
            if name.endswith("_cuts"):
                # Cuts count from the document's first token on.
                ids = self.store.sizes[f"{name[0]}_ids"][found].astype(np.int64)
                before = np.cumsum(ids) - ids
                first = np.concatenate([before, [0]])[np.minimum(begins[:-1], len(before))]
                values = values + np.repeat(before - first[text], per_segment)
            out[name] = values, np.diff(ends[begins])
        return out


#: One aligner per worker process, so that known segments stay known from task to task.
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _kinds(a_path: str, b_path: str) -> dict[str, str]:
    small = spelling(a_path).size * PieceModel(b_path).model.get_piece_size() < 1 << 31
    return {"a_ids": "int", "b_ids": "int", "a_cuts": "int", "b_cuts": "int", "links": "int" if small else "long"}


def aligned_batches(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, kinds: dict[str, str]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    for number, rows in enumerate(text_slices(batches, most_bytes=_BLOCK_BYTES)):
        lists = aligner(a_path, b_path).align(rows.column(1).to_pylist())
        columns = [lists_of(*lists[name], pa.int32() if kind == "int" else pa.int64()) for name, kind in kinds.items()]
        block = pa.array(np.full(rows.num_rows, first + number), pa.int64())
        yield pa.record_batch([rows.column(0), block, *columns], names=["doc_id", "block", *kinds])


def _texts_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def align_documents(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: its ids by both tokenizers, where its groups end in either list, and its links.

    A link is one number, A id * (size of B's vocabulary) + B id. `block` tells the documents that one task held together.
    """
    kinds = _kinds(a_path, b_path)
    schema = "doc_id long, block long, " + ", ".join(f"{n} array<{k}>" for n, k in kinds.items())
    return _texts_of(documents).mapInArrow(lambda batches: aligned_batches(batches, a_path, b_path, kinds), schema)


def with_pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """`rows` (with block and links) and, over the links of each: n_links, n_best (links of the highest count of their B id), count_sum."""
    rows = stored(rows, "aligned")
    asked = rows.select("block", F.explode("links").alias("pair")).groupBy("block", "pair").agg(F.count(F.lit(1)).alias("n"))
    asked = stored(asked, "aligned-pairs")
    counts = asked.groupBy("pair").agg(F.sum("n").alias("n"))
    # At most one row per id of B's vocabulary.
    highest = counts.groupBy((F.col("pair") % b_size).alias("b_id")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("b_id", F.col("pair") % b_size).join(F.broadcast(highest), "b_id")
    answers = asked.select("block", "pair").join(counts.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair")
    kept = [f for f in rows.schema.fields if f.name not in ("block", "links")]

    def run(documents: pa.Table, answer: pa.Table) -> pa.Table:
        documents = documents.combine_chunks()
        links = documents["links"].combine_chunks()
        links = links.chunk(0) if isinstance(links, pa.ChunkedArray) else links
        per_row = np.diff(links.offsets.to_numpy())
        pair = answer["pair"].to_numpy()
        order = np.argsort(pair)
        place = order[np.searchsorted(pair[order], links.flatten().to_numpy())] if len(pair) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(per_row)])
        sums = {}
        for name, values in (("n_best", answer["best"].to_numpy().astype(np.int64)), ("count_sum", answer["n"].to_numpy())):
            sums[name] = pa.array(np.diff(np.concatenate([[0], np.cumsum(values[place])])[ends]), pa.int64())
        return pa.table({**{f.name: documents[f.name] for f in kept}, "n_links": pa.array(per_row, pa.int64()), **sums})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_links long, n_best long, count_sum long"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, block, links, n_a, n_b, n_groups, groups_sha256 of aligned documents."""
    for batch in batches:
        columns = [batch.column(name) for name in ("a_ids", "b_ids", "a_cuts", "b_cuts")]
        values = [c.values.to_numpy() for c in columns]
        ends = [c.offsets.to_numpy().tolist() for c in columns]
        digests = []
        for row in range(batch.num_rows):
            a, b, i, k = (v[e[row] : e[row + 1]].tolist() for v, e in zip(values, ends, strict=True))
            a, b = list(map(str, a)), list(map(str, b))
            groups = [
                f"{a[p]}|{b[q]}" if s - p == 1 == t - q else ",".join(a[p:s]) + "|" + ",".join(b[q:t])
                for p, s, q, t in zip([0, *i], i, [0, *k], k, strict=False)
            ]
            digests.append(hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        counts = [pa.array(np.diff(e), pa.int64()) for e in ends[:3]]
        yield pa.record_batch(
            [*(batch.column(n) for n in ("doc_id", "block", "links")), *counts, pa.array(digests, pa.string())],
            names=["doc_id", "block", "links", "n_a", "n_b", "n_groups", "groups_sha256"],
        )


def alignment_digest(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: sizes, a digest of its groups, and how its links stand in the corpus; one worker aligns and digests batch by batch."""
    kinds = _kinds(a_path, b_path)
    digests = _texts_of(documents).mapInArrow(
        lambda batches: digest_batches(aligned_batches(batches, a_path, b_path, kinds)),
        f"doc_id long, block long, links array<{kinds['links']}>, n_a long, n_b long, n_groups long, groups_sha256 string",
    )
    counted = with_pair_counts(digests, sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size())
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
