"""Byte-level BPE encoding and decoding: speculate on whole batches of words, verify, merge only what fails.

Texts are cut into words as the tokenizer file says. Distinct words new to a worker are laid end to end, and a greedy
longest match over the vocabulary proposes their tokens: all positions walk a byte trie together, then one chain of
jumps picks the matches. A proposal is the BPE result exactly when every token is what its own bytes merge to and no
two adjacent tokens would have joined across their border, so each distinct adjacent pair is tested once, all of them
in step: merges happen in rising rank, hence undoing the later of the two border tokens' last merges, again and again,
visits every pair of pieces that ever met at the border, and such a pair is a clash when its own merge ranks before the
merge that ended the meeting. Words with a clash are merged exactly, by rank, then place.

Defined results: null text is empty and has no ids; repeated rows stay repeated; a null doc_id stays; other columns are
ignored; an empty table gives no rows. Strings of added tokens are cut out first unless `plain` is set; then they are
ordinary text. Decoding passes over ids outside the vocabulary, and bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from foldwright.llm.base import text_slices
from foldwright.llm.list_store import Lists, ListStore
from foldwright.llm.runs import spread_index

#: The word pattern of byte-level files, and characters whose classes have not changed between editions of Unicode.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SETTLED = regex.compile(r"[\x00-ԧ‐-‧₠-₹ぁ-ゖァ-ヺ一-鿋가-힣]*")
_NEVER = np.iinfo(np.int64).max
#: Words that a worker keeps.
_STORE_WORDS = 1 << 18
#: Bytes of a word up to which the next merge is found by a scan.
_SHORT = 48
_SLICE_BYTES, _SLICE_IDS = 1 << 20, 1 << 20


def byte_letters() -> dict[str, int]:
    """The byte that each letter of byte-level files stands for: printable ones themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TokenBytes:
    """The bytes of the tokens of a byte-level file, and decoding by them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        vocabulary, added = self.spec["model"]["vocab"], self.spec.get("added_tokens", [])
        letters = byte_letters()
        self.size = 1 + max([*vocabulary.values(), *(t["id"] for t in added)])
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, number in itertools.chain(vocabulary.items(), ((t["content"], t["id"]) for t in added)):
            self.bytes_of[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.heads = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of `counts` ids."""
        known = (ids >= 0) & (ids < self.size)
        place = np.where(known, ids, 0)
        sizes = np.where(known, self.lengths[place], 0)
        raw = self.pool[spread_index(self.heads[place], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in itertools.pairwise(ends)]


class BpeCodec(TokenBytes):
    """Encodes and decodes by one tokenizer file; words seen before are kept, up to a bounded number."""

    def __init__(self, path: str, plain: bool = False):
        super().__init__(path)
        spec = self.spec
        del self.spec
        model, cutter, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        if (
            model.get("type") != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True)
            or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix")
            or model.get("end_of_word_suffix") or any(t[f] for t in added for f in ("single_word", "lstrip", "rstrip"))
        ):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.cutter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        vocabulary = model["vocab"]
        self.special = {} if plain else {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.special, key=lambda s: (-len(s), s))
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None
        self.byte_ids = [vocabulary[c] for c, _ in sorted(byte_letters().items(), key=lambda x: x[1])]
        self._read_merges(model["merges"], vocabulary)
        self._build_trie(vocabulary)
        self.store = ListStore(self._learn, {"ids": np.int32}, _STORE_WORDS)

    def _read_merges(self, merges: list, vocabulary: dict[str, int]) -> None:
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        self.merge = {(a, b): (rank, m) for rank, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))}
        size = self.size
        keys = left * size + right
        self.pair_ranks = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_ranks]
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left = np.full(size, -1, dtype=np.int64)
        self.right = np.full(size, -1, dtype=np.int64)
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        # The border test needs one way to make each token, and parts that are made before the whole.
        self.orderly = len(np.unique(made)) == len(made) and bool((self.rank[made] > np.maximum(self.rank[left], self.rank[right])).all())
        whole = np.zeros(size, dtype=bool)
        whole[self.byte_ids] = True
        if self.orderly:
            sound = ~self._clash(left, right, np.arange(len(made)))
            while True:
                now = sound & whole[left] & whole[right]
                if (now == whole[made]).all():
                    break
                whole[made] = now
        self.whole = whole

    def _build_trie(self, vocabulary: dict[str, int]) -> None:
        """Edges (node, byte) -> node in key order, and the token that ends at each node; tokens that nothing merges to are left out."""
        edges: dict[int, int] = {}
        ends = [-1]
        for number in vocabulary.values():
            if not self.whole[number]:
                continue
            node = 0
            for byte in self.bytes_of[number]:
                key = node << 8 | byte
                node = edges.setdefault(key, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = number
        keys = np.array(list(edges), dtype=np.int64)
        order = np.argsort(keys)
        self.edge_keys, self.edge_nodes = keys[order], np.array(list(edges.values()), dtype=np.int64)[order]
        self.node_token = np.array(ends, dtype=np.int64)

    def _learn(self, words: list) -> Lists:
        ordinary = [w for w in words if isinstance(w, str)]
        ids, counts = self.encode_words([w.encode() for w in ordinary]) if ordinary else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        special = [w for w in words if not isinstance(w, str)]
        if special:
            # Rows stand in the order of `words`.
            flat = iter(np.split(ids, np.cumsum(counts)[:-1]) if ordinary else [])
            lists = [next(flat) if isinstance(w, str) else np.array([self.special[w[0]]]) for w in words]
            ids, counts = np.concatenate(lists), np.array([len(x) for x in lists])
        return {"ids": (ids, counts)}

    def cut(self, text: str) -> list:
        """The words of a text; an added token is a tuple with its string."""
        if self.special_pattern and self.special_pattern.search(text):
            parts = self.special_pattern.split(text)
            return [w for k, part in enumerate(parts) for w in ([(part,)] if k % 2 else self._cut_plain(part))]
        return self._cut_plain(text)

    def _cut_plain(self, text: str) -> list[str]:
        if text.isascii() or _SETTLED.fullmatch(text):
            return WORDS.findall(text)
        return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        words = [self.cut(t) for t in texts]
        found = self.store.find(list(itertools.chain.from_iterable(words)))
        ids, sizes = self.store.take("ids", found)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, words)])]
        return ids, np.diff(ends)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (no further cutting) one after the other, and the number of ids of each; words are not empty."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(lengths)
        if self.orderly:
            tokens, starts = self._propose(np.frombuffer(b"".join(words), dtype=np.uint8), ends, lengths)
            word = np.searchsorted(ends, starts, "right")
            failing = np.zeros(len(words), dtype=bool)
            inner = np.flatnonzero(word[1:] == word[:-1])
            failing[word[inner[self._clashing(tokens[inner], tokens[inner + 1])]]] = True
        else:
            tokens, word, failing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(len(words), dtype=bool)
        if not failing.any():
            return tokens, np.bincount(word, minlength=len(words))
        good = ~failing[word]
        exact = {k: self.merge_exactly(words[k]) for k in np.flatnonzero(failing).tolist()}
        ids = np.concatenate([tokens[good], np.fromiter(itertools.chain.from_iterable(exact.values()), np.int64)])
        owner = np.concatenate([word[good], np.repeat(np.array(list(exact), dtype=np.int64), [len(x) for x in exact.values()])])
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _propose(self, data: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches: tokens and where they start."""
        n = len(data)
        room = np.repeat(ends, lengths) - np.arange(n)
        best, token = np.ones(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        at, node, depth = np.arange(n), np.zeros(n, dtype=np.int64), 0
        while len(at):
            key = node << 8 | data[at + depth]
            place = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            there = self.edge_keys[place] == key
            at, node, depth = at[there], self.edge_nodes[place[there]], depth + 1
            ending = self.node_token[node]
            closed = ending >= 0
            best[at[closed]], token[at[closed]] = depth, ending[closed]
            more = room[at] > depth
            at, node = at[more], node[more]
        step, starts, p = best.tolist(), [], 0
        while p < n:
            starts.append(p)
            p += step[p]
        chosen = np.array(starts, dtype=np.int64)
        return token[chosen], chosen

    def _clashing(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs, which = np.unique(left * self.size + right, return_inverse=True)
        return self._clash(pairs // self.size, pairs % self.size, np.full(len(pairs), _NEVER))[which]

    def _clash(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether pieces at the border of adjacent tokens merge across it with a rank below `bound`."""
        out = np.zeros(len(left), dtype=bool)
        row, a, b, bound = np.arange(len(left)), left, right, bound.astype(np.int64)
        while len(row):
            key = a * self.size + b
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            meets = (self.pair_keys[place] == key) & (self.pair_ranks[place] < bound)
            out[row[meets]] = True
            go = ~meets & (np.maximum(self.rank[a], self.rank[b]) >= 0)
            row, a, b = row[go], a[go], b[go]
            # Of equal ranks the left piece merged first, so the right one is undone first; the border pair stands left of
            # the right piece's own merge and so goes before it when both have one rank.
            undo_right = self.rank[b] >= self.rank[a]
            bound = np.where(undo_right, self.rank[b] + 1, self.rank[a])
            a, b = np.where(undo_right, a, self.right[a]), np.where(undo_right, self.left[b], b)
        return out

    def merge_exactly(self, word: bytes) -> list[int]:
        """All merges of a word in rising rank, of one rank from left to right."""
        ids = [self.byte_ids[b] for b in word]
        return self._merge_short(ids) if len(ids) <= _SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The least rank is looked for anew after each merge."""
        merge, none = self.merge, (_NEVER, 0)
        ranks = [merge.get(p, none)[0] for p in itertools.pairwise(ids)]
        while ranks and (least := min(ranks)) != _NEVER:
            k = ranks.index(least)
            ids[k : k + 2] = [merge[ids[k], ids[k + 1]][1]]
            del ranks[k]
            if k:
                ranks[k - 1] = merge.get((ids[k - 1], ids[k]), none)[0]
            if k < len(ranks):
                ranks[k] = merge.get((ids[k], ids[k + 1]), none)[0]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """Ranks wait in a heap, so that the work is in proportion to the length."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(self.merge[p][0], k, *p) for k, p in enumerate(itertools.pairwise(ids)) if p in self.merge]
        heapq.heapify(waiting)
        while waiting:
            _, k, a, b = heapq.heappop(waiting)
            other = after[k]
            if ids[k] != a or other >= n or ids[other] != b:
                continue
            ids[k], ids[other] = self.merge[a, b][1], -1
            after[k] = after[other]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (ids[x], ids[y]) in self.merge:
                    heapq.heappush(waiting, (self.merge[ids[x], ids[y]][0], x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]


#: One codec per worker process, so that known words stay known from task to task.
_CODECS: dict[tuple[str, bool], BpeCodec] = {}


def codec(path: str, plain: bool = False) -> BpeCodec:
    if (path, plain) not in _CODECS:
        _CODECS[path, plain] = BpeCodec(path, plain)
    return _CODECS[path, plain]


_SPELLINGS: dict[str, TokenBytes] = {}


def spelling(path: str) -> TokenBytes:
    if path not in _SPELLINGS:
        _SPELLINGS[path] = TokenBytes(path)
    return _SPELLINGS[path]


def lists_of(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Runs of `counts` values as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def encoded_batches(batches: Iterator[pa.RecordBatch], tokenizer: str, plain: bool) -> Iterator[pa.RecordBatch]:
    for rows in text_slices(batches, most_bytes=_SLICE_BYTES):
        ids, counts = codec(tokenizer, plain).encode(rows.column(1).to_pylist())
        yield pa.record_batch([rows.column(0), lists_of(ids, counts, pa.int32())], names=["doc_id", "ids"])


def decoded_batches(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(counts), 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _SLICE_IDS, "right")))
            rows = batch.slice(first, last - first)
            ids = rows.column(1).flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            texts = spelling(tokenizer).decode(ids, counts[first:last])
            yield pa.record_batch([*rows.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
            first = last


def _texts_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(documents: DataFrame, tokenizer: str, plain: bool = False) -> DataFrame:
    """The ids of every whole text: doc_id, ids."""
    return _texts_of(documents).mapInArrow(lambda batches: encoded_batches(batches, tokenizer, plain), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """`encoded` (doc_id, ids) with the text that the ids decode to; null ids count as none."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: decoded_batches(batches, tokenizer), "doc_id long, ids array<int>, text string")


def bpe_round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to; one worker encodes and decodes batch by batch."""
    both = _texts_of(documents).mapInArrow(
        lambda batches: decoded_batches(encoded_batches(batches, tokenizer, False), tokenizer), "doc_id long, ids array<int>, text string"
    )
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
