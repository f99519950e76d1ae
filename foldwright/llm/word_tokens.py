"""Token ids of whole texts by the tokenizers library, each distinct word encoded once.

A tokenizer that drops white space encodes every white-space separated piece on its own. Pieces of plain Latin text
are cut further into the words of its pre-tokenizer (letters, single digits, punctuation). Words are hashed in numpy,
distinct ones go through the library's BPE model once, and ids are gathered by index; the bytes of every word are
compared with those of the word found. Words of plain pieces are looked up in lower case. Pieces with other characters
or the beginning of an added token go through the whole tokenizer as they stand. Files of another kind are encoded text
by text.
"""

from __future__ import annotations

import itertools
import json
import re

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from foldwright.llm.runs import hash_runs, spread_index

# Fixed values of the tokenizer file that the word path relies on.
_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# The same words for lower-case text of printable ASCII and the letters U+00C0 to U+017F.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ſ]+|[0-9]|[!-/:-@\\[-`{-~]+")
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[33:127] = _SIGN
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CACHE_WORDS = 1 << 20
_JOINED_WORDS = 20_000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = itertools.count(256)
    return {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}


class TextEncoder:
    """Encodes buffers of texts; words seen before are kept, up to a bounded number."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (
            (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
            and splits[0].get("pattern") == {"Regex": _PATTERN}
            and splits[0].get("behavior") == "Removed"
            and len(splits) == 2
            and splits[1].get("type") == "ByteLevel"
            and spec["model"].get("end_of_word_suffix") == "</w>"
            and all("<|" in token["content"] for token in spec.get("added_tokens", []))
        )
        if self.by_word:
            self.model = Tokenizer(self.library.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            letters = _byte_letters()
            self.letters = {b: c for b, c in letters.items() if b != 32}
            self.ends_word = np.zeros(self.vocabulary, dtype=bool)
            for token, number in self.library.get_vocab().items():
                self.ends_word[number] = token.endswith("</w>")
            self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.word_heads = np.zeros(0, np.int64)
        self.word_sizes = np.zeros(0, np.int64)
        self.word_pool = np.zeros(0, np.uint8)
        self.heads = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        if not self.by_word:
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in itertools.pairwise(offsets.tolist())]
            ids = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids], dtype=np.int64)
        starts, sizes, exact = _cut(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        folded = _LOWER[data]
        folded[exact] = data[exact]
        found = self._look_up(folded, starts, sizes)
        if self._are(folded, starts, sizes, found):
            lengths = self.sizes[found]
            ids = self.pool[spread_index(self.heads[found], lengths)]
        else:
            # Two words with one hash: this buffer goes without the store.
            ids, lengths = self._encode_words(_texts(folded, starts, sizes))
        text = np.searchsorted(offsets[1:], starts, "right")
        return ids, np.bincount(text, weights=lengths, minlength=len(offsets) - 1).astype(np.int64)

    def _are(self, folded: np.ndarray, starts: np.ndarray, sizes: np.ndarray, found: np.ndarray) -> bool:
        """Whether every word has the bytes of the word found."""
        if not np.array_equal(self.word_sizes[found], sizes):
            return False
        return np.array_equal(folded[spread_index(starts, sizes)], self.word_pool[spread_index(self.word_heads[found], sizes)])

    def _look_up(self, folded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Positions of the words in the store by their hash, after unknown ones were added."""
        distinct, example, which = np.unique(hash_runs(folded, starts, sizes), return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > _CACHE_WORDS:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == distinct[at < len(self.keys)]
        if not known.all():
            new = example[~known]
            ids, lengths = self._encode_words(_texts(folded, starts[new], sizes[new]))
            place = at[~known]
            self.keys = np.insert(self.keys, place, distinct[~known])
            self.heads = np.insert(self.heads, place, len(self.pool) + np.cumsum(lengths) - lengths)
            self.sizes = np.insert(self.sizes, place, lengths)
            self.pool = np.concatenate([self.pool, ids])
            self.word_heads = np.insert(self.word_heads, place, len(self.word_pool) + np.cumsum(sizes[new]) - sizes[new])
            self.word_sizes = np.insert(self.word_sizes, place, sizes[new])
            self.word_pool = np.concatenate([self.word_pool, folded[spread_index(starts[new], sizes[new])]])
            at = np.searchsorted(self.keys, distinct)
        return at[which]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [_WORDS.findall(w.lower()) if _is_plain(w) else None for w in words]
        flat = [part for parts in plain if parts for part in parts]
        ids: list[np.ndarray] = []
        for first in range(0, len(flat), _JOINED_WORDS):
            text = " ".join(flat[first : first + _JOINED_WORDS]).encode().decode("latin-1").translate(self.letters)
            ids.append(np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32))
        got = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        word_ends = np.concatenate([[0], np.flatnonzero(self.ends_word[got]) + 1])
        parts = np.cumsum([0] + [len(p) for p in plain if p is not None])
        bounds = word_ends[parts]
        rest = iter(self.library.encode_batch_fast([w for w, p in zip(words, plain, strict=True) if p is None], add_special_tokens=False))
        pieces, k = [], 0
        for p in plain:
            if p is None:
                pieces.append(np.array(next(rest).ids, dtype=np.uint32))
            else:
                pieces.append(got[bounds[k] : bounds[k + 1]])
                k += 1
        return np.concatenate(pieces), np.array([len(p) for p in pieces], dtype=np.int64)


def _texts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a : a + n].decode() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")


def _is_plain(word: str) -> bool:
    return "<|" not in word and _PLAIN.fullmatch(word) is not None


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word, and the bytes of pieces with characters outside the plain set, which stay whole."""
    n = len(data)
    exact = np.zeros(n, dtype=bool)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), exact
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    if len(lead):
        # The two-byte letters U+00C0 to U+017F, but not the signs U+00D7 and U+00F7, nor U+0130 whose lower case is longer.
        second = data[np.minimum(lead + 1, n - 1)]
        sign = (data[lead] == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (data[lead] == 0xC4) & (second == 0xB0)
        good = lead[~sign]
        kind[good] = _LETTER
        kind[good + 1] = _LETTER
    head = np.zeros(n + 1, dtype=bool)
    head[offsets[:-1]] = True
    head = head[:n]
    filled = kind != _SPACE
    before = np.empty_like(kind)
    before[0], before[1:] = _SPACE, kind[:-1]
    start = filled & ((kind != before) | (kind == _DIGIT) | head)
    quote = np.flatnonzero((data[:-1] == 39) & start[:-1] & (kind[1:] == _LETTER) & ~head[1:])
    start[quote + 1] = False
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124) & ~head[1:])
    odd = np.flatnonzero(kind == _OTHER)
    if len(odd) or len(special):
        piece = filled & ((before == _SPACE) | head)
        number = np.cumsum(piece)
        whole = np.zeros(int(number[-1]) + 1, dtype=bool)
        whole[number[odd]] = whole[number[special]] = True
        exact = whole[number] & filled
        start = np.where(exact, piece, start)
    starts = np.flatnonzero(start)
    stop = np.ones(n, dtype=bool)
    stop[:-1] = start[1:] | ~filled[1:] | head[1:]
    return starts, np.flatnonzero(stop & filled) + 1 - starts, exact
