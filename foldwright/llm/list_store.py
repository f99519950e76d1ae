"""A bounded store of results per word inside one worker process."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Hashable, Mapping

import numpy as np

from foldwright.llm.runs import spread_index

Lists = Mapping[str, tuple[np.ndarray, np.ndarray]]
_AT_ONCE = 20_000


class ListStore:
    """Lists of numbers per key, computed once by `learn(keys)`: name -> (values of all keys, how many per key).

    Above `most` keys, those that were asked for only once are dropped, and all of them when that is not enough. One
    question may go beyond the bound by its own keys.
    """

    def __init__(self, learn: Callable[[list], Lists], kinds: Mapping[str, type], most: int):
        self.learn, self.kinds, self.most = learn, kinds, most
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[Hashable, int] = {}
        self.asked = np.zeros(0, np.int32)
        self.heads = {name: np.zeros(0, np.int32) for name in self.kinds}
        self.sizes = {name: np.zeros(0, np.int32) for name in self.kinds}
        self.pools = {name: np.zeros(0, kind) for name, kind in self.kinds.items()}

    def _add(self, keys: list, lists: Lists) -> None:
        self.rows.update(zip(keys, range(len(self.rows), len(self.rows) + len(keys)), strict=True))
        self.asked = np.concatenate([self.asked, np.zeros(len(keys), np.int32)])
        for name, (values, counts) in lists.items():
            heads = len(self.pools[name]) + np.cumsum(counts) - counts
            self.heads[name] = np.concatenate([self.heads[name], heads.astype(np.int32)])
            self.sizes[name] = np.concatenate([self.sizes[name], counts.astype(np.int32)])
            self.pools[name] = np.concatenate([self.pools[name], values.astype(self.kinds[name])])

    def _shrink(self) -> None:
        kept = np.flatnonzero(self.asked > 1)
        if 2 * len(kept) > self.most:
            self._clear()
            return
        keys = list(self.rows)
        lists = {name: self.take(name, kept) for name in self.kinds}
        self._clear()
        self._add([keys[k] for k in kept.tolist()], lists)

    def find(self, keys: list) -> np.ndarray:
        """Row numbers of the keys, after unknown ones were learned; they hold until the next call."""
        new = set(keys) - self.rows.keys()
        if len(self.rows) + len(new) > self.most:
            self._shrink()
            new = set(keys) - self.rows.keys()
        rest = iter(new)
        while part := list(itertools.islice(rest, _AT_ONCE)):
            self._add(part, self.learn(part))
        found = np.fromiter(map(self.rows.__getitem__, keys), np.int64, len(keys))
        self.asked += np.bincount(found, minlength=len(self.asked)).astype(np.int32)
        return found

    def take(self, name: str, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of rows one after the other, and the length of each."""
        sizes = self.sizes[name][found].astype(np.int64)
        return self.pools[name][spread_index(self.heads[name][found].astype(np.int64), sizes)], sizes
