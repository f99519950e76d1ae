"""Deterministic random draws (BP-2): equal inputs give equal draws on any partitioning.

A draw is the first 60 bits of an MD5 digest over the seed and the identifying values, so any SQL
engine can repeat it; nothing depends on task order, retries or a generator's state.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(1 << 60)


def hash_key(seed: int | str, *parts: Column | str) -> Column:
    """A number in [0, 2**60); ordering by it is a seeded shuffle."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_index(seed: int | str, n: Column | int, *parts: Column | str) -> Column:
    """A draw from 0..n-1."""
    bound = F.lit(n) if isinstance(n, int) else n
    return F.pmod(hash_key(seed, *parts), bound.cast("long"))


def hash_uniform(seed: int | str, *parts: Column | str) -> Column:
    """A draw from [0, 1)."""
    return hash_key(seed, *parts) / F.lit(_SPAN)
