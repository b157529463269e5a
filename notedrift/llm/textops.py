"""Array helpers for text inside Arrow batches.

Everything works on one bounded slice of an Arrow batch at a time (whole texts,
never prefixes); a slice is closed once it holds ``SLICE_BYTES`` bytes, so
the peak memory of a task is bounded by that constant or by one single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000

#: Fixed seed of the random tables behind `hash_runs`; not a tunable.
_TABLE_SEED = 20_240_501


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [lo, hi) of entries whose sizes add up to ``limit`` at most (one entry at least)."""
    stop = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        held = stop[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(stop, held + limit, "right")))
        yield lo, hi
        lo = hi


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """(lo, hi, texts) over an Arrow string column; a null is the empty text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in slices(sizes, limit):
        yield lo, hi, [t if t is not None else "" for t in column.slice(lo, hi - lo).to_pylist()]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_TABLE_SEED)
    # index 0x10FFFF is the last code point
    value = rng.integers(1, 2**64 - 1, size=0x110000, dtype=np.uint64)
    place = rng.integers(1, 2**64 - 1, size=256, dtype=np.uint64) | np.uint64(1)
    return value, place


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hash_runs(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs ``cps[s:e]`` (non-empty, in order, not overlapping).

    Sum of random 64-bit values per code point times an odd factor per place,
    with the length mixed in: equal runs hash equally wherever they stand, and
    two different runs collide with a probability of about 2**-64.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    value, place = _tables()
    lens = (ends - starts).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    total = int(lens.sum())
    at = np.arange(total, dtype=np.int64) - np.repeat(first, lens)
    if total == len(cps):
        picked = cps
    else:
        picked = cps[at + np.repeat(starts.astype(np.int64), lens)]
    v = value[picked] * place[at & 255]
    far = at >= 256
    if far.any():  # places repeat beyond 256: turn the value by the round, so order still counts
        turns = (at[far] >> 8).astype(np.uint64)
        v[far] = mix64(v[far] + turns * np.uint64(0xA0761D6478BD642F))
    return mix64(np.add.reduceat(v, first) + lens.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
