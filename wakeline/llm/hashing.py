"""Vectorised 64-bit hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers never vanish
_SPACE_BYTES = (9, 10, 11, 12, 13, 32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A value for each byte: 0 for white space, A-Z as a-z."""
    order = np.arange(256, dtype=np.uint64)
    order[65:91] += np.uint64(32)
    values = mix((order + np.uint64(1)) * _BASE)
    values[list(_SPACE_BYTES)] = 0
    return values


_VALUES = _byte_values()
_IS_WORD = _VALUES != 0
_POWERS = np.cumprod(np.full(4096, _BASE, np.uint64))


def _powers(n: int) -> np.ndarray:
    return _POWERS if n <= len(_POWERS) else np.cumprod(np.full(n, _BASE, np.uint64))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes in order, first word of each text (with the end), and the words' first bytes' places.

    Words are runs without space or the characters 9 to 13; A-Z count as a-z.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    inside = _IS_WORD[joined]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    offsets = np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), offsets, starts
    places = np.arange(len(joined), dtype=np.int64)
    since = places - np.maximum.accumulate(np.where(first, places, 0))
    longest = int(since[inside].max()) + 1
    since[~inside] = 0
    sums = np.add.reduceat(_VALUES[joined] * _powers(longest)[since], starts)
    lengths = np.add.reduceat(inside.astype(np.uint64), starts)
    return mix(sums + lengths * _M1), offsets, starts


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Order-sensitive hash of each run of ``size`` neighbours, texts ignored."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(seed * 2 + size), np.uint64)
    for k in range(size):
        total = mix(total * _BASE + hashes[k : k + n])
    return total
