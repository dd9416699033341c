"""Hashes over words and bytes as numpy arrays: word hashes, hashes of runs of symbols, window minima."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_POSITION_BITS = 24
#: Longest run of symbols that one call of :func:`window_minima` takes.
MAX_RUN = 1 << _POSITION_BITS

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for an ordered pair of numbers."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F))


def lower_ascii(data: bytes) -> bytes:
    """A-Z in lower case, all other bytes as they are."""
    return data.translate(_LOWER)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        _powers = np.full(size, _BASE, dtype=np.uint64)
        _inverses = np.full(size, _INVERSE, dtype=np.uint64)
        _powers[0] = _inverses[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
        np.multiply.accumulate(_inverses, out=_inverses)
    return _powers[:n], _inverses[:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (in bytes) of the words ``[^\\x20\\x09-\\x0D]+``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _IS_SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, ends
    powers, inverses = _tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_SYMBOLS[raw] * powers[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverses[starts]), starts, ends


def byte_symbols(data: bytes) -> np.ndarray:
    """A 64-bit number for each byte."""
    return _BYTE_SYMBOLS[np.frombuffer(data, dtype=np.uint8)]


_BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class Runs:
    """Hashes of runs of symbols, from one pass of prefix sums over them."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        powers, self._inverses = _tables(self.n + 1)
        self._total = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(symbols * powers[: self.n], out=self._total[1:])

    def all(self, length: int) -> np.ndarray:
        """The hash of the ``length`` symbols that start at each position."""
        count = self.n - length + 1
        if count <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self._total[length:] - self._total[:count]) * self._inverses[:count])

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        """The same for some positions."""
        return mix((self._total[start + length] - self._total[start]) * self._inverses[start])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the position of its least one (of its upper bits; the first on ties)."""
    mask = np.uint64(MAX_RUN - 1)
    known = (values & ~mask) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        known = np.minimum(known[: len(known) - size], known[size:])
        size *= 2
    if size < width:
        rest = width - size
        known = np.minimum(known[: len(known) - rest], known[rest:])
    return (known & mask).astype(np.int64)
